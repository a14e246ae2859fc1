"""Column functions (B, C, S03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill import adapters as A
from cuemill.functions import clips as C
from cuemill.functions import progress as P
from cuemill.functions import text as T
from cuemill.functions import timecode as M
from cuemill.queries.base import half_up, is_bound, is_break, normal, number, punctuated, query, similar, sql, stamp, strict_ms, to_ms, trim
from cuemill.schema import FONTS, FRAME_RATES, STEPS, fonts
from cuemill.session import dealt
from cuemill.sources.stores import effective_settings


@query(sql("marks", f"SELECT id, {stamp('ms')} AS stamp FROM marks"))
def b01_ms_to_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.marks(spark, sf_dir).select("id", M.ms_to_timestamp("ms").alias("stamp"))


@query(sql("time_texts", f"SELECT id, {to_ms('text')} AS ms, len(string_split(text, ':')) NOT IN (2, 3) AS malformed FROM time_texts"))
def b02_timestamp_to_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.time_texts(spark, sf_dir).select("id", M.timestamp_to_ms("text").alias("ms"), M.is_malformed_timestamp("text").alias("malformed"))


@query(sql("marks", f"SELECT id, {stamp('ms', ',')} AS stamp FROM marks"))
def b03_ms_to_srt_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.marks(spark, sf_dir).select("id", M.ms_to_srt_timestamp("ms").alias("stamp"))


@query(sql("marks", "SELECT id, printf('%d:%02d', ms // 60000, ms // 1000 % 60) AS clock FROM marks"))
def b04_ms_to_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.marks(spark, sf_dir).select("id", M.ms_to_clock("ms").alias("clock"))


@query(sql("time_texts", f"SELECT id, {strict_ms('text')} AS ms FROM time_texts"))
def b05_clock_to_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.time_texts(spark, sf_dir).select("id", M.clock_to_ms("text").alias("ms"))


@query(
    sql(
        "marks",
        "SELECT id, CASE WHEN d < 0 THEN '-' ELSE '' END || printf('%d:%02d.%d', abs(d) // 60000, abs(d) // 1000 % 60, abs(d) % 1000 // 100) AS typed FROM (SELECT id, ms - 200000000 AS d FROM marks)",
    )
)
def b06_ms_to_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.marks(spark, sf_dir).select("id", M.ms_to_input(F.col("ms") - 200_000_000).alias("typed"))


@query(
    sql(
        "time_texts",
        f"SELECT id, CASE WHEN len(string_split({trim('text')}, ':')) = 1 THEN CASE WHEN {number(trim('text'))} >= 0 THEN {half_up(number(trim('text')) + ' * 1000')} END ELSE {strict_ms('text')} END AS ms FROM time_texts",
    )
)
def b07_input_to_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.time_texts(spark, sf_dir).select("id", M.input_to_ms("text").alias("ms"))


@query(sql("marks", f"SELECT id, {half_up('(seconds - 100) * 1000')} AS ms FROM marks"))
def b08_seconds_to_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.marks(spark, sf_dir).select("id", M.seconds_to_ms(F.col("seconds") - 100).alias("ms"))


@query(sql("turn_captions", "SELECT project_id, pos, text, start_ms, end_ms, timestamp_ms FROM turn_captions"))
def b09_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.as_captions(A.turns(spark, sf_dir)).drop("confidence")


@query(sql("vocabulary", f"SELECT word, {normal('word')} AS norm FROM vocabulary"))
def b11_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vocabulary(spark, sf_dir).select("word", T.normalized("word").alias("norm"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the conversations with the one before it, as norms."""
    rows = A.turns(spark, sf_dir).select(T.normalized("word").alias("b"), F.expr("lag(word) OVER (PARTITION BY project_id ORDER BY pos)").alias("_a"))
    return rows.select(T.normalized("_a").alias("a"), "b").where("a is not null").distinct()


PAIRS = f"SELECT DISTINCT a, b FROM (SELECT {normal('lag(word) OVER (PARTITION BY project_id ORDER BY pos)')} AS a, {normal('word')} AS b FROM turn_words) WHERE a IS NOT NULL"


@query(sql("turn_words", "SELECT a, b, levenshtein(a, b) AS edits FROM pairs", pairs=PAIRS))
def b12_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("edits", F.levenshtein("a", "b").cast("long"))


@query(sql("turn_words", f"SELECT a, b, {similar('a', 'b')} AS similar FROM pairs", pairs=PAIRS))
def b13_is_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("similar", T.is_similar("a", "b"))


@query(sql("vocabulary", f"SELECT word, {is_break('word')} AS breaks, {is_bound('word')} AS bound, {is_break('word', 'sk')} AS breaks_sk, {is_bound('word', 'cs')} AS bound_cs FROM vocabulary"))
def b14_break_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = {"breaks": T.is_break_word("word", "en"), "bound": T.is_bound_word("word", "en"), "breaks_sk": T.is_break_word("word", "sk"), "bound_cs": T.is_bound_word("word", "cs")}
    return A.vocabulary(spark, sf_dir).withColumns(marks)


@query(sql("vocabulary", f"SELECT word, {punctuated('word')} AS punctuated FROM vocabulary"))
def b15_ends_with_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vocabulary(spark, sf_dir).withColumn("punctuated", T.ends_with_punctuation("word"))


RATES = "(VALUES (23.976::DOUBLE), (25.0::DOUBLE), (59.94::DOUBLE)) AS r(fps)"


def _rates(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fps", F.explode(F.array(*map(F.lit, (23.976, 25.0, 59.94)))))


@query(
    sql(
        "marks",
        f"SELECT id, fps, CAST(floor(ms / 1000 * fps + 0.5) AS BIGINT) AS start_frame, floor(ms / 1000 * fps + 0.5) / fps * 1000 AS snapped_ms, "
        f"CAST(greatest(1, ceil((ms + id * 7 - floor(ms / 1000 * fps + 0.5) / fps * 1000) / 1000 * fps)) AS BIGINT) AS n_frames FROM marks, {RATES}",
    )
)
def b19_frame_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, fps = F.col("ms"), F.col("fps")
    rows = _rates(A.marks(spark, sf_dir))
    return rows.select("id", "fps", C.start_frame(at, fps).alias("start_frame"), C.snapped_ms(at, fps).alias("snapped_ms"), C.frames(at, at + F.col("id") * 7, fps).alias("n_frames"))


@query(
    sql(
        "marks",
        "SELECT id, CAST(c + CASE WHEN o > 0 THEN o - v ELSE 0 END AS BIGINT) AS total, c AS clip_again, CAST(c - CASE WHEN o > 0 THEN v ELSE 0 END AS BIGINT) AS outro_from "
        "FROM (SELECT id, id + 100 AS c, id % 3 * 50 AS o, id % 31 AS v FROM marks)",
    )
)
def b20_total_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip, outro, overlap = F.col("id") + 100, F.col("id") % 3 * 50, F.col("id") % 31
    total = C.total_frames(clip, outro, overlap)
    return A.marks(spark, sf_dir).select(
        "id", total.alias("total"), C.clip_frames_of(total, outro, overlap).alias("clip_again"), C.outro_start(clip, outro, overlap).alias("outro_from")
    )


NAMES = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE text END AS title FROM documents"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("text")).alias("title"))


@query(
    "SELECT doc_id, coalesce(nullif(substr(" + trim("regexp_replace(title, '[^0-9A-Za-z_\\-" + T.SPACE[1:-1] + "]', '_', 'g')") + ", 1, 60), ''), CAST(doc_id AS VARCHAR)) AS safe, "
    "regexp_replace(title, '[^A-Za-z0-9]', '_', 'g') || '.mp4' AS studio FROM (" + NAMES + ")"
)
def b22_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("doc_id", T.safe_name("title", F.col("doc_id").cast("string")).alias("safe"), F.concat(T.studio_name("title"), F.lit(".mp4")).alias("studio"))


@query("SELECT page_id, " + trim("regexp_replace(regexp_replace(url, '\\.[^.]+$', ''), '[_-]', ' ', 'g')") + " AS name FROM pages")
def b23_video_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", T.video_name("url").alias("name"))


@query("SELECT event_id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, value - 20)) AS percent FROM events")
def b25_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", P.clamped(F.col("value") - 20).alias("percent"))


@query(
    f"""SELECT event_id, stage, CASE stage WHEN 'asr' THEN 10 + {half_up('value * 0.8::DOUBLE')} WHEN 'bundle' THEN 5 + {half_up('value * 15')} WHEN 'render' THEN 25 + {half_up('value * 70')}
    WHEN 'correct' THEN {half_up('(event_id % 10) / 10 * 80')} ELSE 90 + {half_up('(event_id % 10) / 10 * 8')} END AS percent
    FROM (SELECT event_id, value, ['asr', 'bundle', 'render', 'correct', 'translate'][event_id % 5 + 1] AS stage FROM events)"""
)
def b26_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.array(*map(F.lit, ("asr", "bundle", "render", "correct", "translate")))
    rows = A.table(spark, sf_dir, "events").withColumn("stage", F.get(stages, (F.col("event_id") % 5).cast("int")))
    return rows.select("event_id", "stage", P.rescaled("stage", "value", F.col("event_id") % 10, F.lit(10)).alias("percent"))


@query(
    """SELECT event_id, array_to_string(list_filter([regexp_extract(x, '([0-9]+)%\\|', 1) for x in regexp_split_to_array(o, '[\\r\\n]')[:-2]], lambda x: x <> ''), ',') AS percents
    FROM (SELECT event_id, printf('loading\n %d%%|##  |\r%d%%|### |\nnone\r 99%%|####', event_id % 90, event_id % 90 + 5) AS o FROM events)"""
)
def b27_bar_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.format_string("loading\n %d%%|##  |\r%d%%|### |\nnone\r 99%%|####", F.col("event_id") % 90, F.col("event_id") % 90 + 5)
    return A.table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(P.bar_percents(output), lambda x: x.cast("string")), ",").alias("percents"))


NOW = "2024-01-20 12:00:00"


@query(
    f"""SELECT event_id, CASE WHEN d < 60000 THEN 'just now' WHEN d < 3600000 THEN printf('%dm ago', d // 60000) WHEN d < 86400000 THEN printf('%dh ago', d // 3600000)
    ELSE strftime(ts, '%Y-%m-%d') END AS age FROM (SELECT event_id, ts, epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts) AS d FROM events)"""
)
def b28_age_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", P.age_label(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp")).alias("age"))


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Name ' || page_id ELSE coalesce(nullif(string_split(url, '/')[-1], ''), 'Untitled Project') END AS shown FROM pages"""
)
def b29_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Name "), F.col("page_id"))).otherwise(" ")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.replace("url", F.lit("/"), F.lit("\\")), F.lit(".LUSK"))).otherwise(F.col("url"))
    return rows.select("page_id", T.display_name(name, path).alias("shown"))


@query(
    """SELECT id, r AS ratio, coalesce(r < 1, false) AS portrait, 1920.0::DOUBLE * coalesce(r, 16::DOUBLE / 9) / 1080 * 100 AS width_percent
    FROM (SELECT id, CASE WHEN w > 0 AND h > 0 THEN w / h END AS r FROM (SELECT event_id AS id, event_id % 1920 AS w, event_id % 7 * 200 AS h FROM events))"""
)
def b30_aspect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = C.aspect_ratio(F.col("id") % 1920, F.col("id") % 7 * 200)
    return A.marks(spark, sf_dir).select("id", ratio.alias("ratio"), C.is_portrait(ratio).alias("portrait"), C.width_percent(ratio).alias("width_percent"))


@query(sql("marks", "SELECT id, CASE WHEN id % 400 >= 376 THEN greatest(0.0::DOUBLE, 1 - (id % 400 - 376) / 24) ELSE 1.0::DOUBLE END AS volume FROM marks"))
def b31_audio_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.marks(spark, sf_dir).select("id", C.fade(F.col("id") % 400, F.lit(400), F.lit(23.976)).alias("volume"))


#: The words of a whole text; a row less or more than there are words for every third one, to be cut off or filled up.
_FOUND = f"regexp_extract_all(text, '{T.SPACE}*[^{T.SPACE[1:-1]}]+')"
_WIDE = f"greatest(len({_FOUND}) + doc_id % 3 - 1, 0)"
TOKENS = f"list_concat({_FOUND}, [''])[1:{_WIDE}]"


def _wide() -> Column:
    words = F.regexp_extract_all("text", F.lit(T.WORD), F.lit(1))
    return F.greatest(F.size(words) + F.col("doc_id") % 3 - 1, F.lit(0))


@query(f"SELECT doc_id, array_to_string({TOKENS}, '|') AS tokens FROM documents")
def b32_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = dealt(A.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return texts.select("doc_id", F.array_join(T.tokens("text", _wide()), "|").alias("tokens"))


@query(
    f"""SELECT doc_id, array_to_string([CAST(i + 99 AS VARCHAR) || '=' || b[i] for i in range(1, len(a) + 1) if a[i] <> b[i]], '|') AS edits
    FROM (SELECT doc_id, {TOKENS} AS a, {TOKENS.replace('text', "replace(text, 'e', 'E')")} AS b FROM documents)"""
)
def b33_caption_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = T.tokens("text", _wide()), T.tokens(F.replace("text", F.lit("e"), F.lit("E")), _wide())
    texts = dealt(A.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")  # the file may be one split
    rows = texts.select("doc_id", old.alias("a"), new.alias("b"))
    edits = F.map_entries(T.caption_edits("a", "b", F.lit(100)))
    return rows.select("doc_id", F.array_join(F.transform(edits, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("edits"))


FONT_ROWS = ", ".join(f"('{k}', {v})" for k, v in FONTS.items())


@query(
    f"""WITH f AS (SELECT name, weights, row_number() OVER (ORDER BY name) - 1 AS n FROM (VALUES {FONT_ROWS}) AS v(name, weights)),
    e AS (SELECT event_id, CAST(350 + event_id % 13 * 50 AS INTEGER) AS wanted, event_id // 13 % {len(FONTS)} AS n FROM events)
    SELECT event_id, name, wanted, (list_min([{{'d': abs(w - wanted), 'i': i, 'w': w}} for w, i in weights])).w AS weight FROM e JOIN f USING (n)"""
)
def b34_nearest_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A font and a wanted weight for each event."""
    n = F.col("event_id")
    names = F.array(*map(F.lit, sorted(FONTS)))
    rows = A.table(spark, sf_dir, "events").select("event_id", (350 + n % 13 * 50).cast("int").alias("wanted"), F.get(names, F.floor(n / 13) % len(FONTS)).alias("name"))
    found = rows.join(F.broadcast(fonts(spark)), "name")  # a fixed table
    return found.select("event_id", "name", "wanted", C.nearest_weight("weights", "wanted").alias("weight"))


MESSAGES = ("Got 503 from server", "status UNAVAILABLE", "429 too many", "RESOURCE_EXHAUSTED", "Chunk validation failed", "Chunk 1/2 row mismatch: expected 250, got 3.", "other")


@query(
    f"""SELECT event_id, message, regexp_matches(message, '503|429|UNAVAILABLE|RESOURCE_EXHAUSTED') AS retryable, contains(message, 'row mismatch') AS mismatch,
    CASE WHEN regexp_matches(message, '503|UNAVAILABLE') THEN 'overloaded' WHEN contains(message, 'Chunk validation') THEN 'row_count' ELSE 'other' END AS kind
    FROM (SELECT event_id, {list(MESSAGES)}[event_id % 7 + 1] AS message FROM events)"""
)
def b35_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.get(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 7).cast("int"))
    rows = A.table(spark, sf_dir, "events").select("event_id", message.alias("message"))
    return rows.withColumns({"retryable": P.is_retryable("message"), "mismatch": P.is_row_mismatch("message"), "kind": P.failure_kind("message")})


_STATES, _VIEWS = ["IDLE", "UPLOADING", "TRANSCRIBING", "ALIGNING", "READY"], ["clips", "review"]


@query(
    f"""SELECT event_id, state, view, step, CASE WHEN s < a THEN 'done' WHEN s = a THEN 'active' ELSE 'pending' END AS status FROM (
    SELECT *, coalesce(list_position({STEPS}, step), 0) AS s, coalesce(list_position({STEPS}, CASE WHEN state = 'READY' THEN CASE view WHEN 'clips' THEN 'CLIPS' ELSE 'REVIEW' END ELSE state END), 0) AS a
    FROM (SELECT event_id, {_STATES}[event_id % 5 + 1] AS state, {_VIEWS}[event_id // 5 % 2 + 1] AS view, {STEPS}[event_id // 10 % {len(STEPS)} + 1] AS step FROM events))"""
)
def b36_step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state, a view and a step for each event."""
    n, pick = F.col("event_id"), lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    rows = A.table(spark, sf_dir, "events").select("event_id", pick(_STATES, n % 5).alias("state"), pick(_VIEWS, F.floor(n / 5) % 2).alias("view"), pick(STEPS, F.floor(n / 10) % len(STEPS)).alias("step"))
    return rows.withColumn("status", P.step_status("step", P.active_step("state", "view")))


SETTINGS_SQL = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'xx' END AS lang, CASE event_id % 4 WHEN 0 THEN 25.0::DOUBLE WHEN 1 THEN 26.0::DOUBLE END AS fps,
    CASE event_id % 5 WHEN 0 THEN 12.4::DOUBLE WHEN 1 THEN 31.0::DOUBLE WHEN 2 THEN -0.5::DOUBLE WHEN 3 THEN -1.0::DOUBLE END AS overlap FROM events"""


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return A.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 3 == 0, "en").when(n % 3 == 1, "xx").alias("lang"),
        F.when(n % 4 == 0, 25.0).when(n % 4 == 1, 26.0).alias("fps"),
        F.when(n % 5 == 0, 12.4).when(n % 5 == 1, 31.0).when(n % 5 == 2, -0.5).when(n % 5 == 3, -1.0).alias("overlap"),
    )


@query(
    f"SELECT event_id, coalesce(lang, 'sk') AS transcription_language, coalesce(fps, 23.976::DOUBLE) AS fps, coalesce(overlap, 4.0::DOUBLE) AS outro_overlap_frames, true AS outro_enabled FROM ({SETTINGS_SQL})"
)
def b37_settings_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _settings(spark, sf_dir).select("event_id", F.col("lang").alias("transcription_language"), "fps", F.col("overlap").alias("outro_overlap_frames"), F.lit(None).cast("boolean").alias("outro_enabled"))
    return effective_settings(rows)


@query(
    f"""SELECT event_id, CASE WHEN lang IN ('sk', 'cs', 'en') THEN lang ELSE 'cs' END AS lang, CASE WHEN fps IN {tuple(FRAME_RATES)} THEN fps ELSE 30.0::DOUBLE END AS fps,
    CASE WHEN floor(overlap + 0.5) BETWEEN 0 AND 30 THEN CAST(floor(overlap + 0.5) AS BIGINT) ELSE 7 END AS overlap FROM ({SETTINGS_SQL})"""
)
def b38_settings_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settings(spark, sf_dir).select("event_id", P.valid_language("lang", F.lit("cs")).alias("lang"), P.valid_fps("fps", F.lit(30.0)).alias("fps"), P.valid_overlap("overlap", F.lit(7)).alias("overlap"))


@query(
    sql(
        "turn_words",
        """SELECT project_id, CAST(greatest(1, ceil((last_end + 1000) / 1000 * 23.976::DOUBLE)) AS BIGINT) AS n_frames FROM (SELECT project_id, max_by(end_ms, pos) AS last_end FROM turn_words GROUP BY project_id)
        UNION ALL SELECT -1, CAST(ceil(600000 / 1000 * 23.976::DOUBLE) AS BIGINT)""",
    )
)
def b39_preview_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row has no captions and takes the default length."""
    last = A.turns(spark, sf_dir).groupBy("project_id").agg(F.max_by("end_ms", "pos").alias("last_end"))
    last = last.unionByName(spark.sql("select cast(-1 as bigint) as project_id, cast(null as bigint) as last_end"))
    return last.select("project_id", C.preview_frames(F.col("last_end"), F.lit(23.976), F.lit(600_000)).alias("n_frames"))


@query(sql("marks", f"SELECT id, {half_up('(ms - 5000) / 1000')} AS badge, printf('%d.%d', (ms + 50) // 100 // 10, (ms + 50) // 100 % 10) AS tenths FROM marks"))
def b40_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.marks(spark, sf_dir).select("id", C.whole_seconds(F.lit(5000), F.col("ms")).alias("badge"), C.tenth_seconds(F.lit(0).cast("long"), F.col("ms")).alias("tenths"))


@query("SELECT doc_id, line_no, line FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE " + trim("line") + " <> ''")
def c01_nonblank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(~T.is_blank("line"))


@query(
    """SELECT a.event_id, a.old_ms, a.new_ms, coalesce(abs(old_ms - new_ms) <= 500, true) AS same
    FROM (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_id * 10 END AS old_ms, event_id * 10 + event_id % 1000 - 499 AS new_ms FROM events) a"""
)
def c07_same_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = A.table(spark, sf_dir, "events").select("event_id", F.when(n % 7 > 0, n * 10).alias("old_ms"), (n * 10 + n % 1000 - 499).alias("new_ms"))
    return rows.withColumn("same", P.is_same_length("old_ms", "new_ms"))


FILES = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN printf('output_%d-%d.mp4', event_id, event_id + 9) WHEN 1 THEN 'input.MP4' WHEN 2 THEN 'output_x.mp3' WHEN 3 THEN 'a.b.WebM' ELSE 'mov' END AS file FROM events"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    name = F.when(n % 5 == 0, F.format_string("output_%d-%d.mp4", n, n + 9)).when(n % 5 == 1, "input.MP4").when(n % 5 == 2, "output_x.mp3").when(n % 5 == 3, "a.b.WebM").otherwise("mov")
    return A.table(spark, sf_dir, "events").select("event_id", name.alias("file"))


@query(f"SELECT event_id, file, regexp_extract(file, '^output_(.*)\\.mp4$', 1) AS render_key FROM ({FILES}) WHERE file LIKE 'output\\_%.mp4' ESCAPE '\\'")
def c08_rendered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(P.is_rendered_file("file")).withColumn("render_key", P.rendered_key("file"))


@query(f"SELECT event_id, file FROM ({FILES}) WHERE lower(string_split(file, '.')[-1]) IN ('mp4', 'mov', 'mkv', 'avi', 'webm')")
def c09_video_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(P.is_video("file"))


@query("SELECT doc_id, substr(text, 1, 60) AS head, right(text, 500) AS tail, right(text, 2000) AS long_tail FROM documents")
def s03_text_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = lambda n: F.right("text", F.lit(n))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("head"), tail(500).alias("tail"), tail(2000).alias("long_tail"))
