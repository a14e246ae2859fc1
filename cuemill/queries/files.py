"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill import adapters as A
from cuemill.functions.progress import DEFAULTS
from cuemill.functions.timecode import probed_duration_ms, probed_size
from cuemill.operators import projects as P
from cuemill.operators.ordered import recent
from cuemill.operators.prefix import numbered
from cuemill.queries.base import half_up, query, sql, stamp, to_ms, trim
from cuemill.queries.windows import TOP
from cuemill.schema import ASR, PROJECT
from cuemill.session import shards_of, work_dir
from cuemill.sources import archives, cliptext, documents, stores, transcripts
from cuemill.sources.lines import percent, read_lines
from cuemill.sources.zips import read_pieces, sharded, write_pieces
from cuemill.streaming.progress import drained


def _literal(name: str) -> str:
    """A default setting as SQL."""
    value = DEFAULTS[name]
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else f"{value}::DOUBLE" if isinstance(value, (int, float)) else f"'{value}'"


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, project): a document for each conversation, with its words."""
    words = A.turns(spark, sf_dir)
    rows = F.sort_array(F.collect_list(F.struct("pos", F.struct("word", F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs")).alias("w"))))
    docs = words.groupBy("project_id").agg(F.transform(rows, lambda x: x["w"]).alias("words"))
    n = F.col("project_id")
    video = F.when(n % 2 == 0, F.concat(F.lit("/media/"), n, F.lit(".mp4"))).otherwise(F.concat(F.lit("/projects/clips/"), n, F.lit(".mp4")))
    made = {
        "version": F.lit(1), "projectId": n.cast("string"), "state": F.when(n % 3 == 0, "TRANSCRIBING").when(n % 3 == 1, "ALIGNING").otherwise("READY"),
        "videoPath": video, "transcript": F.struct(F.lit("").alias("text"), F.col("words")),
    }
    fields = [made[f.name].cast(f.dataType).alias(f.name) if f.name in made else F.lit(None).cast(f.dataType).alias(f.name) for f in PROJECT.fields]
    return docs.select(F.concat(F.lit("/projects/"), n, F.lit(".lusk")).alias("path"), F.struct(*fields).alias("project"))


_SAVED = """SELECT CAST(project_id AS VARCHAR) AS project_id, CASE WHEN project_id % 2 = 0 THEN '/media/' ELSE '/projects/clips/' END || project_id || '.mp4' AS video_path, count(*) AS n_words,
    string_agg(word, ' ' ORDER BY pos) AS text, max(end_ms) AS last_end FROM turn_words GROUP BY project_id"""


def _read_back(read: DataFrame) -> DataFrame:
    words = F.col("project.transcript.words")
    return read.select(
        F.col("project.projectId").alias("project_id"),
        F.col("project.videoPath").alias("video_path"),
        F.size(words).cast("long").alias("n_words"),
        F.array_join(F.transform(words, lambda w: w["word"]), " ").alias("text"),
        F.array_max(F.transform(words, lambda w: w["endMs"])).alias("last_end"),
    )


@query(sql("turn_words", _SAVED))
def a02_archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives made and read again, as bytes."""
    return _read_back(archives.parse_archives(archives.archive_files(_projects(spark, sf_dir))))


@query(sql("turn_words", f"SELECT project_id, n_words, text, last_end FROM ({_SAVED})"))
def a01_read_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written to a folder and read from it; paths depend on the folder and are left out."""
    folder = work_dir(spark, "archives")
    archives.write_archives(_projects(spark, sf_dir), folder)
    return _read_back(archives.read_archives(spark, folder)).drop("video_path")


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS project_id, CASE WHEN conv_id % 2 = 0 THEN 'IDLE' WHEN conv_id % 3 = 0 THEN 'UPLOADING' WHEN conv_id % 3 = 1 THEN 'ALIGNING' ELSE 'READY' END AS state,
    CASE WHEN conv_id % 2 = 1 AND conv_id % 3 = 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS progress, conv_id % 2 = 0 AS missing_video FROM conversations GROUP BY conv_id"""
)
def a01_opened_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects as opened; the videos of every second one are there."""
    rows = _projects(spark, sf_dir).select("project.projectId", "project.state", "project.videoPath").toDF("project_id", "state", "video_path")
    return P.opened(rows, rows.where("cast(project_id as bigint) % 2 = 1"))


@query(sql("registry", f"SELECT project_id, project_path, video_name, updated_at, CAST(rank - 1 AS INTEGER) AS entry_no FROM ({TOP})"))
def a03_registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry written as JSON and read again; broken and foreign texts give no entries."""
    top = recent(A.registry(spark, sf_dir)).withColumn("missing", F.lit(False))
    text = stores.registry_text(top).unionByName(spark.createDataFrame([("{}",), ("[{",), ("",)], "value string"))
    rows = text.select(F.posexplode(stores.parse_registry("value")).alias("entry_no", "e"))
    return rows.where("e.project_id is not null").select("e.project_id", "e.project_path", "e.video_name", "e.updated_at", "entry_no")


@query(
    f"""SELECT CASE WHEN event_id % 3 = 0 THEN 'en' ELSE {_literal('transcription_language')} END AS transcription_language, CASE WHEN event_id % 4 = 0 THEN 25.0::DOUBLE ELSE {_literal('fps')} END AS fps,
    {_literal('outro_overlap_frames')} AS outro_overlap_frames, CASE WHEN event_id % 2 = 0 THEN false ELSE {_literal('outro_enabled')} END AS outro_enabled, 'prompt ' || event_id AS correction_prompt FROM events"""
)
def a04_settings_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse settings, one for each event, written, read, and filled up with defaults."""
    path, n = work_dir(spark, "settings"), F.col("event_id")
    rows = A.table(spark, sf_dir, "events").select(
        F.when(n % 3 == 0, "en").alias("transcription_language"), F.when(n % 4 == 0, 25.0).alias("fps"), F.when(n % 2 == 0, False).alias("outro_enabled"), F.concat(F.lit("prompt "), n).alias("correction_prompt")
    )
    rows.write.json(path)  # what is null is left out
    return stores.effective_settings(stores.read_settings(spark, path, lines=True)).select("transcription_language", "fps", "outro_overlap_frames", "outro_enabled", "correction_prompt")


@query(
    """SELECT conv_id, CASE WHEN k <> 4 THEN CASE WHEN k = 3 THEN 2 ELSE 1 END END AS version, CASE WHEN k <> 4 THEN CAST(conv_id AS VARCHAR) END AS project_id,
              CASE WHEN k NOT IN (4, 5) THEN 'READY' END AS state, CASE WHEN k NOT IN (2, 4) THEN n * 1000 END AS duration_ms, CASE WHEN k IN (0, 1, 2, 5) THEN n END AS n_captions,
              CASE k WHEN 2 THEN 'videoDurationMs: BIGINT expected, STRING found' WHEN 3 THEN 'captions: ARRAY expected, OBJECT found;version 2 is not known'
                     WHEN 4 THEN 'no JSON object' WHEN 5 THEN 'state: STRING expected, ARRAY found' ELSE '' END AS errors, CASE k WHEN 2 THEN 'author,theme' ELSE '' END AS unknown
    FROM (SELECT conv_id, conv_id % 6 AS k, count(*) AS n FROM conversations GROUP BY conv_id)"""
)
def a01_unchecked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of odd types, of a version that is not known, with unknown fields, and cut short."""
    k, text = F.col("conv_id") % 6, F.to_json(F.struct("text"))
    turns = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(text)), ",").alias("captions"))
    pick = lambda usual, **odd: F.coalesce(*[F.when(k == int(n[1:]), v) for n, v in odd.items()], usual)
    json = F.concat(
        F.lit('{"version": '), pick(F.lit("1"), k1=F.lit('"1"'), k3=F.lit("2")), F.lit(', "projectId": '), pick(F.format_string('"%d"', "conv_id"), k1=F.col("conv_id").cast("string")),
        F.lit(', "state": '), pick(F.lit('"READY"'), k5=F.lit('["READY"]')), F.lit(', "videoDurationMs": '), pick((F.col("n") * 1000).cast("string"), k1=F.format_string('"%d"', F.col("n") * 1000), k2=F.lit('"soon"')),
        F.lit(', "captions": '), pick(F.concat(F.lit("["), "captions", F.lit("]")), k3=F.lit("{}")), F.lit(', "videoName": null'), pick(F.lit(""), k2=F.lit(', "theme": 1, "author": {}')), pick(F.lit("}"), k4=F.lit("")),
    )
    read = documents.read_documents(turns.select("conv_id", json.alias("json")))
    p = F.col("project")
    return read.select(
        "conv_id", p["version"].alias("version"), p["projectId"].alias("project_id"), p["state"].alias("state"), p["videoDurationMs"].alias("duration_ms"),
        F.when(p["captions"].isNotNull(), F.size(p["captions"])).cast("long").alias("n_captions"), F.array_join("errors", ";").alias("errors"), F.array_join("unknown", ",").alias("unknown"),
    )


def _asr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, json): words in segments of ten, in seconds; some without times or with blanks; every fifth segment without words."""
    rows = A.turns(spark, sf_dir).withColumn("seg", F.floor(F.col("pos") / 10).cast("int"))
    blank, none = F.col("pos") % 11 == 3, F.lit(None).cast("double")
    word = F.struct(
        F.concat(F.lit(" "), "word").alias("word"), F.when(blank, none).otherwise(F.col("start_ms") / 1000).alias("start"), F.when(blank, none).otherwise(F.col("end_ms") / 1000).alias("end"),
        F.lit(0.5).alias("score"),
    )
    segs = rows.groupBy("project_id", "seg").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.sort_array(F.collect_list(F.struct("pos", word.alias("w")))).alias("ws"))
    words = F.when(F.col("seg") % 5 == 4, F.array().cast(ASR["segments"].dataType.elementType["words"].dataType)).otherwise(F.transform("ws", lambda x: x["w"]))
    seg = F.struct((F.col("s") / 1000).alias("start"), (F.col("e") / 1000).alias("end"), F.lit("").alias("text"), words.alias("words"))
    docs = segs.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seg", seg.alias("x")))), lambda r: r["x"]).alias("segments"))
    return docs.select("project_id", F.to_json(F.struct("segments")).alias("json"))


@query(
    sql(
        "turn_words",
        """SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY pos) - 1 AS INTEGER) AS pos, word, CASE WHEN pos % 11 = 3 THEN s ELSE start_ms END AS start_ms,
        CASE WHEN pos % 11 = 3 THEN e ELSE end_ms END AS end_ms
        FROM (SELECT *, min(start_ms) OVER (PARTITION BY project_id, pos // 10) AS s, max(end_ms) OVER (PARTITION BY project_id, pos // 10) AS e FROM turn_words) WHERE pos // 10 % 5 <> 4""",
    )
)
def a05_asr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _asr(spark, sf_dir).select("project_id", F.from_json("json", ASR)["segments"].alias("segments"))
    return transcripts.asr_words(parsed)


@query(sql("words", f"SELECT project_id, string_agg({stamp('start_ms')} || chr(9) || word, chr(10) ORDER BY pos) AS tsv FROM words GROUP BY project_id"))
def a06_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.tsv_texts(A.words(spark, sf_dir))


#: A line as it stands in a text that people have edited: good, abbreviated, with commas, blank, without a word, without a time, with a second tab.
_LINE = f"""CASE pos % 13 WHEN 4 THEN '' WHEN 5 THEN printf('%02d:%02d.%03d', start_ms // 60000, start_ms // 1000 % 60, start_ms % 1000) || chr(9) || word
    WHEN 6 THEN {stamp('start_ms', ',')} || chr(9) || word WHEN 7 THEN {stamp('start_ms')} || chr(9) || ' ' WHEN 8 THEN chr(9) || word WHEN 9 THEN word
    WHEN 10 THEN {stamp('start_ms')} || chr(9) || word || chr(9) || 'x' WHEN 11 THEN '1:2:3:4' || chr(9) || word ELSE {stamp('start_ms')} || chr(9) || word END"""


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, tsv) of such lines."""
    pos, ms, word = F.col("pos") % 13, F.col("start_ms"), F.col("word")
    line, tab = transcripts.tsv_line(), F.lit("\t")
    short = F.format_string("%02d:%02d.%03d", F.expr("start_ms div 60000"), F.expr("start_ms div 1000 % 60"), ms % 1000)
    text = F.when(pos == 4, "").when(pos == 5, F.concat(short, tab, word)).when(pos == 6, F.concat(F.regexp_replace(F.substring_index(line, "\t", 1), r"\.", ","), tab, word))
    text = text.when(pos == 7, F.concat(F.substring_index(line, "\t", 1), tab, F.lit(" "))).when(pos == 8, F.concat(tab, word)).when(pos == 9, word)
    text = text.when(pos == 10, F.concat(line, tab, F.lit("x"))).when(pos == 11, F.concat(F.lit("1:2:3:4\t"), word)).otherwise(line)
    rows = A.turns(spark, sf_dir).withColumn("line", text)
    return rows.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("tsv"))


@query(
    sql(
        "turn_words",
        f"""SELECT project_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, word, start_ms, lead(start_ms, 1, 77) OVER w AS end_ms, malformed FROM (
            SELECT project_id, n, {trim("substr(line, strpos(line, chr(9)) + 1)")} AS word, {to_ms(trim("split_part(line, chr(9), 1)"))} AS start_ms, len(string_split(split_part(line, chr(9), 1), ':')) NOT IN (2, 3) AS malformed
            FROM lines WHERE {trim('line')} <> '' AND strpos(line, chr(9)) > 0 AND split_part(line, chr(9), 1) <> '' AND {trim("substr(line, strpos(line, chr(9)) + 1)")} <> '')
        WINDOW w AS (PARTITION BY project_id ORDER BY n)""",
        texts=f"SELECT project_id, string_agg({_LINE}, chr(10) ORDER BY pos) AS tsv FROM turn_words GROUP BY project_id",
        lines=f"SELECT project_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT project_id, string_split({trim('tsv')}, chr(10)) AS l FROM texts)",
    )
)
def a07_parse_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited texts."""
    return transcripts.parse_tsv(_edited(spark, sf_dir), F.lit(77).cast("long"))


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, clip_text): clips in the forms that models use, good and bad."""
    rows, at = A.clips(spark, sf_dir), F.col("pos") % 6
    t = lambda c: transcripts.ms_to_timestamp(c)
    start, end = t("start_ms"), t("end_ms")
    head = F.concat(F.when(at == 5, "clip  ").otherwise("CLIP "), F.col("pos") + 1, F.lit("\n"))
    body = F.when(at == 0, F.format_string("Title: %s\nHook: %s\nStart: %s\nEnd: %s", "title", "hook_text", start, end))
    body = body.when(at == 1, F.format_string("Title: %s\n Cut 1: %s - %s\nCut 2: 00:00:01.000 - 00:00:02.000", "title", start, end))
    body = body.when(at == 2, F.format_string("Subtitle: %s \nSegment 1: %s → %s", "title", start, end)).when(at == 3, F.format_string("Title: bad\nStart: %s\nEnd: %s", end, start))
    body = body.when(at == 4, F.format_string("title: both\nCut 1: %s – %s\nStart: %s\nEnd: %s", end, start, start, end)).otherwise(F.format_string("Hook: only\nStart: %s\nEnd: 1:2:3:4:5", start))
    made = rows.withColumn("b", F.concat(head, body))
    texts = made.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "\n\n").alias("clip_text"))
    return texts.withColumn("clip_text", F.when(F.col("project_id") % 4 == 0, F.concat(F.lit("Title: before\nStart: 0:01\nEnd: 0:02\n"), "clip_text")).otherwise(F.col("clip_text")))


@query(
    sql(
        "clips",
        """SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY n) - 1 AS INTEGER) AS pos, title, start_ms, end_ms, hook_text FROM (
            SELECT project_id, pos AS n, CASE pos % 6 WHEN 4 THEN 'both' ELSE title END AS title, start_ms, end_ms, CASE pos % 6 WHEN 0 THEN hook_text ELSE '' END AS hook_text FROM clips WHERE pos % 6 NOT IN (3, 5)
            UNION ALL SELECT DISTINCT project_id, -1, 'before', 1000, 2000, '' FROM clips WHERE project_id % 4 = 0)""",
    )
)
def a08_parse_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text before the first head is a clip too; clips without a range are not."""
    return cliptext.parse_clips(_suggestions(spark, sf_dir))


@query(
    sql(
        "clips",
        f"""SELECT project_id, string_agg(printf('CLIP %d', pos + 1) || chr(10) || 'Title: ' || title || chr(10) || 'Hook: ' || hook_text || chr(10) || 'Start: ' || {stamp('start_ms')} || chr(10) || 'End: ' || {stamp('end_ms')},
        chr(10) || chr(10) ORDER BY pos) AS clip_text FROM clips GROUP BY project_id""",
    )
)
def a09_clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cliptext.clip_texts(A.clips(spark, sf_dir))


@query(sql("words", f"SELECT project_id, CAST(pos // 2000 + 1 AS INTEGER) AS part, count(*) AS n_lines, string_agg({stamp('start_ms')} || chr(9) || word, chr(10) ORDER BY pos) AS tsv FROM words GROUP BY project_id, pos // 2000"))
def a12_tsv_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.tsv_parts(A.words(spark, sf_dir))


@query(
    sql(
        "words",
        """SELECT project_id, 'transcription_part_' || part || '.tsv' AS entry, strlen(tsv) AS n_bytes, md5(tsv) AS md5 FROM n WHERE n > 1
        UNION ALL SELECT project_id, CASE WHEN n > 1 THEN 'transcription_full.tsv' ELSE 'transcription.tsv' END AS entry, strlen(tsv) AS n_bytes, md5(tsv) AS md5
        FROM (SELECT project_id, max(n) AS n, string_agg(tsv, chr(10) ORDER BY part) AS tsv FROM n GROUP BY project_id)""",
        p=f"SELECT project_id, pos // 2000 + 1 AS part, string_agg({stamp('start_ms')} || chr(9) || word, chr(10) ORDER BY pos) AS tsv FROM words GROUP BY project_id, pos // 2000",
        n="SELECT *, max(part) OVER (PARTITION BY project_id) AS n FROM p",
    )
)
def a12_download_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads written and read again: plain files, and archives of the whole text and its parts."""
    folder = work_dir(spark, "downloads")
    words = A.words(spark, sf_dir)
    write_pieces(sharded(transcripts.download_pieces(words), shards_of(words)), folder, F.substring_index("path", "/", 1))
    pieces = read_pieces(spark, folder, piece=1 << 16, plain=".tsv").select("path", F.coalesce("entry", F.lit("transcription.tsv")).alias("entry"), "piece", "content")
    whole = pieces.groupBy("path", "entry").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "content"))), lambda x: F.hex(x["content"])), "")).alias("text"))
    return whole.select(F.regexp_extract("path", r"([0-9]+)/[^/]*$", 1).cast("long").alias("project_id"), "entry", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("md5"))


_PIECE_BYTES, _SHARDS = 4096, 16


@query(
    f"""WITH e AS (SELECT user_id % {_SHARDS} AS shard, ts, event_id, CAST(event_id % 101 AS INTEGER) AS pct, event_id % 3 AS kind FROM events)
    SELECT printf('p%d', shard) AS process, event_id, CASE WHEN kind = 0 THEN NULL ELSE CAST(10 + floor(pct * 0.8::DOUBLE + 0.5) AS INTEGER) END AS percent FROM e"""
)
def i09_framed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines of processes, written in chunks that cut them anywhere and read by a stream in two runs."""
    n, folder = F.col("event_id"), work_dir(spark, "lines")
    bar = F.when(n % 3 == 0, F.format_string("event %d of é\n", n)).otherwise(F.format_string("%3d%%|####| %d\r", (n % 101).cast("int"), n))
    rows = A.table(spark, sf_dir, "events").select(F.format_string("p%d", F.col("user_id") % _SHARDS).alias("process"), "ts", "event_id", bar.cast("binary").alias("line"))
    rows = numbered(rows, ["process"], ["ts", "event_id"], sums={"at": F.octet_length("line")})
    # each line's bytes in the chunks that they fall into
    first, last = F.floor(F.col("at") / _PIECE_BYTES), F.floor((F.col("at") + F.octet_length("line") - 1) / _PIECE_BYTES)
    cut = rows.withColumn("chunk", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("chunk") * _PIECE_BYTES - F.col("at"), F.lit(0))
    piece = F.substring("line", (start + 1).cast("int"), F.least((F.col("chunk") + 1) * _PIECE_BYTES - F.col("at"), F.octet_length("line")).cast("int") - start.cast("int"))
    pieces = cut.select(F.format_string("%s/%08d", "process", "chunk").alias("path"), "chunk", F.lit(0).alias("entry_no"), F.lit(None).cast("string").alias("entry"), F.col("at").alias("piece"), piece.alias("content"))
    for early in (True, False):
        write_pieces(pieces.where((F.col("chunk") < 2) == early), f"{folder}/in")
        drained(read_lines(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/log")
    lines = spark.read.schema("process string, offset long, line string").parquet(f"{folder}/out")
    return lines.select("process", F.regexp_extract("line", "([0-9]+)( of é)?$", 1).cast("long").alias("event_id"), percent("line").alias("percent"))


@query(sql("turn_words", f"SELECT project_id, pos, word, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY project_id ORDER BY pos), 0) AS end_ms FROM turn_words"))
def a07_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TSV files, one a project, written and read again."""
    folder = work_dir(spark, "tsv")
    words = A.turns(spark, sf_dir)
    write_pieces(sharded(transcripts.tsv_pieces(words, 1_000_000), shards_of(words)), folder, F.substring_index("path", "/", 1))
    part = F.regexp_extract("path", r"([0-9]+)\.tsv$", 1).cast("long")
    pieces = read_pieces(spark, folder, plain=".tsv").select(F.regexp_extract("path", "([0-9]+)/[^/]*$", 1).cast("long").alias("project_id"), F.struct(part.alias("part"), "piece", F.hex("content").alias("x")).alias("p"))
    # pieces may end inside a character, so bytes are joined first; parts are joined by a new line
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: F.when((p["part"] > 1) & (p["piece"] == 0), F.concat(F.lit("0A"), p["x"])).otherwise(p["x"])), "")
    texts = pieces.groupBy("project_id").agg(F.unhex(whole).cast("string").alias("tsv"))
    rows = transcripts.parse_tsv(texts, F.lit(0).cast("long"))
    return rows.drop("malformed")


@query("SELECT folder, count(*) AS n_files FROM (SELECT printf('project_id=%d', conv_id) AS folder FROM conversations GROUP BY conv_id) GROUP BY folder")
def a15_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a write left, by folder."""
    folder = work_dir(spark, "listing")
    transcripts.tsv_texts(A.turns(spark, sf_dir)).repartition("project_id").write.partitionBy("project_id").text(folder)
    return stores.list_files(spark, folder, "*.txt").groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))


@query(
    f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {half_up("value * 1000")} WHEN event_id % 3 = 1 AND event_id % 60 + event_id // 60 % 60 + event_id % 24 > 0
    THEN ((event_id % 24) * 3600 + (event_id // 60 % 60) * 60 + event_id % 60) * 1000 + 250 END AS duration_ms,
    CASE WHEN event_id % 3 < 2 THEN 640 + CAST(event_id % 1000 AS INTEGER) END AS width, CASE WHEN event_id % 3 < 2 THEN 480 + CAST(event_id % 500 AS INTEGER) END AS height FROM events"""
)
def a16_probe_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and sizes from a probe's JSON, else from a log."""
    n = F.col("event_id")
    at, w, h = n % 3, 640 + n % 1000, 480 + n % 500
    info = F.when(at == 0, F.format_string('{"format": {"duration": "%s"}, "streams": [{"width": %d, "height": %d}]}', F.col("value").cast("string"), w, h)).otherwise("{}")
    log = F.when(
        at == 1,
        F.format_string("Input #0\n  Duration: %02d:%02d:%02d.25, start: 0\n  Stream #0:0: Video: h264, yuv420p, %dx%d, 25 fps", n % 24, F.floor(n / 60) % 60, n % 60, w, h),
    ).otherwise("nothing")
    rows = A.table(spark, sf_dir, "events").select("event_id", info.alias("info"), log.alias("log"))
    width, height = probed_size("info", "log")
    return rows.select("event_id", probed_duration_ms("info", "log").alias("duration_ms"), width.alias("width"), height.alias("height"))
