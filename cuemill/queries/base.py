"""Registration, and the SQL that the oracles share: the adapters' tables and common expressions."""

from __future__ import annotations

from collections.abc import Callable

from cuemill.adapters import CUT_MS, REQUESTS
from cuemill.functions.text import SPACE
from cuemill.schema import BREAK_BEFORE, NO_BREAK_BEFORE, TRANSITIONS

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with the SQL that says the same."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# Expressions


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def stamp(ms: str, point: str = ".") -> str:
    return f"printf('%02d:%02d:%02d{point}%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


NUMBER = rf"'^{SPACE}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)'"
WHOLE = rf"'^{SPACE}*([+-]?[0-9]+)'"


def number(x: str, pattern: str = NUMBER) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, {pattern}, 1), '') AS DOUBLE)"


def to_ms(x: str) -> str:
    """Lenient reading of a time."""
    p = lambda i: number(f"string_split({x}, ':')[{i}]")
    return half_up(
        f"(CASE len(string_split({x}, ':')) WHEN 3 THEN {p(1)} * 3600 + {p(2)} * 60 + {p(3)} WHEN 2 THEN {p(1)} * 60 + {p(2)} END) * 1000"
    )


def strict_ms(x: str) -> str:
    p = lambda i: number(f"string_split({trim(x)}, ':')[{i}]")
    w = lambda i: number(f"string_split({trim(x)}, ':')[{i}]", WHOLE)
    return half_up(
        f"(CASE len(string_split({trim(x)}, ':')) WHEN 2 THEN CASE WHEN {w(1)} >= 0 AND {p(2)} >= 0 AND {p(2)} < 60 THEN {w(1)} * 60 + {p(2)} END "
        f"WHEN 3 THEN CASE WHEN {w(1)} >= 0 AND {w(2)} >= 0 AND {w(2)} < 60 AND {p(3)} >= 0 AND {p(3)} < 60 THEN {w(1)} * 3600 + {w(2)} * 60 + {p(3)} END END) * 1000"
    )


def words_in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def is_break(x: str, lang: str = "en") -> str:
    return f"(regexp_replace(lower({x}), '[.,;:!?\"()–—]', '', 'g') IN {words_in(BREAK_BEFORE[lang])})"


def is_bound(x: str, lang: str = "en") -> str:
    return f"(regexp_replace(lower({x}), '[.,;:!?]', '', 'g') IN {words_in(NO_BREAK_BEFORE[lang])})"


def punctuated(x: str) -> str:
    return f"regexp_matches({trim(x)}, '[.,;:!?\"()–—]$')"


def normal(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9]', '', 'g')"


def similar(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} = {b} THEN true WHEN least(length({a}), length({b})) <= 3 THEN false "
        f"ELSE levenshtein({a}, {b}) <= ceil(0.4::DOUBLE * greatest(length({a}), length({b}))) END)"
    )


def wrap(text: str, lang: str = "en") -> str:
    """A text in two lines where a good split exists."""
    w = f"regexp_split_to_array({text}, '{SPACE}+')"
    top = f"length(array_to_string({w}[1:i], ' '))"
    score = f"abs({top} - length({text}) // 2) - CASE WHEN {punctuated(f'{w}[i]')} THEN 20 ELSE 0 END - CASE WHEN {is_break(f'{w}[i + 1]', lang)} THEN 10 ELSE 0 END"
    fits = f"{top} <= 42 AND length({text}) - {top} - 1 <= 42 AND {top} <= length({text}) - {top} - 1 AND NOT {is_bound(f'{w}[i + 1]', lang)}"
    # the least score, and of equal scores the first place
    best = f"(list_min([{{'s': {score}, 'i': i}} for i in range(1, len({w})) if {fits}])).i"
    return f"CASE WHEN length({text}) <= 42 OR {best} IS NULL THEN {text} ELSE array_to_string({w}[1:{best}], ' ') || chr(10) || array_to_string({w}[{best} + 1:], ' ') END"


def may_pass(state: str, new: str) -> str:
    return f"(({state} || '>' || {new}) IN {words_in([f'{a}>{b}' for a, to in TRANSITIONS.items() for b in to])})"


# Tables


def _timed(texts: str, prefix: str) -> dict[str, str]:
    return {
        f"{prefix}t": f"SELECT project_id, list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: w <> '') AS ws FROM ({texts})",
        f"{prefix}w": f"SELECT project_id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos, unnest(ws) AS word FROM {prefix}t",
        f"{prefix}g": f"""SELECT *, length(word) * 60 AS dur, CASE WHEN regexp_matches(word, '[.!?]$') THEN 1200 WHEN regexp_matches(word, '[,;:]$') THEN 300 ELSE 40 END AS gap
            FROM {prefix}w""",
        f"{prefix}words": f"""SELECT project_id, pos, word, end_ms - dur AS start_ms, end_ms FROM (
            SELECT *, CAST(sum(dur + gap) OVER (PARTITION BY project_id ORDER BY pos) - gap AS BIGINT) AS end_ms FROM {prefix}g)""",
    }


CTES = (
    _timed("SELECT doc_id AS project_id, text FROM documents", "")
    | _timed("SELECT conv_id AS project_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id", "turn_")
    | {
        "captions": "SELECT project_id, pos, CASE WHEN pos = 0 THEN word ELSE ' ' || word END AS text, start_ms, end_ms, start_ms AS timestamp_ms FROM words",
        "turn_captions": "SELECT project_id, pos, CASE WHEN pos = 0 THEN word ELSE ' ' || word END AS text, start_ms, end_ms, start_ms AS timestamp_ms FROM turn_words",
        "ends": "SELECT project_id, max_by(end_ms, pos) AS transcript_end, CAST(count(*) AS INTEGER) AS n FROM words GROUP BY project_id",
        "clips": f"""SELECT project_id, CAST(pos AS INTEGER) AS pos, printf('doc-%d-%d', project_id, pos) AS title, pos * {CUT_MS} AS start_ms, (pos + 1) * {CUT_MS} AS end_ms,
            printf('hook %d', pos) AS hook_text, CASE WHEN pos % 4 = 1 THEN 50 END AS caption_offset, CASE WHEN pos % 3 > 0 THEN 0 END AS trim_start_delta,
            CASE WHEN pos % 3 > 0 THEN 0 END AS trim_end_delta FROM (SELECT project_id, unnest(range(0, transcript_end // {CUT_MS} + 1)) AS pos FROM ends)""",
        "laid": """SELECT *, CAST(range_start AS VARCHAR) || '-' || CAST(range_end AS VARCHAR) AS render_key,
            floor(range_start / 1000 * 23.976::DOUBLE + 0.5) / 23.976::DOUBLE * 1000 AS snapped_ms
            FROM (SELECT *, start_ms + coalesce(trim_start_delta, 0) AS range_start, end_ms + coalesce(trim_end_delta, 900) AS range_end FROM clips)""",
        "renders": "SELECT project_id, render_key, CASE pos % 3 WHEN 0 THEN 'exported' ELSE 'rendering' END AS status FROM laid WHERE pos % 3 < 2",
        "spans": """SELECT project_id, n, k FROM (SELECT project_id, n, CASE WHEN n <= 250 THEN 1
            WHEN n - ((CAST(ceil((n - 250) / 220) AS INTEGER) - 1) * 220 + 250) < 30 THEN CAST(ceil((n - 250) / 220) AS INTEGER) ELSE CAST(ceil((n - 250) / 220) AS INTEGER) + 1 END AS k FROM ends)""",
        "chunks": """SELECT project_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * 220 AS INTEGER) AS start_idx, CAST(CASE WHEN i = k - 1 THEN n ELSE i * 220 + 250 END AS INTEGER) AS end_idx, i = 0 AS is_first
            FROM (SELECT *, unnest(range(0, k)) AS i FROM spans)""",
        "chunk_rows": """SELECT w.project_id, chunk_no, pos - start_idx AS row_no, pos, start_ms, word FROM words w JOIN chunks c ON w.project_id = c.project_id AND pos >= start_idx AND pos < end_idx""",
        "answers": """SELECT project_id, chunk_no, CAST(row_number() OVER (PARTITION BY project_id, chunk_no ORDER BY row_no) - 1 AS INTEGER) AS row_no,
            CASE WHEN row_no % 5 = 4 THEN word || 's' ELSE word END AS word FROM chunk_rows WHERE chunk_no % 4 = 3 OR row_no % 11 <> 10""",
        "marks": "SELECT event_id AS id, event_id * 7919013 % 400000000 AS ms, value AS seconds FROM events",
        "time_texts": f"""SELECT id, CASE id % 10 WHEN 0 THEN {stamp("ms")} WHEN 1 THEN printf('%d:%02d', ms // 60000, ms // 1000 % 60) WHEN 2 THEN {stamp("ms", ",")} WHEN 3 THEN 'abc'
            WHEN 4 THEN printf('%d.5', id) WHEN 5 THEN '-3:10' WHEN 6 THEN '1:75' WHEN 7 THEN '1:2:3:4' WHEN 8 THEN ' 2:03.25xyz ' ELSE 'x:10' END AS text FROM marks""",
        "vocabulary": "SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: w <> '')) AS word FROM documents",
        "requests": "SELECT user_id AS session_id, ts, event_id, CASE event_type "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REQUESTS.items())
        + " END AS new_state, value - 20 AS progress FROM events",
        "registry": """SELECT printf('p%d', event_id // 3) AS project_id, printf('/home/u/%d.lusk', event_id // 3) AS project_path,
            CASE WHEN event_id // 3 % 3 > 0 THEN printf('Video %d', event_id // 3) END AS video_name, 'READY' AS state, printf('t%d', event_id) AS updated_at,
            CASE WHEN event_id // 3 % 4 > 0 THEN 'picture' END AS thumbnail, ts, event_id AS entry_no FROM events""",
    }
)
_NEEDS = {
    "turn_w": ["turn_t"], "turn_g": ["turn_w"], "turn_words": ["turn_g"], "w": ["t"], "g": ["w"], "words": ["g"], "captions": ["words"], "turn_captions": ["turn_words"],
    "ends": ["words"], "clips": ["ends"], "laid": ["clips"], "renders": ["laid"], "spans": ["ends"], "chunks": ["spans"], "chunk_rows": ["words", "chunks"],
    "answers": ["chunk_rows"], "time_texts": ["marks"],
}


def sql(tables: str, body: str, **more: str) -> str:
    """``body`` behind the CTEs that the named tables need; ``more`` are the query's own, in order."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in tables.split():
        need(name)
    parts = [f"{n} AS MATERIALIZED ({x})" for n, x in [*((n, CTES[n]) for n in order), *more.items()]]
    return f"WITH {', '.join(parts)} {body}" if parts else body
