"""Column functions on words, names and messages."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.schema import BREAK_BEFORE, NO_BREAK_BEFORE

#: White space as scripts in a browser know it; written so that Java and RE2 read it alike.
SPACE = r"[\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same signs as a class that Java looks up in its table of categories, an order of magnitude faster, and one by one.
SPACE_CLASS = r"[\s\p{Z}\x{FEFF}]"
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: A word with the white space before it.
WORD = f"({SPACE_CLASS}*[^{SPACE_CLASS[1:-1]}]+)"
#: Ends of a word after which a line may break.
PUNCTUATION_SIGNS = '.,;:!?"()–—'
SENTENCE_END = r"[.!?]$"
#: Similarity: shorter words must be equal; else so much of the longer word may differ.
SHORT_WORD, DIFFERENCE = 3, 0.4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without white space at both ends (Spark's own trim takes only U+0020)."""
    return F.trim(_col(c), F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    return trim(c) == ""


def caption_text(word: Column | str, pos: Column | str) -> Column:
    """A word as caption text: the first is bare, the others begin with a space."""
    return F.when(_col(pos) == 0, _col(word)).otherwise(F.concat(F.lit(" "), _col(word)))


def ordered_text(value: Column | str, order: Column | str, sep: str = " ") -> Column:
    """Aggregate: the values of a group in order, joined."""
    rows = F.sort_array(F.collect_list(F.struct(_col(order).alias("o"), _col(value).alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), sep)


def _accents() -> tuple[str, str]:
    """Lower-case letters up to U+1EFF with a base letter a-z and only marks that are dropped, and those base letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and base.islower() and all("̀" <= m <= "ͯ" for m in marks):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def normalized(word: Column | str) -> Column:
    """Lower case, accents dropped, only a-z and 0-9 left."""
    low = F.lower(_col(word))
    # ASCII words, which have as many bytes as characters, need no look into the table of accents
    bare = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _ACCENTED, _PLAIN))
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def is_similar(a: Column | str, b: Column | str) -> Column:
    """Whether two normalised words are close: equal, or both longer than three letters
    and at most ceil(0.4 x the longer length) edits apart (B12, B13)."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    short = F.least(F.length(a), F.length(b)) <= SHORT_WORD
    return F.when(a == b, True).when(short, False).otherwise(F.levenshtein(a, b) <= F.ceil(F.lit(DIFFERENCE) * longest))


def is_break_word(word: Column | str, lang: str) -> Column:
    """Whether a line may break before the word."""
    return F.translate(F.lower(_col(word)), PUNCTUATION_SIGNS, "").isin(BREAK_BEFORE[lang])


def is_bound_word(word: Column | str, lang: str) -> Column:
    """Whether the word must not begin a line.  Probes are in lower case, so an upper-case entry never matches."""
    return F.translate(F.lower(_col(word)), ".,;:!?", "").isin(NO_BREAK_BEFORE[lang])


def ends_with_punctuation(word: Column | str) -> Column:
    """(B15)"""
    return F.right(trim(word), F.lit(1)).isin(*PUNCTUATION_SIGNS)


def ends_sentence(word: Column | str) -> Column:
    return trim(word).rlike(SENTENCE_END)


def safe_name(title: Column | str, fallback: Column | str) -> Column:
    """A title as a file name: other signs than ASCII word signs, white space and hyphens become ``_``;
    60 characters at most; the fallback if nothing is left (B22)."""
    name = F.substring(trim(F.regexp_replace(_col(title), rf"[^0-9A-Za-z_\-\x{{09}}-\x{{0D}}\x{{20}}{SPACE[1:-1]}]", "_")), 1, 60)
    return F.coalesce(F.nullif(name, F.lit("")), _col(fallback))


def studio_name(title: Column | str) -> Column:
    """The other form of file names: all but ASCII letters and digits become ``_``."""
    return F.regexp_replace(_col(title), "[^A-Za-z0-9]", "_")


def video_name(filename: Column | str) -> Column:
    """A file name as a title: the last ending goes, ``_`` and ``-`` become spaces."""
    return trim(F.regexp_replace(F.regexp_replace(_col(filename), r"\.[^.]+$", ""), "[_-]", " "))


def display_name(name: Column | str, path: Column | str, ending: str = "lusk") -> Column:
    """A project's name: its own unless blank, else its file's without the ending, else a fixed one."""
    base = F.element_at(F.split(F.replace(_col(path), F.lit("\\"), F.lit("/")), "/"), -1)
    base = trim(F.regexp_replace(base, rf"(?i)\.{ending}$", ""))
    return F.when(~is_blank(name), _col(name)).otherwise(F.coalesce(F.nullif(base, F.lit("")), F.lit("Untitled Project")))


def tokens(text: Column | str, n: Column | str) -> Column:
    """The words of an edited text with the white space before each, as an array of exactly ``n``."""
    found = F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(1))
    n = _col(n).cast("int")
    return F.slice(F.concat(found, F.array_repeat(F.lit(""), F.greatest(n - F.size(found), F.lit(0)))), F.lit(1), n)


def caption_edits(old: Column | str, new: Column | str, first_pos: Column | str = None) -> Column:
    """Map of place to text for the places at which ``new`` differs from ``old``; arrays of one length.

    ``first_pos`` is the caption index of the first element.
    """
    start = F.lit(0) if first_pos is None else _col(first_pos)
    rows = F.transform(F.arrays_zip(_col(old).alias("a"), _col(new).alias("b")), lambda x, i: F.struct((start + i).cast("int").alias("i"), x["a"].alias("a"), x["b"].alias("b")))
    changed = F.filter(rows, lambda x: ~x["a"].eqNullSafe(x["b"]))
    return F.map_from_entries(F.transform(changed, lambda x: F.struct(x["i"], F.coalesce(x["b"], F.lit("")))))


def fenced_block(text: Column | str) -> Column:
    """The trimmed inside of the first fenced block (plain or ``tsv``) of a model's answer, else the whole answer trimmed."""
    fence = rf"(?s)```(?:tsv)?{SPACE}*\n(.*?)\n```"
    return F.when(_col(text).rlike(fence), trim(F.regexp_extract(_col(text), fence, 1))).otherwise(trim(text))


def numbered(pos: Column | str, text: Column | str) -> Column:
    """``N. text``, from 1."""
    return F.format_string("%d. %s", _col(pos) + 1, _col(text))


def unnumbered(line: Column | str) -> Column:
    """The line without its number."""
    return trim(F.regexp_replace(_col(line), rf"^[0-9]+\.{SPACE}*", ""))
