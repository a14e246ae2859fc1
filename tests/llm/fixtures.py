"""Documents with everything that operators must bear."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, salt int, host string, fp long, piece string, length int, word string, _k int"


def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source) with nulls, empty and long texts, copies, near copies, ties."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(200), text(40)
    rows = [
        (1, None, None, None),
        (2, "", "en", "h1"),
        (3, " \t\n", "en", "h1"),
        (4, base, "en", "h1"),
        (5, base.replace(" ", "\n", 3), "en", None),
        (6, base + " tail", "en", "h2"),
        (7, base.replace(vocabulary[0], "zzz"), None, "h2"),
        (8, "Één wörd", "de", "h2"),
        (9, text(3000) + passage, "de", "h3"),
        (10, passage + " " + text(50), "de", "h3"),
        (11, (text(9) + " ") * 30, "fr", "h3"),
        (12, "x" * 5000, "fr", "h3"),
        (13, "a\u0000b � 😀 <|endoftext|> it's O'RE 12", "fr", "h3"),
        (14, "one two", "fr", "h3"),
        (15, "two one", "fr", "h3"),
        (16, " ".join(["same"] * 60), "es", "h3"),
        (None, base, "es", "h3"),
        (None, text(30), "es", "h3"),
    ]
    rows += [(20 + i, passage if i % 2 else text(25) + "\n" + text(3) + "\n" + text(3), "en", "hot") for i in range(30)]
    rows += [(60 + i, text(12), "en", "poor") for i in range(25)]
    rows += [(4, base, "en", "h1")]  # a repeated row
    return rows


def documents(spark, rows: list[tuple] | None = None):
    """Rows of :func:`odd_rows` (or others) as documents, with more columns whose names operators might use."""
    data = [(i, t, k, s, len(t or ""), "x", 1, 2, "y", 3, "z", 4, "w", 5) for i, t, k, s in (odd_rows() if rows is None else rows)]
    return spark.createDataFrame(data, DOCS).repartition(3)


#: Labelled sentences would do as well, but invented words tell languages apart more surely.
SYLLABLES = {"aa": ["lo", "mi", "ra", "ne"], "bb": ["sch", "tz", "pf", "ung"], "cc": ["eau", "ou", "ai", "que"]}


def speech(lang: str, words: int, seed: int) -> str:
    rng = random.Random(seed)
    return ". ".join(" ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(8)) for _ in range(words // 8)) + "."
