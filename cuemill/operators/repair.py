"""Fitting a model's corrected rows to the rows that it was given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cuemill.functions.text import is_similar, normalized
from cuemill.operators.arrays import in_order, let

#: Rows to look ahead on either side; share of rows below which an answer is asked for again, once.
AHEAD, LEAST_SHARE = 4, 0.90
BY = ("project_id", "chunk_no")


def restored(rows: DataFrame, answers: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """The input's times with the answer's words, by place.

    ``rows``: (by, row_no, start_ms, word, ...), of columns that can be ordered;
    ``answers``: (by, row_no, word).  A row without an answer keeps its word;
    surplus answers go, and a row with several answers comes with each.  A
    chunk's answers are found in its own row, by their place where no place is
    left out, and nothing is joined.
    """
    rest = [c for c in rows.columns if c not in (*by, "row_no")]
    chunks = _by_chunk(rows, answers, by, tuple(c for c in rest if c != "word"), norm=False)
    nos, first = F.transform("_outs", lambda o: o["row_no"]), F.get("_outs", F.lit(0))["row_no"]
    n = F.size("_outs")
    whole = (n > 0) & (F.size(F.array_distinct(nos)) == n) & (F.get("_outs", n - 1)["row_no"] - first == n - 1)

    def row(x, answer):
        return F.struct(x["row_no"].alias("row_no"), *[(F.coalesce(answer["word"], x[c]) if c == "word" else x[c]).alias(c) for c in rest])

    def each(x):
        found = F.filter("_outs", lambda o: o["row_no"] == x["row_no"])
        return let(found, lambda m: F.when(F.size(m) > 0, F.transform(m, lambda o: row(x, o))).otherwise(F.array(row(x, F.get(m, F.lit(0))))))

    placed = F.transform("_ins", lambda x: row(x, F.get("_outs", (x["row_no"] - first).cast("int"))))
    fitted = F.when(F.coalesce(whole, F.lit(False)), placed).otherwise(F.flatten(F.transform("_ins", each)))
    return chunks.select(*by, F.inline(fitted))


def _walked(ins: Column, outs: Column) -> Column:
    """For each word of ``ins`` the place in ``outs`` of the answer taken, null to keep the word."""

    def look(norms, at, norm):
        """How far ahead of a place the word is, null beyond the look-ahead."""
        return F.coalesce(*[F.when(F.get(norms, at + j) == norm, j) for j in range(1, AHEAD + 1)])

    def noted(s, place):
        """The places so far as text, which a step copies as bytes; an array would be copied value by value."""
        return F.concat(s["taken"], place, F.lit(",")).alias("taken")

    def over(a, b):
        def unequal(s, i):
            norm, here, o = F.get(a, i), F.get(b, s["o"]), s["o"]
            unlike = here.isNotNull() & (norm != here)
            ahead = F.struct(F.when(unlike, look(b, o, norm)).alias("out"), F.when(unlike, look(a, i, here)).alias("in"))

            def take(x):
                dropped = x["in"].isNotNull() & (x["out"].isNull() | (x["in"] <= x["out"]))
                return F.when(here.isNull() | dropped, None).when(x["out"].isNotNull(), o + x["out"]).when(is_similar(norm, here), o)

            return let(let(ahead, take), lambda t: F.struct(F.coalesce(t + 1, o).alias("o"), noted(s, F.coalesce(t.cast("string"), F.lit("")))))

        def walk(s, i):
            equal = F.struct((s["o"] + 1).alias("o"), noted(s, s["o"].cast("string")))
            return F.when(F.get(a, i) == F.get(b, s["o"]), equal).otherwise(unequal(s, i))

        zero = F.struct(F.lit(0).alias("o"), F.lit("").alias("taken"))
        return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), zero, walk, lambda s: F.transform(F.split(s["taken"], ","), lambda t: F.when(t != "", t.cast("int"))))

    return let(F.struct(ins["_norm"].alias("a"), outs["_norm"].alias("b")), lambda n: over(n["a"], n["b"]))


def _by_chunk(rows: DataFrame, answers: DataFrame, by: tuple[str, ...], keep: tuple[str, ...], norm: bool = True) -> DataFrame:
    """(by, _ins, _outs): both sides, each grouped by chunk once, and the two rows of a chunk grouped into one; with ``norm`` words come normalised too.

    A join on all of ``by`` would shuffle both sides anew where they are dealt by
    a part of it; a grouping finds its rows in place.
    """
    # worked out below the grouping, where Spark generates code for it
    more = {"_norm": normalized("word")} if norm else {}
    given = rows.withColumns(more).groupBy(*by).agg(in_order(*keep, "word", *more, order="row_no").alias("_ins"))
    found = answers.dropna(subset=list(by)).withColumns(more).groupBy(*by).agg(in_order("word", *more, order="row_no").alias("_outs"))
    both = given.unionByName(found, allowMissingColumns=True).groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_ins", "_outs")])
    return both.where("_ins is not null").withColumn("_outs", F.coalesce("_outs", F.array().cast(found.schema["_outs"].dataType)))


def _fitted(chunks: DataFrame, by: tuple[str, ...], keep: tuple[str, ...], places) -> DataFrame:
    """(by, row_no, keep, word, matched): the rows with the answers at ``places(ins, outs)``, put together in the chunk's own row."""

    def row(x, i):
        kept = [x[c].alias(c) for c in ("row_no", *keep)]
        return let(F.get("_taken", i), lambda at: F.struct(*kept, F.coalesce(F.get("_outs", at)["word"], x["word"]).alias("word"), at.isNotNull().alias("matched")))

    return chunks.withColumn("_taken", places(F.col("_ins"), F.col("_outs"))).select(*by, F.inline(F.transform("_ins", row)))


def repaired(rows: DataFrame, answers: DataFrame, by: tuple[str, ...] = BY, keep: tuple[str, ...] = ("start_ms",)) -> DataFrame:
    """(by, row_no, keep, word, matched): each input row with the answer's word that fits it, or its own.

    A chunk is walked from its start with a place in the answer.  Equal words
    (normalised) match.  Else the next four answers are searched for this word,
    and the next four inputs for the answer's word: the nearer find says whether
    the answer has surplus rows, which are skipped, or lacks this one, which is
    kept.  Else a similar word is a correction, and any other keeps the input.
    The walk is a fold in the JVM over the arrays of one chunk, which has a
    bounded number of rows; chunks are independent.
    """
    return _fitted(_by_chunk(rows, answers, by, keep), by, keep, _walked)


def row_counts(rows: DataFrame, answers: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, expected, actual, is_mismatch, share, should_retry): E05, E06.

    An answer with a wrong number of rows is asked for again, once, if under
    ``LEAST_SHARE`` of the rows came; other mismatches are repaired.
    """
    want = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"))
    have = answers.groupBy(*by).agg(F.count(F.lit(1)).alias("actual"))
    both = want.join(have, list(by), "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    bad, share = F.col("actual") != F.col("expected"), F.col("actual") / F.col("expected")
    return both.select(*by, "expected", "actual", bad.alias("is_mismatch"), share.alias("share"), (bad & (share < LEAST_SHARE)).alias("should_retry"))


def answer_totals(counts: DataFrame, by: str = "project_id") -> DataFrame:
    """(by, chunks, expected, actual, is_mismatch, bad_chunks): what a whole transcript or translation came to.

    ``counts`` are those of :func:`row_counts`; the total is held to the sum of
    what its chunks were to give, also where surplus and lack make it right.
    """
    sums = counts.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.sum("expected").alias("expected"), F.sum("actual").alias("actual"), F.count_if("is_mismatch").alias("bad_chunks"))
    return sums.select(by, "chunks", "expected", "actual", (F.col("actual") != F.col("expected")).alias("is_mismatch"), "bad_chunks")


def match_counts(fixed: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, matched, kept, match_ratio) of :func:`repaired` rows."""
    n, hits = F.count(F.lit(1)), F.count_if("matched")
    return fixed.groupBy(*by).agg(hits.alias("matched"), (n - hits).alias("kept"), (hits / n).alias("match_ratio"))


def corrected(rows: DataFrame, answers: DataFrame, by: tuple[str, ...] = BY, keep: tuple[str, ...] = ("start_ms",)) -> DataFrame:
    """(by, row_no, keep, word): chunks with the right number of answers by place (D06), the others repaired.

    The choice is made in each chunk's row, so rows and answers are each grouped once.
    """
    return _fitted(_by_chunk(rows, answers, by, keep), by, keep, _by_place).drop("matched")


def _by_place(ins: Column, outs: Column) -> Column:
    return F.when(F.size(ins) == F.size(outs), F.sequence(F.lit(0), F.size(ins) - 1)).otherwise(_walked(ins, outs))


def checked(rows: DataFrame, answers: DataFrame, by: tuple[str, ...] = BY, keep: tuple[str, ...] = ("start_ms",), strict: bool = False) -> tuple[DataFrame, Observation]:
    """:func:`corrected` rows, and what the job that writes them sees on its way: chunks, expected, actual, mismatched, to_retry.

    The metrics are those of :func:`row_counts`, summed over all chunks, without
    a pass of their own; they can be had once an action has run over the rows.
    With ``strict`` the first chunk with a wrong number of answers ends the job
    (rows that are there are rows of whole chunks only in formats that commit).
    """
    chunks = _by_chunk(rows, answers, by, keep)
    n, m = F.size("_ins").cast("long"), F.size("_outs").cast("long")
    if strict:
        where = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
        message = F.concat(F.lit("chunk "), where, F.lit(": "), n.cast("string"), F.lit(" rows expected, "), m.cast("string"), F.lit(" came"))
        chunks = chunks.where(F.coalesce(F.assert_true(n == m, message).cast("boolean"), F.lit(True)))
    seen = Observation()
    bad = n != m
    counts = [F.count(F.lit(1)).alias("chunks"), F.sum(n).alias("expected"), F.sum(m).alias("actual"), F.count_if(bad).alias("mismatched"), F.count_if(bad & (m / n < LEAST_SHARE)).alias("to_retry")]
    return _fitted(chunks.observe(seen, *counts), by, keep, _by_place).drop("matched"), seen


def cached_or_missing(chunks: DataFrame, cache: DataFrame, text: str = "chunk_text", prefix: str = "") -> DataFrame:
    """Chunks with the answer that the cache has for their text, null if none: A17, D08, B24.

    ``cache`` is (chunk_key, answer); the key is the MD5 of the prefix and the
    text, so it is the same for equal texts of any project.
    """
    keyed = chunks.withColumn("chunk_key", chunk_key(text, prefix))
    return keyed.join(cache.dropDuplicates(["chunk_key"]), "chunk_key", "left")


def chunk_key(text: str, prefix: str = ""):
    """(B24)"""
    return F.md5(F.concat(F.lit(prefix), F.col(text)))


def cache_after(cache: DataFrame, answered: DataFrame) -> DataFrame:
    """The cache with new (chunk_key, answer) rows; an old answer stays."""
    fresh = answered.select("chunk_key", "answer").dropDuplicates(["chunk_key"]).join(cache, "chunk_key", "left_anti")
    return cache.select("chunk_key", "answer").unionByName(fresh)
