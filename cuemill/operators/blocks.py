"""Subtitle blocks: grouping words, wrapping lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.functions.text import SPACE_CLASS, ends_with_punctuation, is_bound_word, is_break_word, trim
from cuemill.operators.arrays import cut, fold_starts, in_order, let
from cuemill.operators.ordered import with_islands
from cuemill.operators.scan import runs_of

LINE_CHARS, BLOCK_CHARS, FEWEST_WORDS = 42, 84, 4


def _next_blocks(x: dict[str, np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Where the block after one that begins at each row begins; ``ends`` are those of the rows' islands."""
    n = len(ends)
    at = np.arange(n)
    upto = np.append(0, np.cumsum(x["len"].astype(np.int64) + 1))  # characters of the rows before, with a space after each
    reach = lambda chars: np.searchsorted(upto, upto[:-1] + chars + 1, side="right") - 1  # noqa: E731  the first row that makes a block longer
    turn = (np.append(False, x["punct"][:-1]) | x["brk"]) & ~x["bound"]
    turns = np.append(np.minimum.accumulate(np.where(turn, at, n)[::-1])[::-1], n)
    full, turned = np.maximum(reach(BLOCK_CHARS), at + 1), turns[np.minimum(np.maximum(reach(LINE_CHARS), at + FEWEST_WORDS), n)]
    return np.minimum(np.minimum(full, turned), ends)


def _islands(captions: DataFrame, lang: str, key: str, run: int | None) -> DataFrame:
    """One row per silence island, or run of one: (key, rows, starts), where ``starts`` are the places of its blocks' first words; of runs also first_no."""
    bare = captions.select(key, "pos", trim("text").alias("text"), "start_ms", "end_ms")
    rows = with_islands(bare, key=key).select(
        "*",
        F.length("text").alias("len"),
        is_break_word("text", lang).alias("brk"),
        is_bound_word("text", lang).alias("bound"),
        ends_with_punctuation("text").alias("punct"),
    )
    cols = ("text", "start_ms", "end_ms", "len", "brk", "bound", "punct")
    if run:
        # a word adds a character at least, if only the space before it
        return runs_of(rows, key, run, BLOCK_CHARS + 1, _next_blocks, *cols)

    def begins(s, x):
        size = s["size"] + 1 + x["len"]  # three small integers: cheaper again than bound
        turn = (s["n"] >= FEWEST_WORDS) & (size > LINE_CHARS) & (s["punct"] | x["brk"]) & ~x["bound"]
        return (size > BLOCK_CHARS) | turn

    def step(s, x, new):
        return {"n": F.when(new, 1).otherwise(s["n"] + 1), "size": F.when(new, x["len"]).otherwise(s["size"] + 1 + x["len"]), "punct": x["punct"]}

    state = {"n": F.lit(0), "size": F.lit(0), "punct": F.lit(False)}
    islands = rows.groupBy(key, "island").agg(in_order(*cols).alias("rows"))
    return islands.select(key, "island", "rows", fold_starts(F.col("rows"), begins, state, step).alias("starts"))


def group_blocks(captions: DataFrame, lang: str = "en", key: str = "project_id", run: int | None = None) -> DataFrame:
    """Subtitle blocks of captions (key, pos, text, start_ms, end_ms): (key, block_no, text, start_ms, end_ms, first_pos, n_words).

    A word begins a block after a silence of over a second; if the block would
    be longer than two lines; or if the block has four words, would be longer
    than a line, and either the word before ends with punctuation or this is a
    word that lines may begin with, unless the word is bound to the one before.
    The decision depends on the block so far, so it is a fold; silences end
    blocks in any case, so each island of speech is folded by itself.  Where
    speakers may never pause, ``run`` bounds the words of an array: longer
    islands are cut into runs (more than a block's words each), whose blocks are
    found as the words stream through a task.
    """
    first = [F.col("first_no")] if run else []
    blocks = _islands(captions, lang, key, run).select(key, *first, F.posexplode(cut(F.col("rows"), F.col("starts"))).alias("_no", "w")).select(
        key,
        *[(no + F.col("_no")).alias("block_no") for no in first],
        F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"),
        F.get("w", F.lit(0))["start_ms"].alias("start_ms"),
        F.element_at("w", -1)["end_ms"].alias("end_ms"),
        F.get("w", F.lit(0))["pos"].alias("first_pos"),
        F.size("w").alias("n_words"),
    )
    number = F.col("block_no") if run else F.row_number().over(W.partitionBy(key).orderBy("first_pos")) - 1
    return blocks.select(key, number.alias("block_no"), "text", "start_ms", "end_ms", "first_pos", "n_words")


def block_length(captions: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Characters of a block's trimmed words and the spaces between them."""
    return captions.groupBy(*by).agg((F.sum(F.length(trim(text))) + F.count(F.lit(1)) - 1).cast("long").alias("n_chars"))


def folded(captions: DataFrame, by: list[str], sep: str = " ") -> DataFrame:
    """One row per group of captions: text, start of the first, end of the last by ``pos``."""
    rows = captions.groupBy(*by).agg(in_order((trim("text") if sep else F.col("text")).alias("text"), "start_ms", "end_ms").alias("_r"))
    return rows.select(
        *by,
        F.array_join(F.transform("_r", lambda x: x["text"]), sep).alias("text"),
        F.get("_r", F.lit(0))["start_ms"].alias("start_ms"),
        F.element_at("_r", -1)["end_ms"].alias("end_ms"),
    )


def _candidates(words: Column, total: Column, lang: str, line: int) -> Column:
    """Array of (score, i): places after which a text may be split into two lines, the upper not the longer."""

    def candidate(i):
        def scored(top):
            bottom, following = total - top - 1, F.get(words, i + 1)
            score = F.abs(top - F.floor(total / 2).cast("int")) - F.when(ends_with_punctuation(F.get(words, i)), 20).otherwise(0) - F.when(is_break_word(following, lang), 10).otherwise(0)
            fits = (top <= line) & (bottom <= line) & (top <= bottom) & ~is_bound_word(following, lang)
            return F.when(fits, F.struct(score.alias("score"), i.alias("i")))

        return let(F.length(F.array_join(F.slice(words, F.lit(1), i + 1), " ")), scored)

    places = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, candidate), lambda x: x.isNotNull())


def wrapped(text: Column | str, lang: str = "en", line: int = LINE_CHARS) -> Column:
    """A text longer than a line in two lines, split at the best place if there is one."""
    text = F.col(text) if isinstance(text, str) else text

    def split(words):
        def at(best):
            top, bottom = F.slice(words, F.lit(1), best + 1), F.slice(words, best + 2, F.size(words))
            return F.when(best.isNull(), text).otherwise(F.concat(F.array_join(top, " "), F.lit("\n"), F.array_join(bottom, " ")))

        return let(F.array_min(_candidates(words, F.length(text), lang, line))["i"], at)

    return F.when(F.length(text) <= line, text).otherwise(let(F.split(text, SPACE_CLASS + "+"), split))
