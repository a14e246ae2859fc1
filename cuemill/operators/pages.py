"""Caption pages of a clip: tokens that show together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.functions.text import ends_sentence
from cuemill.operators.arrays import cut, fold_starts, in_order
from cuemill.operators.ordered import PAGE_MS


def group_pages(captions: DataFrame, combine_ms: int = PAGE_MS, key: str | list[str] = "project_id") -> DataFrame:
    """Pages (key, page_no, text, start_ms, duration_ms, tokens) of captions.

    The library's own rule: a token that starts over ``combine_ms`` after its
    page's first token begins the next page.  A token that far from the one
    before always does, so captions are folded in islands between such tokens.
    ``tokens`` are (text, from_ms, to_ms) in order.
    """
    key = [key] if isinstance(key, str) else key
    far = F.col("start_ms") - F.lag("start_ms").over(W.partitionBy(key).orderBy("pos")) > combine_ms
    rows = captions.select(*key, "pos", "text", "start_ms", "end_ms").withColumn("_far", F.coalesce(far.cast("int"), F.lit(0)))
    rows = rows.withColumn("_island", F.sum("_far").over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    islands = rows.groupBy(*key, "_island").agg(in_order("text", "start_ms", "end_ms").alias("rows"))
    starts = fold_starts(
        F.col("rows"),
        lambda s, x: x["start_ms"] - s["first"] > combine_ms,
        {"first": F.lit(0).cast(captions.schema["start_ms"].dataType)},
        lambda s, x, new: {"first": F.when(new, x["start_ms"]).otherwise(s["first"])},
    )
    pages = islands.select(*key, F.explode(cut(F.col("rows"), starts)).alias("w"))
    pages = pages.select(*key, F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["start_ms"].alias("from_ms"), x["end_ms"].alias("to_ms"))).alias("tokens"), F.get("w", F.lit(0))["pos"].alias("_pos"))
    return _paged(pages, key)


def split_at_sentences(pages: DataFrame, key: str | list[str] = "project_id") -> DataFrame:
    """Pages in which no sentence follows another (F06): a page ends with a token that ends in ``.``, ``!`` or ``?``."""
    key = [key] if isinstance(key, str) else key
    ends = F.filter(F.transform("tokens", lambda t, i: F.when(ends_sentence(t["text"]) & (i < F.size("tokens") - 1), i + 1)), lambda i: i.isNotNull())
    parts = pages.withColumn("_parts", cut(F.col("tokens"), F.concat(F.array(F.lit(0)), ends)))
    parts = parts.select(*key, F.posexplode("_parts").alias("_part", "tokens"), F.col("page_no").alias("_page"))
    return _paged(parts.select(*key, "tokens", F.struct("_page", "_part").alias("_pos")), key)


def _paged(pages: DataFrame, key: list[str]) -> DataFrame:
    """Numbers and sums up rows (key, tokens, _pos)."""
    start, end = F.get("tokens", F.lit(0))["from_ms"], F.element_at("tokens", -1)["to_ms"]
    return pages.select(
        *key,
        (F.row_number().over(W.partitionBy(key).orderBy("_pos")) - 1).alias("page_no"),
        F.array_join(F.transform("tokens", lambda t: t["text"]), "").alias("text"),
        start.alias("start_ms"),
        end.alias("end_ms"),
        (end - start).alias("duration_ms"),
        "tokens",
    )


def active_tokens(pages: DataFrame, at: str = "at_ms", key: str = "project_id") -> DataFrame:
    """The token that is spoken at the time ``at`` of each page: ``from_ms <= at < to_ms``.

    Gives the page's columns with the token's (text, from_ms, to_ms) instead of
    ``tokens`` and the page's text, and ``pos``, its place among all tokens of
    the key.  A page's tokens stand in its row, so nothing is joined.
    """
    before = F.sum(F.size("tokens")).over(W.partitionBy(key).orderBy("page_no").rowsBetween(W.unboundedPreceding, -1))
    rows = pages.withColumn("_first", F.coalesce(before, F.lit(0)).cast("int"))
    placed = F.transform("tokens", lambda t, i: F.struct(t["text"].alias("text"), t["from_ms"].alias("from_ms"), t["to_ms"].alias("to_ms"), (F.col("_first") + i).alias("pos")))
    spoken = F.filter(placed, lambda t: (t["from_ms"] <= F.col(at)) & (F.col(at) < t["to_ms"]))
    return rows.select(*[c for c in pages.columns if c not in ("text", "tokens")], F.inline(spoken))
