"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distances, components."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import free_names, salt_bit, salt_of, salts_in, sliced, staged
from cuemill.llm.graph import components

#: Words of a shingle, the seed of its hash, and most differing bits of a link.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Blocks of the first split, members up to which one bucket is compared in a task, and blocks of the second split.
BLOCKS, BUCKET, FINE_BLOCKS = 6, 20_000, 13
SALTS = 64


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a UTF-8 text; 0 if it has no word."""
    words = (text or b"").lower().split()  # bytes: A-Z, and white space as the word rule has it
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED))), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 4096):
        chunk = hashes[part : part + 4096]
        ones += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row, from its whole text; null counts as empty."""

    def batches(parts):
        for b in sliced(parts, 1):
            fps = [fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(batches, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def _keys(blocks: int):
    """Columns (combo, key) for each choice of the blocks that a close pair is sure to share."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for i, own in enumerate(combinations(masks, blocks - DISTANCE)):
        mask = sum(own)
        mask -= (mask >> 63) << 64  # as a signed long
        out.append(F.struct(F.lit(i).cast("short").alias("combo"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return F.explode(F.array(*out))


def _spanning(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is connected among ``members`` at the distance; one fewer than members at most."""
    links, todo = [], members.view(np.uint64)
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            near = np.bitwise_count(todo ^ x) <= DISTANCE
            if near.any():
                found, todo = todo[near], todo[~near]
                links += [(int(x.view(np.int64)), y) for y in found.view(np.int64).tolist()]
                queue += list(found)
    return links


def _compared(buckets: DataFrame) -> DataFrame:
    """The links (u, v) inside each row's array ``fps``, verified, as a spanning forest."""

    def batches(parts):
        for b in parts:
            col = b.column(0)
            links = [x for fps in col for x in _spanning(fps.values.to_numpy(zero_copy_only=False).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

    return buckets.select("fps").mapInArrow(batches, "u long, v long")


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) with the same components as all pairs of distinct ``fp`` at the distance or nearer.

    The fingerprint is split into ``BLOCKS`` blocks; a pair that differs in at
    most ``DISTANCE`` bits agrees on all but that many blocks, so it meets under
    one of the choices of the agreeing blocks (here 3 of 6, about 32 bits, so
    that unrelated texts seldom meet).  A pair alone in its bucket is verified in
    the join's output; a larger bucket is searched in one task, which emits links
    of a spanning forest and never all its pairs.  The members of a bucket of
    over ``BUCKET`` fingerprints are split into ``FINE_BLOCKS`` finer blocks
    instead; there a bucket leaves 15 bits open, so it can't hold more than
    32,768 distinct fingerprints, however large the corpus is.
    """
    rows = fps.select("fp", _keys(BLOCKS).alias("k")).select("fp", "k.*")
    dealt = rows.repartition("combo", "key")
    sized = dealt.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    sized = sized.where(f"n > 2 or bit_count(u ^ v) <= {DISTANCE}")
    pairs = sized.where("n = 2").select("u", "v")
    members = staged(dealt.join(sized.where("n > 2").select("combo", "key", "n"), ["combo", "key"]), "buckets")
    grouped = lambda x: x.groupBy("combo", "key").agg(F.collect_list("fp").alias("fps"))
    found = pairs.unionByName(_compared(grouped(members.where(F.col("n") <= BUCKET))))
    hot = members.where(F.col("n") > BUCKET)
    if not hot.isEmpty():
        fine = hot.select("fp").distinct().select("fp", _keys(FINE_BLOCKS).alias("k")).select("fp", "k.*")
        found = found.unionByName(_compared(grouped(fine).where(F.size("fps") > 1)))
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id reachable over links of at most three
    differing bits.  Equal fingerprints become one class first, so copies cost
    nothing in the search.  The component returns to the rows by (fingerprint,
    salt), which spreads a class that holds a third of them.

    Null and empty texts have fingerprint zero and link like any other.  Null
    ids never name a component that has another id; rows that repeat are judged
    alike; a long text is read whole; other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    fps = staged(fingerprints(docs, id_col, text_col).withColumn("salt", salt_of(F.col("id"), SALTS)), "fps")
    return named_groups(fps, links, id_col)


def named_groups(fps: DataFrame, links_of, id_col: str) -> DataFrame:
    """The rows of :func:`near_groups` from a staged table (id, fp, salt) and the links that ``links_of`` makes from the classes of equal ``fp``."""
    classes = staged(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.bit_or(salt_bit(F.col("salt"))).alias("salts")), "classes")
    roots = components(links_of(classes)).withColumnRenamed("node", "fp")
    grouped = classes.join(roots, "fp", "left").withColumn("linked", F.col("root").isNotNull())
    linked = grouped.where("linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "root").select("fp", "salts", "component_id")
    named = named.unionByName(grouped.where("not linked and n > 1").select("fp", "salts", F.col("first").alias("component_id")))
    named = named.select("fp", F.explode(salts_in(F.col("salts"), SALTS)).alias("salt"), "component_id", F.lit(True).alias("named"))
    rows = fps.join(named, ["fp", "salt"], "left")
    return rows.select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("named"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=near_groups) -> DataFrame:
    """``docs``, all columns, with one document of each near-duplicate group that ``groups`` finds: the one whose id names it.

    Where rows repeat that id, they stay together; exact deduplication comes
    first.  Rows without an id stay if their group has no id.  Null and empty
    texts are a group; the columns keep their names and values, whatever they
    are; an empty table gives no rows.
    """
    (keep,) = free_names(docs, "keep")
    kept = groups(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(keep)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col(keep)), "left_semi")
