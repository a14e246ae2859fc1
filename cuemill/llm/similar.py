"""Near-duplicates by word shingles: SimHash fingerprints find candidates, their Jaccard similarity decides.

A fingerprint is wide, as texts of similarity 0.8 differ in three bits of twenty:
they meet in a band of its bits that is equal, and go on if the bits that belong
to no band are close.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import discard, salt_of, sliced, staged, with_small
from cuemill.llm.graph import components
from cuemill.llm.simhash import SALTS, named_groups

#: Words of a shingle, and the similarity of near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Words of 64 bits of a fingerprint; bits of a band and number of bands, which the last two words are not part of; most differing bits of those two.
#: At similarity 0.8 a bit is equal with probability 0.85, so that a pair meets no band with probability 0.00002 (texts of ten words or more), and differs in 19 of 128 bits, 4 as deviation.
WORDS, ROWS, BANDS, DISTANCE, SEED = 16, 12, 74, 40, 42
#: Documents are told apart by three words, of which one has bits of bands too: similar ones differ in 29 of 192 bits, 5 as deviation, and unrelated ones in 96, 7 as deviation.
CLOSE_WORDS, CLOSE = 3, 56
#: Members up to which a bucket is compared by one matrix.
MATRIX = 1024
#: Sets of one side of a tile, and what distances may be off by.
TILE, SLACK = 256, 1e-9

def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's different shingles, in order; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    texts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    return np.unique(np.array(list(map(xxhash.xxh64_intdigest, texts, repeat(SEED))), np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles as words: a bit is 1 if it is in more than half of them (each hash is widened by SplitMix64)."""
    ones = np.zeros(64 * WORDS, np.int64)
    for part in range(0, len(hashes), 255):
        x = hashes[part : part + 255, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def band_keys(print_: np.ndarray) -> np.ndarray:
    """A number of ``ROWS`` bits for each band."""
    bits = np.unpackbits(print_.view(np.uint8), bitorder="little")[: BANDS * ROWS].reshape(BANDS, ROWS)
    return (bits.astype("<u2") << np.arange(ROWS, dtype="<u2")).sum(1, dtype="<u2")


def _clusters(words: np.ndarray, distance: int) -> list[np.ndarray]:
    """Rows (a column of words each) that are connected by steps of at most so many bits, of each cluster of two or more."""
    differ = lambda a, b: sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int16) for x in words)
    out, todo, near = [], np.arange(words.shape[1]), None
    if len(todo) <= MATRIX:
        near = differ(todo[:, None], todo) <= distance
        todo = np.flatnonzero(near.sum(1) > 1)
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        found = list(queue)
        while queue and len(todo):
            k = queue.pop()
            hit = near[k, todo] if near is not None else differ(todo, k) <= distance
            queue += todo[hit].tolist()
            found += todo[hit].tolist()
            todo = todo[~hit]
        if len(found) > 1:
            out.append(np.array(found))
    return out


def clusters(prints: DataFrame, distance: int, words: int = 2) -> DataFrame:
    """(lead, fp) for each member of each cluster of close fingerprints that share a band: the cluster's least name, and the member's.

    Close are those whose ``last`` (so many words) differ in ``distance`` bits at most.  Bands are sorted runs of a task's rows.  Fingerprints that are close to no
    other go no further; members of a cluster are listed, their pairs never.
    """

    names = [f"w{k}" for k in range(words)]

    def keyed(parts):
        for b in parts:
            keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), "<u2").reshape(-1, BANDS).astype(np.int32)
            last = np.frombuffer(b"".join(b.column("last").to_pylist()), "<i8").reshape(-1, words)
            for lo in range(0, b.num_rows, 1000):
                own = keys[lo : lo + 1000] + (np.arange(BANDS, dtype=np.int32) << ROWS)
                at = np.repeat(np.arange(lo, lo + len(own)), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), b.column("fp").take(pa.array(at)), *(pa.array(last[at, k]) for k in range(words))], ["key", "fp", *names])

    def close(key, fp, last):
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        leads, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            for c in _clusters(last[:, lo:hi], distance) if hi - lo > 1 else ():
                found = fp[lo + c]
                leads.append(np.full(len(c), found.min()))
                members.append(found)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (leads, members)], ["lead", "fp"])

    def scan(parts):
        rest = None
        for b in parts:
            now = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "fp", *names)])
            now = now if rest is None else np.concatenate([rest, now], axis=1)
            cut = int(np.searchsorted(now[0], now[0, -1])) if now.shape[1] else 0
            rest = now[:, cut:]
            if cut:
                yield close(now[0, :cut], now[1, :cut], now[2:, :cut].view(np.uint64))
        if rest is not None and rest.shape[1]:
            yield close(rest[0], rest[1], np.ascontiguousarray(rest[2:]).view(np.uint64))

    rows = prints.mapInArrow(keyed, ", ".join(["key int", "fp long", *(f"{x} long" for x in names)])).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(scan, "lead long, fp long")


def linkable(sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(fp, shared) of ``sets`` (fp, hashes): how many of its shingles others have too; without those that have too few to be similar to any other.

    Shingles are told apart by 32 bits, where a chance match only adds to what is shared.
    """

    def shingles(parts):
        for cut in sliced(parts, 1):
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in cut.column(1)]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype(np.uint32).view(np.int32)), cut.column(0).take(pa.array(at))], ["shingle", "fp"])

    rows = sets.select("fp", "hashes").mapInArrow(shingles, "shingle int, fp long")
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp")).where("n = 1").groupBy("fp").agg(F.count(F.lit(1)).alias("alone"))
    sized = sets.select("fp", (F.octet_length("hashes") / 8).cast("long").alias("n")).join(alone, "fp", "left")
    return sized.select("fp", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")).where(F.col("shared") >= similar * F.col("n")).select("fp", "shared")


def joined_buckets(members: DataFrame) -> DataFrame:
    """(fp, root, places) of ``members`` (lead, fp), staged: buckets that share members are one, named ``root``; a member was in so many ``places``.

    A member ties its leaders, one for each band at most, to the least of them;
    these ties are few, as members of the same buckets have the same least leader.
    """
    least = staged(members.groupBy("fp").agg(F.min("lead").alias("least"), F.collect_set("lead").alias("leads")), "least")
    ties = least.select(F.explode("leads").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.col("fp").alias("u"), F.col("least").alias("v")))
    roots = components(ties).select(F.col("node").alias("fp"), "root")
    out = staged(least.select("fp", F.size("leads").alias("places")).join(roots, "fp").select("fp", "root", "places"), "buckets")
    discard(least)
    return out


def similarity(a: np.ndarray, b: np.ndarray, similar: float) -> tuple[float, bool]:
    """Jaccard distance of two sets, and whether they are similar."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return 1 - both / either, both >= similar * either


def _compared(similar: float):
    """The links of one tile: pairs of its two sides (or of its rows, if it has one) that can be similar."""
    width, part = 1 - similar + SLACK, similar / (1 + similar) - SLACK

    def compare(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]
        away, names, side, shared = (t.column(c).to_pylist() for c in ("away", "fp", "side", "shared"))
        root, out = list(range(len(sets))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        left = [i for i, s in enumerate(side) if s == 0]
        right = [i for i, s in enumerate(side) if s == 1]
        pairs = ((i, j) for i in left for j in right) if right else combinations(left, 2)
        for i, j in pairs:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small < similar * large or abs(away[i] - away[j]) > width or min(shared[i], shared[j]) < part * (small + large) or find(i) == find(j):
                continue
            if similarity(sets[i], sets[j], similar)[1]:
                root[find(i)] = find(j)
                out.append((names[i], names[j]))
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])

    return compare


def similar_links(sets: DataFrame, similar: float = SIMILAR, distance: int = DISTANCE, words: int = 2) -> DataFrame:
    """Links (u, v) with the components of all pairs of ``sets`` (fp, bands, last, hashes) whose fingerprints share a band and are close, and that are similar.

    Sets with too few shared shingles to be similar to any other candidate
    (:func:`linkable`) go first, so that what met by chance ties nothing.
    Clusters of the bands (:func:`clusters`) that share members are then one
    bucket: a set is in one bucket, however many bands it met others in.  The
    member that met others most is the leader.  Its distance to each member is
    worked out pair by pair, so a bucket is never gathered, and near copies need
    no more.  Distances are a metric: two members can be similar only if theirs
    to the leader differ by no more than similar ones do, and two that are similar
    to the leader are linked already.  What is left, members of neighbouring
    distances of which one at least is not similar to the leader, is compared in
    tiles of a bounded number of sets.
    """
    prints = sets.groupBy("fp").agg(F.first("bands").alias("bands"), F.first("last").alias("last"))
    members = staged(clusters(prints, distance, words).distinct(), "members")
    asked = staged(members.select("fp").distinct(), "asked")
    known = staged(with_small(sets.select("fp", "hashes"), asked, ["fp"], "left_semi").dropDuplicates(["fp"]), "known")
    able = staged(linkable(known, similar), "able")
    buckets = joined_buckets(with_small(members, able, ["fp"], "left_semi"))

    def star(parts):
        for cut in sliced(parts, 3):
            a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in cut.column(c)] for c in ("hashes", "own"))
            away, near = zip(*(similarity(x, y, similar) for x, y in zip(a, b, strict=True)), strict=True) if a else ((), ())
            yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in ("lead", "fp", "shared")), pa.array(away, pa.float64()), pa.array(near, pa.bool_())], ["lead", "fp", "shared", "away", "near"])

    leads = buckets.groupBy("root").agg(F.min(F.struct(-F.col("places"), "fp"))["fp"].alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leads = staged(leads.join(known.select(F.col("fp").alias("lead"), F.col("hashes").alias("own")), "lead").select("root", "lead", "own"), "leads")
    both = with_small(buckets.select("fp", "root").join(able, "fp").join(known, "fp"), leads, ["root"], "inner")
    stars = staged(both.select("lead", "fp", "shared", "hashes", "own").mapInArrow(star, "lead long, fp long, shared long, away double, near boolean"), "stars")
    ring = F.when(F.col("near"), 0).otherwise(F.greatest(F.floor(F.col("away") / (1 - similar + SLACK)), F.lit(1)).cast("int"))
    placed = stars.select("lead", "fp", "shared", "away", ring.alias("ring"))
    # rings are six at most; a bucket with members of the first ring alone, to which the leader belongs, has its links
    rings = placed.groupBy("lead", "ring").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("k"))
    rings = rings.groupBy("lead").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("ring", "k"))).alias("rings")).where("n > 2 and size(rings) > 1").drop("n")
    rows = placed.join(staged(rings, "rings"), "lead")
    r, own = F.col("ring"), F.col("rings")[F.col("ring")]
    mine, span = F.pmod(F.xxhash64("fp"), own).cast("int"), lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda ring, cross, side, i, j: F.struct(ring.alias("at"), F.lit(cross).alias("cross"), side.alias("side"), i.alias("i"), j.alias("j"))
    none = F.array().cast("array<struct<at:int,cross:boolean,side:int,i:int,j:int>>")
    with_next = lambda to: F.map_contains_key("rings", to)
    outer = F.when(with_next(r + 1), F.transform(span(F.col("rings")[r + 1]), lambda j: tile(r, True, F.lit(0), F.col("mine"), j))).otherwise(none)
    inner = F.when((r > 0) & with_next(r - 1), F.transform(span(F.col("rings")[r - 1]), lambda i: tile(r - 1, True, F.lit(1), i, F.col("mine")))).otherwise(none)
    home = F.when(r > 0, F.transform(span(own), lambda j: tile(r, False, F.when(j >= F.col("mine"), 0).otherwise(1), F.least("mine", j), F.greatest("mine", j)))).otherwise(none)
    tiles = rows.withColumn("mine", mine).select("lead", "fp", "shared", "away", F.explode(F.concat(outer, inner, home)).alias("t")).select("lead", "fp", "shared", "away", "t.*")
    full = tiles.join(known, "fp")
    found = full.groupBy("lead", "at", "cross", "i", "j").applyInArrow(_compared(similar), "u long, v long")
    links = staged(stars.where("near and fp <> lead").select(F.col("lead").alias("u"), F.col("fp").alias("v")).unionByName(found).distinct(), "pairs")
    for df in (members, asked, known, able, buckets, leads, stars):
        discard(df)
    return links


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """One row per input row: id, fingerprint of the set of shingles, component_id.

    ``component_id`` is the smallest id reachable over links of at least the
    similarity.  Equal sets become one class first.

    Null and empty texts are one class; a text of fewer words than a shingle is
    one shingle; texts are read whole; rows that repeat are judged alike.  Null
    ids never name a component that has another id.  Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """

    def batches(parts):
        for cut in sliced(parts, 1):
            sets = [shingle_set(t, shingle) for t in cut.column(1).cast(pa.binary()).to_pylist()]
            prints = [fingerprint(s) for s in sets]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            bands, last, hashes = (pa.array(x, pa.binary()) for x in ([band_keys(p).tobytes() for p in prints], [p[-CLOSE_WORDS:].tobytes() for p in prints], [s.tobytes() for s in sets]))
            yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(names), bands, last, hashes], ["id", "fp", "bands", "last", "hashes"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = src.mapInArrow(batches, f"id {src.schema['id'].dataType.simpleString()}, fp long, bands binary, last binary, hashes binary")
    wide = staged(rows.withColumn("salt", salt_of(F.col("id"), SALTS)), "sets")
    fps = staged(wide.select("id", "fp", "salt"), "fps")
    links = similar_links(wide.select("fp", "bands", "last", "hashes"), similar, CLOSE, CLOSE_WORDS)
    discard(wide)
    return named_groups(fps, lambda _: links, id_col)
