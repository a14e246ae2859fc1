"""Embedding near-duplicates: block join over balls of close vectors, verified exactly.

Vectors are scaled to length one, so a cosine of c is a distance of
sqrt(2 - 2c), the *reach*.  Equal vectors are one class.  Classes that fall in
one coarse cell and lie within half a reach of its mean form a *ball*: they are
all linked to each other, and need no comparison.  Every other class is a ball of
radius zero.  So a group of close copies costs a few balls, however many there are.

Balls whose centres are within reach plus both radii may hold links.  Their
number is quadratic by nature, so centres are packed, many to a row, and each
pair of rows is compared once, by one product of matrices: what is sent or
stored is the packed rows, never a row for each comparison.  What that finds is
verified in doubles: a pair of balls is linked as a whole, not at all, or member
by member.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import salt_bit, salt_of, salts_in, staged, with_small
from cuemill.llm.graph import components

SIMILAR, SEED = 0.9, 42
#: Balls, and entries of their centres, that a packed row aims at; members of a tile.
LEAF, ENTRIES, TILE = 2048, 1 << 17, 2048
#: Rotated dimensions that make the coarse cells, and a cell's width in standard deviations of a random unit vector.
CELL_DIMS, CELL_WIDTH = 32, 5.0
SALTS = 64
#: For distances in doubles and, squared, in floats.
SLACK, FLOAT_SLACK = 1e-9, 1e-4


@cache
def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def reach(similar: float) -> float:
    return float(np.sqrt(2 - 2 * similar))


def units(parts):
    """Batches (id, v) as (id, fp, dims, cell, unit): null ``fp`` for vectors that link with nothing."""
    for b in parts:
        fps, dims, cells, out = [], [], [], []
        for v in b.column("v").to_pylist():
            x = np.array(v, float) if v and None not in v else None
            if x is None or not np.isfinite(x).all() or not x.any():
                fps.append(None), dims.append(None), cells.append(None), out.append(None)
                continue
            x = x / np.abs(x).max()  # squares of huge or tiny entries would overflow
            x /= np.linalg.norm(x)
            fps.append(xxhash.xxh3_128_digest(np.array(v, "<f8").tobytes()))
            dims.append(len(x))
            some = (x @ rotation(len(x))[:, :CELL_DIMS]) * np.sqrt(len(x)) / CELL_WIDTH
            cells.append(xxhash.xxh3_64_intdigest(np.floor(some + _offsets()[: len(some)]).astype("<i8").tobytes(), len(x)) - (1 << 63))
            out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(fps, pa.binary()), pa.array(dims, pa.int32()), pa.array(cells, pa.int64()), pa.array(out, pa.binary())], ["id", "fp", "dims", "cell", "unit"]
        )


@cache
def _offsets() -> np.ndarray:
    return np.random.default_rng(SEED + 1).random(CELL_DIMS)


def _rows(column) -> np.ndarray:
    """Binary doubles of one length, as rows."""
    data = [np.frombuffer(x, "<f8") for x in column.to_pylist()]
    return np.vstack(data) if data else np.zeros((0, 1))


def balls(classes: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(ball, dims, centre, radius, weight) and (fp, unit, n, ball) of classes (fp, dims, cell, unit, n).

    A cell's mean is summed entry by entry after partial sums, so a cell with very many classes is no large group.
    """
    half = reach(similar) / 2 - SLACK

    def sums(parts):
        for b in parts:
            cells, at = np.unique(b.column("cell").to_numpy(), return_inverse=True)
            rows, dims = b.column("unit").to_pylist(), b.column("dims").to_pylist()
            total = {}
            for c, d, x in zip(at.tolist(), dims, rows, strict=True):
                x = np.frombuffer(x, "<f8")
                total[c, d] = total[c, d] + x if (c, d) in total else x
            yield pa.RecordBatch.from_arrays(
                [pa.array([cells[c] for c, _ in total], pa.int64()), pa.array([d for _, d in total], pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["cell", "dims", "part"]
            )

    key = ["cell", "dims"]
    shared = staged(classes.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "cells")
    met = with_small(classes, shared, key, "inner")
    entries = met.select("cell", "dims", "unit").mapInArrow(sums, "cell long, dims int, part array<double>").select(*key, F.posexplode("part").alias("at", "x"))
    means = entries.groupBy(*key, "at").agg(F.sum("x").alias("x")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("xs")).join(shared, key)
    means = staged(means.select(*key, F.transform("xs", lambda s: s["x"] / F.col("k")).alias("centre")), "means")

    def near(parts):
        for b in parts:
            away = [float(np.linalg.norm(np.frombuffer(x, "<f8") - np.array(c))) if c is not None else 9.0 for x, c in zip(b.column("unit").to_pylist(), b.column("centre").to_pylist(), strict=True)]
            yield b.drop_columns(["centre"]).append_column("away", pa.array(away, pa.float64()))

    placed = with_small(classes, means, key, "left").select("fp", "dims", "cell", "unit", "n", "centre")
    placed = placed.mapInArrow(near, "fp binary, dims int, cell long, unit binary, n long, away double")
    ball = F.when(F.col("away") <= half, F.unhex(F.concat(F.lpad(F.hex("cell"), 16, "0"), F.lpad(F.hex("dims"), 8, "0")))).otherwise(F.col("fp"))
    members = staged(placed.select("fp", "unit", "n", "dims", "cell", "away", ball.alias("ball")), "members")
    whole = members.where(F.col("away") <= half).groupBy("ball", *key).agg(F.max("away").alias("radius"), F.sum("n").alias("weight"))
    whole = with_small(whole, means, key, "inner").select("ball", "dims", "centre", "radius", "weight")
    to_array = lambda parts: (
        pa.RecordBatch.from_arrays([*(b.column(c) for c in ("ball", "dims")), pa.array([np.frombuffer(x, "<f8") for x in b.column("unit").to_pylist()], pa.list_(pa.float64())), b.column("weight")], ["ball", "dims", "centre", "weight"])
        for b in parts
    )
    alone = members.where(F.col("away") > half).select("ball", "dims", "unit", F.col("n").alias("weight")).mapInArrow(to_array, "ball binary, dims int, centre array<double>, weight long")
    found = whole.unionByName(alone.withColumn("radius", F.lit(0.0)))
    return staged(found, "balls"), members


def packed(balls: DataFrame) -> DataFrame:
    """(at, n, balls, radii, centres): balls of one length many to a row; ``at`` holds the length above its lower 32 bits and a number below."""
    room = F.greatest(F.least(F.lit(LEAF), F.floor(F.lit(ENTRIES) / F.col("dims"))), F.lit(1))
    sizes = staged(balls.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / F.first(room)).alias("rows")), "sizes")
    row = F.call_function("shiftleft", F.col("dims").cast("long"), F.lit(32)) + F.pmod(F.xxhash64("ball"), F.col("rows"))
    rows = with_small(balls, sizes, ["dims"], "inner").select(row.alias("at"), "ball", "radius", "centre")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        centres = np.array(rows.column("centre").chunk(0).flatten(), "<f4").tobytes()
        radii = rows.column("radius").to_numpy().astype("<f4").tobytes()
        names = pa.array([rows.column("ball").to_pylist()], pa.list_(pa.binary()))
        return pa.table([rows.column("at").slice(0, 1), pa.array([rows.num_rows]), names, pa.array([radii]), pa.array([centres])], names=["at", "n", "balls", "radii", "centres"])

    return staged(rows.groupBy("at").applyInArrow(pack, "at long, n long, balls array<binary>, radii binary, centres binary"), "packed")


def candidates(balls: DataFrame, similar: float) -> DataFrame:
    """Pairs (u, v) of balls that may hold links, each once: every packed row meets itself and the later ones of its length."""
    rows, far = packed(balls), np.float32(reach(similar))

    def compare(parts):
        for b in parts:
            u, v = [], []
            for i in range(b.num_rows):
                names, radii, centres = ([b.column(f"{side}_{c}")[i] for side in ("a", "b")] for c in ("balls", "radii", "centres"))
                r, s = (np.frombuffer(x.as_buffer(), "<f4") for x in radii)
                x, y = (np.frombuffer(c.as_buffer(), "<f4").reshape(len(n), -1) for c, n in zip(centres, (r, s), strict=True))
                same = b.column("a_at")[i] == b.column("b_at")[i]
                own, other = (x * x).sum(1), (y * y).sum(1)
                for lo in range(0, len(x), 512):
                    apart = own[lo : lo + 512, None] + other - 2 * (x[lo : lo + 512] @ y.T)
                    for j, k in zip(*np.nonzero(apart <= (far + r[lo : lo + 512, None] + s) ** 2 + np.float32(FLOAT_SLACK)), strict=True):
                        if not same or lo + j < k:
                            pair = names[0][int(lo + j)].as_py(), names[1][int(k)].as_py()
                            u.append(min(pair)), v.append(max(pair))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    side = lambda s: rows.select(*(F.col(c).alias(f"{s}_{c}") for c in ("at", "balls", "radii", "centres")))
    # no equal keys: each task reads a part of either side from the staged files, and nothing is shuffled
    met = side("a").join(side("b"), F.expr("a_at <= b_at and a_at >= shiftleft(shiftright(b_at, 32), 32)"))
    return staged(met.mapInArrow(compare, "u binary, v binary"), "candidates")


def judged(found: DataFrame, balls: DataFrame, similar: float) -> DataFrame:
    """(u, v, all: every member is linked to every other; else some may be) for the candidates that can hold links."""
    far = reach(similar)

    def verify(parts):
        for b in parts:
            if not b.num_rows:
                continue
            a, c = (b.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("cu", "cv"))
            start = b.column("cu").offsets.to_numpy()[:-1] - b.column("cu").offsets[0].as_py()
            r = b.column("ru").to_numpy() + b.column("rv").to_numpy()
            apart = np.sqrt(np.add.reduceat((a - c) ** 2, start))
            points = r == 0  # both are single vectors: the cosine decides
            some = np.where(points, np.add.reduceat(a * c, start) >= similar, apart - r <= far + SLACK)
            whole = np.where(points, some, apart + r <= far - SLACK)
            keep = pa.array(np.flatnonzero(some))
            yield pa.RecordBatch.from_arrays([b.column("u").take(keep), b.column("v").take(keep), pa.array(whole[some])], ["u", "v", "all"])

    side = lambda x: balls.select(F.col("ball").alias(x), F.col("centre").alias(f"c{x}"), F.col("radius").alias(f"r{x}"))
    both = found.join(side("u"), "u").join(side("v"), "v").select("u", "v", "cu", "cv", "ru", "rv")
    return staged(both.mapInArrow(verify, "u binary, v binary, all boolean"), "verdicts")


def members_linked(pairs: DataFrame, members: DataFrame, similar: float) -> DataFrame:
    """(fp, links, u, v) for each member of the balls ``pairs`` (u, v) that has links to the other ball, with the rows that these stand for."""
    sizes = members.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("k"))
    touched = pairs.select(F.col("u").alias("ball")).unionByName(pairs.select(F.col("v").alias("ball"))).distinct()
    sizes = staged(sizes.join(touched, "ball", "left_semi"), "parts")
    own = with_small(members, sizes, ["ball"], "inner").select("ball", "fp", "unit", "n", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int").alias("at"))
    pairs = pairs.join(sizes.select(F.col("ball").alias("u"), F.col("k").alias("ku")), "u").join(sizes.select(F.col("ball").alias("v"), F.col("k").alias("kv")), "v")
    tiles = staged(pairs.select("u", "v", F.explode(F.sequence(F.lit(0), F.col("ku") - 1)).alias("i"), "kv").select("u", "v", "i", F.explode(F.sequence(F.lit(0), F.col("kv") - 1)).alias("j")), "tiles")
    left = tiles.join(own.withColumnsRenamed({"ball": "u", "at": "i"}), ["u", "i"]).withColumn("side", F.lit(0))
    right = tiles.join(own.withColumnsRenamed({"ball": "v", "at": "j"}), ["v", "j"]).withColumn("side", F.lit(1))

    def compare(tile: pa.Table) -> pa.Table:
        side, x, n = tile.column("side").to_numpy(), _rows(tile.column("unit")), tile.column("n").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links = np.zeros(len(side), np.int64)
        for lo in range(0, len(a), 512):
            hit = x[a[lo : lo + 512]] @ x[b].T >= similar
            links[a[lo : lo + 512]] += hit @ n[b]
            links[b] += n[a[lo : lo + 512]] @ hit
        keep = pa.array(np.flatnonzero(links))
        return pa.table([tile.column("fp").take(keep), pa.array(links[links > 0]), tile.column("u").take(keep), tile.column("v").take(keep)], names=["fp", "links", "u", "v"])

    both = left.select("u", "v", "i", "j", "side", "fp", "unit", "n").unionByName(right.select("u", "v", "i", "j", "side", "fp", "unit", "n"))
    return staged(both.groupBy("u", "v", "i", "j").applyInArrow(compare, "fp binary, links long, u binary, v binary"), "linked")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similar: float = SIMILAR) -> DataFrame:
    """One row for each vector: id, n_links (other vectors of a cosine of at least ``similar``), component_id, kept.

    ``component_id`` is the smallest id reachable over links, ``kept`` whether
    it is the row's own.  All pairs at the threshold are found, whatever the
    vectors' lengths are; vectors of different lengths don't link.

    Vectors that are null, empty or zero, or hold null or non-finite entries,
    link with nothing.  Rows that repeat are vectors of their own, linked if not
    zero.  A null id never names a component that has another id.  Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = src.schema["id"].dataType.simpleString()
    wide = staged(src.mapInArrow(units, f"id {kind}, fp binary, dims int, cell long, unit binary").withColumn("salt", salt_of(F.col("id"), SALTS)), "units")
    rows = wide.select("id", "fp", "salt")
    valid = wide.where("fp is not null")
    # the class keeps one of its equal vectors; copies meet in partial sums before any shuffle
    classes = valid.groupBy("fp", "dims", "cell", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
    classes = staged(classes, "classes")
    found, members = balls(classes.select("fp", "dims", "cell", "unit", "n"), similar)
    verdicts = judged(candidates(found, similar), found, similar)
    whole = verdicts.where("all").select("u", "v")
    some = members_linked(verdicts.where("not all").select("u", "v"), members, similar)
    links = staged(whole.unionByName(some.select("u", "v").distinct()), "ball_links")
    roots = components(links)

    weights = found.select("ball", "weight")
    ends = whole.unionByName(whole.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = ends.join(weights.withColumnRenamed("ball", "v"), "v").groupBy(F.col("u").alias("ball")).agg(F.sum("weight").alias("others"))
    known = found.select("ball", "weight").join(others, "ball", "left").join(roots.withColumnRenamed("node", "ball"), "ball", "left")
    known = staged(known.select("ball", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("root", "ball").alias("root")), "known")
    extra = some.groupBy("fp").agg(F.sum("links").alias("extra"))
    # back from balls to classes, and from classes to rows by salts
    named = classes.select("fp", "first", "salts").join(members.select("fp", "ball"), "fp").join(known, "ball").join(extra, "fp", "left")
    named = staged(named.select("fp", "first", "salts", "root", (F.col("links") + F.coalesce("extra", F.lit(0))).cast("long").alias("n_links")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    told = named.join(least, "root").select("fp", F.explode(salts_in(F.col("salts"), SALTS)).alias("salt"), "n_links", "component_id", F.lit(True).alias("told"))
    out = rows.join(told, ["fp", "salt"], "left")
    component = F.when(F.col("told"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
