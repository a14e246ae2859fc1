"""Folds over speech that never pauses: rows in order stream through a task, which keeps no more than a run of a bounded size and one group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.session import work_dir


def runs_of(rows: DataFrame, key: str, size: int, ahead: int, following: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray], *cols: str) -> DataFrame:
    """(key, rows, starts, first_no, cut): the groups of ``rows`` (key, island, pos, cols) that begin in each run of ``size`` rows of a key, written once.

    ``following(columns, ends)`` is where the next group begins if one begins at
    each row, at most ``ahead`` rows later and no later than ``ends``, where the
    row's island does; columns are arrays of flags and whole numbers.  ``rows``
    of a run are those from its first group to the end of its last, which may
    lie in the next run; ``starts`` are its groups' places, ``first_no`` counts
    the key's groups before them, and ``cut`` tells that the island has other
    runs.  Runs that no group begins in are left out.

    The rows go through Arrow as the window below leaves them, each key's
    together and in order; a task checks that.  Where groups may begin is worked
    out for all rows of a batch at once, and only groups are walked one by one.
    """
    win = W.partitionBy(key).orderBy("pos")
    begins = ~F.col("island").eqNullSafe(F.lag("island").over(win)) | (F.col("_at") == 0)
    rows = rows.withColumn("_at", F.row_number().over(win) - 1).withColumn("_new", begins).select(key, "_at", "_new", "pos", *cols)
    told = rows.schema
    parts = ", ".join(f"{c}: {told[c].dataType.simpleString()}" for c in ("pos", *cols))
    plain = [c for c in cols if told[c].dataType.simpleString() in ("boolean", "int", "bigint")]

    def walk(batches):
        left, known = None, 0  # rows from the next group on, and the key's groups before it
        for batch in batches:
            held = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks().to_batches()
            if held:
                out, left, known = step(held[0], known, False)
                yield from out
        if left is not None and left.num_rows:
            yield from step(left, known, True)[0]

    def step(held, known, last):
        n = held.num_rows
        at, new = held.column("_at").to_numpy(), held.column("_new").to_numpy(zero_copy_only=False)
        if not np.all((at[1:] == at[:-1] + 1) | (at[1:] == 0)):
            raise ValueError("rows of a key are not together and in order")
        places = np.arange(n)
        islands = np.append(np.flatnonzero(new), n)
        ends = islands[np.searchsorted(islands, places, side="right")]
        edges = np.flatnonzero(new | (at % size == 0) | (places == 0))
        # runs whose groups end among the rows at hand
        stop = n
        if not last:
            fine = edges[(edges <= n - ahead - 1) | (edges == islands[-2] if len(islands) > 1 else False)]
            stop = int(fine[-1]) if len(fine) else 0
        if not stop:
            return [], held, known
        columns = {c: held.column(c).fill_null(0 if told[c].dataType.simpleString() != "boolean" else False).to_numpy(zero_copy_only=False) for c in plain}
        following_ = following(columns, ends).tolist()
        starts, i = [], 0
        while i < stop:
            starts.append(i)
            i = following_[i]
        starts = np.array(starts)
        # numbers within a key, whose first row begins a group
        numbers = np.arange(len(starts))
        of_key = np.maximum.accumulate(np.where(at[starts] == 0, numbers, -1))
        numbers = np.where(of_key < 0, numbers + known, numbers - of_key)
        run = np.searchsorted(edges, starts, side="right") - 1
        firsts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        own, after = edges[run[firsts]], np.append(edges, n)[run[firsts] + 1]
        whole = new[own] & ((after == n) | new[np.minimum(after, n - 1)])
        bounds = np.append(starts[firsts], i).astype(np.int32)
        values = pa.StructArray.from_arrays([held.column(c) for c in ("pos", *cols)], ["pos", *cols])
        places = (starts - np.repeat(starts[firsts], np.diff(np.append(firsts, len(starts))))).astype(np.int32)
        made = [
            held.column(key).take(pa.array(bounds[:-1])),
            pa.ListArray.from_arrays(pa.array(bounds), values),
            pa.ListArray.from_arrays(pa.array(np.append(firsts, len(starts)).astype(np.int32)), pa.array(places)),
            pa.array(numbers[firsts].astype(np.int32)),
            pa.array(~whole),
        ]
        known = 0 if i < n and at[i] == 0 else int(numbers[-1]) + 1
        return [pa.RecordBatch.from_arrays(made, [key, "rows", "starts", "first_no", "cut"])], held.slice(i), known

    runs = rows.mapInArrow(walk, f"{key} {told[key].dataType.simpleString()}, rows array<struct<{parts}>>, starts array<int>, first_no int, cut boolean")
    path = work_dir(rows.sparkSession, "runs")
    runs.write.parquet(path)
    return rows.sparkSession.read.schema(runs.schema).parquet(path)
