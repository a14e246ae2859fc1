"""Helpers on ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_order(*cols: Column | str, order: str = "pos") -> Column:
    """Aggregate: the group's rows as an array of structs, sorted by ``order``, which becomes the first field.

    ``sort_array`` compares in the JVM's own code; ``array_sort`` would run a lambda for every comparison.
    """
    return F.sort_array(F.collect_list(F.struct(order, *cols)))


def let(value: Column, body) -> Column:
    """``body(value)``, with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut(rows: Column, starts: Column) -> Column:
    """The array in runs that begin at the places ``starts`` (from 0, rising)."""
    size = lambda at, s, i: F.coalesce(F.get(at, i + 1), F.size(rows)) - s
    return let(starts, lambda at: F.transform(at, lambda s, i: F.slice(rows, s + 1, size(at, s, i))))


def fold_starts(rows: Column, begins, state: dict, step) -> Column:
    """Places at which runs begin, found by a fold in the JVM.

    ``begins(s, x)`` tells whether row ``x`` begins a run, given the run's state
    ``s``; ``step(s, x, new)`` is the next state as a dict of ``state``'s fields.
    ``s["i"]`` counts the rows.
    """
    zero = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"), *[v.alias(k) for k, v in state.items()])

    def merge(s, x):
        def after(new):
            starts = F.when(new, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"])
            return F.struct((s["i"] + 1).alias("i"), starts.alias("starts"), *[v.alias(k) for k, v in step(s, x, new).items()])

        return let((s["i"] == 0) | begins(s, x), after)

    return F.aggregate(rows, zero, merge, lambda s: s["starts"])
