"""Running values along time over bins: a key's rows are spread over tasks, and only one row a bin is carried on.

A window over a whole recording sorts it in one task. Here rows are dealt out to bins of
time; each bin is summed up on the map side, the summaries (one row a key and bin, in
order of bins, across empty ones) give what a bin begins or ends with, and that
becomes a row before or after the bin's own rows. So a window over a bin sees the same as one
over the whole key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    """A running value: the ``last`` or ``next`` value that isn't null, or the ``sum`` or ``max`` so far.

    ``own``: whether a row's own value counts.
    """

    kind: str
    value: Column
    own: bool = True


def scan(rows: DataFrame, keys: list[str], order: list[str], width: int, **runs: Run) -> DataFrame:
    """Add a column for each run, along ``order`` within ``keys``.

    order: columns; the first is a number, and says which bin of ``width`` a row is in; rows
    where it is null come first, in a bin of their own. Rows that agree in all of ``order``
    may come either way round.
    """
    first = order[0]
    held = {f"_run_{name}": run.value for name, run in runs.items()}
    rows = rows.withColumns(held | {"_bin": F.floor(F.col(first) / width)})
    place = F.struct(*order)
    sums = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place)), "next": lambda c: F.min_by(c, F.when(c.isNotNull(), place))}
    bins = rows.groupBy(*keys, "_bin").agg(*(sums[run.kind](F.col(f"_run_{name}")).alias(f"_run_{name}") for name, run in runs.items()))
    by_bin = W.partitionBy(*keys).orderBy(F.col("_bin").asc_nulls_first())
    before, after = by_bin.rowsBetween(W.unboundedPreceding, -1), by_bin.rowsBetween(1, W.unboundedFollowing)
    over = {"sum": lambda c, w: F.sum(c).over(w), "max": lambda c, w: F.max(c).over(w), "last": lambda c, w: F.last(c, ignorenulls=True).over(w), "next": lambda c, w: F.first(c, ignorenulls=True).over(w)}
    sides = {0: [n for n, r in runs.items() if r.kind != "next"], 2: [n for n, r in runs.items() if r.kind == "next"]}
    whole = rows.withColumn("_side", F.lit(1))
    for side, names in sides.items():
        if names:
            carried = bins.select(*keys, "_bin", *(over[runs[n].kind](F.col(f"_run_{n}"), after if side else before).alias(f"_run_{n}") for n in names), F.lit(side).alias("_side"))
            whole = whole.unionByName(carried, allowMissingColumns=True)
    along = W.partitionBy(*keys, "_bin").orderBy("_side", *(F.col(c).asc_nulls_first() for c in order))
    done = {}
    for name, run in runs.items():
        skip = 0 if run.own else 1
        frame = along.rowsBetween(skip, W.unboundedFollowing) if run.kind == "next" else along.rowsBetween(W.unboundedPreceding, -skip)
        done[name] = over[run.kind](F.col(f"_run_{name}"), frame)
    return whole.withColumns(done).where("_side = 1").drop("_side", "_bin", *held)
