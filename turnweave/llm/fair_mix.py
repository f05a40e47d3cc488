"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are put in a shuffled order that depends on their ids
alone. A document's virtual finish time is the source's words up to and
including it, divided by the source's target; a second copy of the source
follows the first. All copies in order of finish time, cut off at the total
budget, are the mix, so every source comes near its target.

Running sums go in two steps: about sqrt(n) slices of a source's order are
summed, and only the sums and the rows of one slice are ever ordered together.
Sources are few (their weights are set by hand); documents are not.

Defined results: null text has size 0; a null source is a source of its own,
the last; a source of size 0 has target 0; rows that repeat count each; equal
finish times are taken together; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: By place of the source in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: No source gives more than so many times its words.
COPIES = 2
#: Up to so many rows the table of sources is broadcast, else joined as it is.
FEW_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """Add ``target`` to rows (source, source_size): shares of the budget by weight, none above its limit."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    limit = F.col("source_size").cast("double") * copies
    rows = sources.withColumn("weight", weight).withColumn("limit", limit).withColumn("rate", F.col("limit") / F.col("weight"))
    order = W.orderBy("rate", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(everything).cast("double") * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / rest)
    level = F.min(F.when(F.col("level") <= F.col("rate"), F.struct("rate", "level"))).over(everything)["level"]
    target = F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", target.alias("target"), "n")


def finish_times(docs: DataFrame, doc: str, text: str, source: str, weights: tuple[int, ...], share: float, copies: int, scratch: Scratch) -> DataFrame:
    """Rows (doc, source, size, source_size, target, through): ``through`` are the source's words up to the document."""
    sized = docs.select(
        F.col(doc).alias("doc"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = scratch.keep(sized, "sized")
    sources = scratch.keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, copies), "sources")
    if sources.count() <= FEW_SOURCES:
        sources = F.broadcast(sources)
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))))
    slices = F.ceil(F.sqrt("n"))
    rows = sized.withColumn("key", key).join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("slice", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * slices))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    sums = sums.select("source", "slice", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    sums = sums.withColumnsRenamed({"source": "s_source", "slice": "s_slice"})
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["s_source"]) & (rows["slice"] == sums["s_slice"]))
    within = W.partitionBy("source", "slice").orderBy("key", "doc", "size").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("doc", "source", "size", "source_size", "target", (F.col("before") + F.sum("size").over(within)).alias("through"))


def _time(copy: int) -> Column:
    """A document's finish time in a copy of its source; null where the source has no target."""
    return F.when(F.col("target") > 0, (F.col("source_size") * copy + F.col("through")) / F.col("target"))


def fair_mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """For each document doc, size, source_size, target, taken (words), copies, and finish, its first copy's time."""
    scratch = Scratch(docs.sparkSession, "fair-mix")
    rows = scratch.keep(finish_times(docs, doc, text, source, weights, share, copies, scratch), "times")
    n, budget = rows.select(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)) * F.lit(float(share))).first()
    units = rows.select("size", F.explode(F.array(*(_time(c) for c in range(copies)))).alias("finish")).where("finish is not null")
    parts = max(1, int(n**0.5))
    units = units.withColumn("slice", F.floor(F.col("finish") * parts))
    upto = F.sum("words").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, 0))
    cut = units.groupBy("slice").agg(F.sum("size").alias("words")).withColumn("upto", upto).where(F.col("upto") > budget).agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before")))).first()[0]
    taken = F.lit(True)
    if cut is not None:
        inside = units.where(F.col("slice") == cut["slice"]).groupBy("finish").agg(F.sum("size").alias("words"))
        inside = inside.withColumn("upto", F.sum("words").over(W.orderBy("finish").rowsBetween(W.unboundedPreceding, 0)) + cut["before"])
        last = inside.where(F.col("upto") <= budget).agg(F.max("finish")).first()[0]
    counts = F.lit(0)
    for c in range(copies):
        if cut is not None:
            time = _time(c)
            taken = F.floor(time * parts) < cut["slice"]
            taken = taken | (time <= last) if last is not None else taken
        counts = counts + F.when(_time(c).isNotNull() & taken, 1).otherwise(0)
    return rows.withColumn("copies", counts).select(
        F.col("doc").alias(doc), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", _time(0).alias("finish"), F.col("source").alias(source)
    )


def mixed(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: a row for each copy taken, range-sorted by finish time."""
    rows = fair_mix(docs, doc, text, source, **options)
    units = rows.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)")))
    finish = F.col("finish") + F.col("copy") * F.col("source_size") / F.col("target")
    return units.select(doc, source, "size", "copy", finish.alias("finish")).repartitionByRange("finish", doc).sortWithinPartitions("finish", doc)
