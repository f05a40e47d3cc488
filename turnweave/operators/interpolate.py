"""Missing times: filled from neighbours by place, and spread over gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import once

#: Least width of a word, in milliseconds.
MIN_WORD_MS = 100


def filled(value: str, order, method: str = "nearest") -> Column:
    """``value`` with gaps filled by place: nearest (of equals the left) or linear; ends take the outermost value.

    ``ignore`` leaves gaps. order: a window partitioned by group and ordered by place.
    """
    if method == "ignore":
        return F.col(value)
    at = F.row_number().over(order)
    known = F.when(F.col(value).isNotNull(), F.struct(at.alias("at"), F.col(value).alias("v")))
    left = F.last(known, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    right = F.first(known, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    if method == "nearest":
        between = F.when(at - left["at"] <= right["at"] - at, left["v"]).otherwise(right["v"])
    elif method == "linear":
        between = left["v"] + (right["v"] - left["v"]) * (at - left["at"]) / (right["at"] - left["at"])
    else:
        raise ValueError(f"no such method: {method}")
    return F.when(F.col(value).isNotNull(), F.col(value)).when(left.isNull(), right["v"]).when(right.isNull(), left["v"]).otherwise(between)


def fill_gaps(rows: DataFrame, group: list[str], place: str, columns: list[str], method: str = "nearest") -> DataFrame:
    """Fill each column on its own; groups where the first column is missing everywhere, or nowhere, stay as they are."""
    order = W.partitionBy(*group).orderBy(place)
    whole = W.partitionBy(*group)
    known = F.count(columns[0]).over(whole)
    some = (known > 0) & (known < F.count(F.lit(1)).over(whole))
    # Windows don't nest: places and neighbours first.
    rows = rows.withColumn("_some", some).withColumn("_at", F.row_number().over(order))
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(c).alias("v")))
        rows = rows.withColumn("_l", F.last(known, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
        rows = rows.withColumn("_r", F.first(known, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
        kind = rows.schema[c].dataType
        if method == "linear":
            between = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * (F.col("_at") - F.col("_l.at")) / (F.col("_r.at") - F.col("_l.at"))
        else:
            between = F.when(F.col("_at") - F.col("_l.at") <= F.col("_r.at") - F.col("_at"), F.col("_l.v")).otherwise(F.col("_r.v"))
        value = F.when(F.col(c).isNotNull() | ~F.col("_some"), F.col(c)).when(F.col("_l").isNull(), F.col("_r.v")).when(F.col("_r").isNull(), F.col("_l.v")).otherwise(between.cast(kind))
        rows = rows.withColumn(c, value if method != "ignore" else F.col(c))
    return rows.drop("_some", "_at", "_l", "_r")


def spread(rows: DataFrame, group: list[str], place: str) -> DataFrame:
    """Runs of words without times share the gap between their timed neighbours evenly (no borrowing).

    rows: group, place, start_ms, end_ms, from_ms and to_ms (bounds of the group). A run without an anchor, or with a gap below 0, stays untimed.
    """
    order = W.partitionBy(*group).orderBy(place)
    gap = F.col("start_ms").isNull()
    rows = rows.withColumn("_run", F.sum((~gap).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_left", F.last("end_ms", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_right", F.first("start_ms", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    own = W.partitionBy(*group, "_run", gap)
    n, k = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy(place)) - 1
    left, right = F.coalesce("_left", "from_ms"), F.coalesce("_right", "to_ms")
    rows = rows.withColumns({"_n": n, "_k": k, "_l": left, "_w": right - left})
    use = gap & (F.col("_w") >= 0)
    at = lambda i: F.col("_l") + F.floor(F.col("_w") * i / F.col("_n"))
    rows = rows.withColumns({"start_ms": F.when(use, at(F.col("_k"))).otherwise(F.col("start_ms")), "end_ms": F.when(use, at(F.col("_k") + 1)).otherwise(F.col("end_ms"))})
    return rows.drop("_run", "_left", "_right", "_n", "_k", "_l", "_w")


def time_words(words: Column, low: Column, high: Column, least: float = MIN_WORD_MS / 1000) -> Column:
    """A turn's words, (word, start, end) in seconds, with times for those that have none.

    Timed words are anchors, with the turn's bounds ``low`` and ``high`` beyond the
    outermost; a gap's words share the time between its anchors evenly. If that is
    less than ``least`` for each, the anchors give: each half of what lacks, more if
    the other can't, and never so much that it is itself shorter than ``least``. An
    anchor that a gap has shortened from the left has that much less for the next
    one. A gap without a bound, or whose bounds are out of order, stays untimed.
    """
    # The list is looked up for each gap, so it is computed once.
    return once(F.struct(words.alias("words"), low.alias("low"), high.alias("high")), lambda x: _timed(x["words"], x["low"], x["high"], least))


def _timed(words: Column, low: Column, high: Column, least: float) -> Column:
    kind = "array<struct<at:int,start:double,end:double>>"
    at = lambda w, i: F.struct(i.alias("at"), w["start"].alias("start"), w["end"].alias("end"))
    anchors = F.filter(F.transform(words, at), lambda a: a["start"].isNotNull()).cast(kind)
    none = F.lit(None).cast("double")
    lefts = lambda a: F.concat(F.array(F.struct(F.lit(-1).alias("at"), none.alias("start"), none.alias("end"))).cast(kind), a)
    rights = lambda a: F.concat(a, F.array(F.struct(F.size(words).alias("at"), none.alias("start"), none.alias("end"))).cast(kind))
    gaps = lambda x: F.zip_with(x["lefts"], x["rights"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    zero = F.struct(none.alias("start"), F.array().cast("array<struct<from:double,width:double,give:double,take:double>>").alias("out"))

    def step(state: Column, g: Column) -> Column:
        n = g["b"]["at"] - g["a"]["at"] - 1
        begin, end = F.coalesce(g["a"]["end"], low), F.coalesce(g["b"]["start"], high)
        spare = lambda a, b: F.greatest(F.coalesce(b - a - least, F.lit(0.0)), F.lit(0.0))
        left, right = spare(state["start"], g["a"]["end"]), spare(g["b"]["start"], g["b"]["end"])
        use = (n > 0) & (end >= begin)
        lack = F.when(use, F.greatest(n * least - (end - begin), F.lit(0.0))).otherwise(0.0)
        give = F.least(left, F.greatest(lack / 2, lack - right))
        take = F.least(right, lack - give)
        gap = F.struct(F.when(use, begin - give).alias("from"), F.when(use, (end - begin + give + take) / n).alias("width"), give.alias("give"), take.alias("take"))
        return F.struct((g["b"]["start"] + take).alias("start"), F.array_append(state["out"], gap).alias("out"))

    def rebuilt(x: Column) -> Column:
        def part(g: Column, k: Column) -> Column:
            a = F.get(x["lefts"], k)["at"]
            run = F.slice(words, a + 2, F.get(x["rights"], k)["at"] - a - 1)
            filled = F.transform(run, lambda w, j: F.struct(w["word"].alias("word"), (g["from"] + j * g["width"]).alias("start"), (g["from"] + (j + 1) * g["width"]).alias("end")))
            b = F.get(words, F.get(x["rights"], k)["at"])
            anchor = F.struct(b["word"].alias("word"), (b["start"] + g["take"]).alias("start"), (b["end"] - F.get(x["out"], k + 1)["give"]).alias("end"))
            return F.concat(filled, F.when(k + 1 < F.size(x["out"]), F.array(anchor)).otherwise(F.slice(filled, 1, 0)))

        return F.flatten(F.transform(x["out"], part))

    out = lambda x: F.aggregate(gaps(x), zero, step, lambda state: state["out"])
    sides = once(anchors, lambda a: F.struct(lefts(a).alias("lefts"), rights(a).alias("rights")))
    return once(sides, lambda x: once(F.struct(x["lefts"].alias("lefts"), x["rights"].alias("rights"), out(x).alias("out")), rebuilt))


def time_turns(words: DataFrame) -> DataFrame:
    """``time_words`` for each turn: recording_id, turn, word_idx, word, start, end, turn_start, turn_end (seconds)."""
    turns = words.groupBy("recording_id", "turn").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))).alias("w"), F.first("turn_start").alias("turn_start"), F.first("turn_end").alias("turn_end"))
    timed = turns.select("*", F.posexplode(time_words(F.col("w"), F.col("turn_start"), F.col("turn_end"))).alias("k", "t"))
    return timed.select("recording_id", "turn", F.get("w", F.col("k"))["word_idx"].alias("word_idx"), "t.word", "t.start", "t.end", "turn_start", "turn_end").select(*words.columns)
