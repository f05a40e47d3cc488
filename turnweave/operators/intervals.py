"""Joins on time intervals: overlap, dominant speaker, nearest, as-of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import Run, scan

#: Width of a bin of the binned join.
BIN_MS = 60_000


def overlaps(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of probes and spans of a recording that share time, with ``overlap_ms``.

    probes: recording_id, probe_id, p_start, p_end; spans: recording_id, ord, speaker, s_start, s_end.
    A probe of length 0 overlaps nothing.
    """
    pairs = probes.join(spans, "recording_id").where((F.col("s_start") < F.col("p_end")) & (F.col("s_end") > F.col("p_start")))
    return _overlap(pairs)


def _overlap(pairs: DataFrame) -> DataFrame:
    shared = F.least("p_end", "s_end") - F.greatest("p_start", "s_start")
    return pairs.withColumn("overlap_ms", shared).where("overlap_ms > 0")


def binned_overlaps(probes: DataFrame, spans: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """The same pairs, for long recordings: both sides are dealt out to time bins.

    A pair meets in each bin that both touch, and counts in the one where its
    overlap begins, so no distinct is needed.
    """
    bins = lambda start, end: F.explode(F.sequence(F.floor(F.col(start) / bin_ms), F.floor(F.greatest(F.col(start), F.col(end) - 1) / bin_ms)))
    some = lambda rows, start, end: rows.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    left = some(probes, "p_start", "p_end").withColumn("bin", bins("p_start", "p_end"))
    right = some(spans, "s_start", "s_end").withColumn("bin", bins("s_start", "s_end"))
    pairs = left.join(right, ["recording_id", "bin"]).where(F.col("bin") == F.floor(F.greatest("p_start", "s_start") / bin_ms))
    return _overlap(pairs).drop("bin")


def dominant_speaker(probes: DataFrame, spans: DataFrame, nearest: bool = False, binned: bool = True) -> DataFrame:
    """Each probe with the speaker it shares most time with; of equals the one whose span comes first.

    ``nearest``: a probe that overlaps nothing takes the span whose middle is nearest, of equals the first.
    """
    join = binned_overlaps if binned else overlaps
    each = join(probes, spans).groupBy("recording_id", "probe_id", "speaker").agg(F.sum("overlap_ms").alias("overlap_ms"), F.min(F.struct("s_start", "ord")).alias("first"))
    best = each.groupBy("recording_id", "probe_id").agg(F.max_by(F.struct("speaker", "overlap_ms"), F.struct("overlap_ms", -F.col("first.s_start"), -F.col("first.ord"))).alias("best"))
    out = probes.join(best, ["recording_id", "probe_id"], "left").select(probes["*"], F.col("best.speaker").alias("speaker"), F.coalesce("best.overlap_ms", F.lit(0).cast("long")).alias("overlap_ms"))
    if not nearest:
        return out
    # One sort for all probes costs less than finding the lone ones twice.
    near = nearest_span(probes, spans).select("recording_id", "probe_id", F.col("speaker").alias("near"))
    return out.join(near, ["recording_id", "probe_id"], "left").withColumn("speaker", F.coalesce("speaker", "near")).drop("near")


def nearest_span(probes: DataFrame, spans: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Each probe with the span whose middle is nearest.

    The last span middle at or before the probe's and the first after it are
    carried along time from bin to bin, so a recording's rows are neither paired nor sorted in one task.
    """
    middle = lambda start, end: F.col(start) + F.col(end)  # noqa: E731  twice the middle, in whole numbers
    known = spans.where("s_start is not null and s_end is not null").withColumn("mid", middle("s_start", "s_end"))
    # Of spans with one middle only the first can be chosen.
    known = known.groupBy("recording_id", "mid").agg(F.min_by(F.struct("s_start", "ord", "speaker"), F.struct("s_start", "ord")).alias("span"))
    asked = probes.where("p_start is not null and p_end is not null").withColumn("mid", middle("p_start", "p_end"))
    asked = asked.select("recording_id", "mid", F.lit(1).alias("kind"), "probe_id", F.lit(None).cast(known.schema["span"].dataType).alias("span"))
    both = known.select("recording_id", "mid", F.lit(0).alias("kind"), F.lit(None).cast(asked.schema["probe_id"].dataType).alias("probe_id"), "span").unionByName(asked)
    at = F.when(F.col("span").isNotNull(), F.struct("mid", "span"))
    rows = scan(both, ["recording_id"], ["mid", "kind"], 2 * bin_ms, back=Run("last", at), ahead=Run("next", at)).where("kind = 1")
    gap = lambda c: F.abs(F.col("mid") - F.col(f"{c}.mid"))
    choice = F.array_min(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(gap(c).alias("gap"), F.col(f"{c}.span.s_start").alias("s_start"), F.col(f"{c}.span.ord").alias("ord"), F.col(f"{c}.span.speaker").alias("speaker"))) for c in ("back", "ahead")))))
    return rows.withColumn("choice", choice).where("choice is not null").select("recording_id", "probe_id", "choice.speaker", F.col("choice.gap").alias("gap2_ms"))


def as_of(asks: DataFrame, words: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Each ask (recording_id, ask_id, at_ms) with the last word that starts by then, carried from bin to bin of time."""
    rows = words.where("start_ms is not null").select("recording_id", F.col("start_ms").alias("at"), F.lit(0).alias("kind"), F.col("word_idx").alias("place"), F.struct("start_ms", "word_idx", "word").alias("w"), F.lit(None).cast(asks.schema["ask_id"].dataType).alias("ask_id"))
    asked = asks.select("recording_id", F.col("at_ms").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["place"].dataType).alias("place"), F.lit(None).cast(rows.schema["w"].dataType).alias("w"), "ask_id")
    found = scan(rows.unionByName(asked), ["recording_id"], ["at", "kind", "place"], bin_ms, found=Run("last", F.col("w"))).where("kind = 1")
    return found.select("recording_id", "ask_id", F.col("at").alias("at_ms"), "found.word_idx", "found.word")


def active_speakers(spans: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Distinct speakers with any time in a window."""
    return spans.where((F.col("s_start") < end_ms) & (F.col("s_end") > start_ms) & (F.least("s_end", F.lit(end_ms)) > F.greatest("s_start", F.lit(start_ms)))).select("recording_id", "speaker").distinct()


def support(spans: DataFrame, collar_ms: int, bin_ms: int = BIN_MS) -> DataFrame:
    """Union of spans of a recording; gaps of at most ``collar_ms`` close."""
    order = ["s_start", "s_end"]
    rows = scan(spans, ["recording_id"], order, bin_ms, before=Run("max", F.col("s_end"), own=False))
    rows = rows.withColumn("new", F.coalesce((F.col("s_start") - F.col("before") > collar_ms).cast("int"), F.lit(1)))
    rows = scan(rows, ["recording_id"], order, bin_ms, island=Run("sum", F.col("new")))
    return rows.groupBy("recording_id", "island").agg(F.min("s_start").alias("s_start"), F.max("s_end").alias("s_end"), F.count("*").alias("n")).drop("island")
