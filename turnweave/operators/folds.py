"""Greedy packing of ordered rows: chunks, batches, and regions of a score series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Run, scan

#: Frames of a bin, and milliseconds of a bin of regions.
FRAMES, SPANS_MS = 4096, 3_600_000


def ranges(items: Column, first: Column, cut, carry) -> Column:
    """(from, to) ranges, to exclusive, into which a fold cuts a list before each item that ``cut(state, item)`` holds for.

    first: the state before any item; carry(state, item, cut): the state after it.
    Only the cuts are gathered, so the fold's state stays small.
    """
    zero = F.struct(F.lit(0).alias("i"), first.alias("s"), F.array(F.lit(0)).alias("cuts"))

    def step(acc: Column, x: Column) -> Column:
        now = (acc["i"] > 0) & cut(acc["s"], x)
        cuts = F.when(now, F.array_append(acc["cuts"], acc["i"])).otherwise(acc["cuts"])
        return F.struct((acc["i"] + 1).alias("i"), carry(acc["s"], x, now | (acc["i"] == 0)).alias("s"), cuts.alias("cuts"))

    def zipped(acc: Column) -> Column:
        ends = F.array_append(F.slice(acc["cuts"], F.lit(2), F.size(acc["cuts"])), acc["i"])
        return F.arrays_zip(acc["cuts"].alias("from"), ends.alias("to"))

    return F.aggregate(items, zero, step, zipped)


def merge_chunks(spans: DataFrame, chunk_ms: int = 30_000) -> DataFrame:
    """Pack ordered spans into chunks of at most ``chunk_ms``; a longer single span stays whole."""
    rows = spans.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start_ms", "end_ms"))).alias("s"))
    none = F.lit(None).cast("long")
    first = F.struct(none.alias("from"), none.alias("to"))
    full = lambda a, x: (x["end_ms"] - a["from"] > chunk_ms) & (a["to"] - a["from"] > 0)
    carry = lambda a, x, cut: F.struct(F.when(cut, x["start_ms"]).otherwise(a["from"]).alias("from"), x["end_ms"].alias("to"))
    cut = rows.select("recording_id", "s", F.posexplode(ranges(F.col("s"), first, full, carry)).alias("chunk", "r"))
    own = cut.select("recording_id", F.col("chunk").cast("long").alias("chunk"), F.slice("s", F.col("r.from") + 1, F.col("r.to") - F.col("r.from")).alias("s"))
    segments = F.transform("s", lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms")))
    return own.select("recording_id", "chunk", F.col("s")[0]["start_ms"].alias("start_ms"), F.element_at("s", -1)["end_ms"].alias("end_ms"), F.size("s").cast("long").alias("n_segments"), segments.alias("segments"))


def batches(texts: DataFrame, most: int = 100, chars: int = 25_000) -> DataFrame:
    """Number the batches of a document's ordered texts: at most ``most`` texts and ``chars`` characters; a longer text goes alone.

    texts: doc, pos, text. Returns doc, pos, batch, place in the batch.
    """
    rows = texts.select("doc", "pos", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("t"))
    first = F.struct(F.lit(0).alias("count"), F.lit(0).cast("long").alias("chars"))
    full = lambda a, x: (a["count"] >= most) | (a["chars"] + x["n"] > chars)
    carry = lambda a, x, cut: F.struct(F.when(cut, 1).otherwise(a["count"] + 1).alias("count"), F.when(cut, x["n"]).otherwise(a["chars"] + x["n"]).alias("chars"))
    cut = rows.select("doc", "t", F.posexplode(ranges(F.col("t"), first, full, carry)).alias("batch", "r"))
    placed = cut.select("doc", "batch", F.posexplode(F.slice("t", F.col("r.from") + 1, F.col("r.to") - F.col("r.from"))).alias("place", "x"))
    return placed.select("doc", "x.pos", F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"))


def regions(scores: DataFrame, onset: float = 0.5, offset: float = 0.363, width: int = FRAMES) -> DataFrame:
    """Active regions of a score series, without a longest duration: on above ``onset``, off below ``offset``.

    scores: recording_id, frame, t_ms, score. The state at a frame is that of the
    last frame that decides it, carried from bin to bin of ``width`` frames, so neither a loop
    nor a task of a whole recording is needed.
    """
    decides = F.when(F.col("score") > onset, 1).when(F.col("score") < offset, 0)
    rows = scan(scores, ["recording_id"], ["frame"], width, on=Run("last", decides), was=Run("last", decides, own=False)).fillna(0, ["on", "was"])
    rows = scan(rows, ["recording_id"], ["frame"], width, region=Run("sum", ((F.col("on") == 1) & (F.col("was") == 0)).cast("long")))
    inside = rows.where("on = 1 or was = 1")  # the frame that switches off ends its region
    return inside.groupBy("recording_id", "region").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms")).withColumn("region", F.col("region") - 1)


def _pieces(scores: DataFrame, onset: float, offset: float, max_ms: int, width: int) -> DataFrame:
    """Parts of a recording in which regions don't depend on what came before: rows (recording_id, piece, frame, t_ms, score).

    After two frames in a row below ``offset`` no region is open, whatever cuts there
    were. If the next one is no longer than ``max_ms``, nothing cuts it, and the frame that ends it is
    known: from there on all goes as from a recording's first frame. That frame ends one piece and heads the next.
    All this holds where frames are evenly spaced (within half of the least step) and at most an eighteenth
    of ``max_ms`` apart: then a cut, in the later half of a region, leaves less than ``max_ms`` of it.
    Any other recording is one piece.
    """
    low, high = F.col("score") < offset, F.col("score") > onset
    key = ["recording_id"]
    rows = scan(scores, key, ["frame"], width, last=Run("last", F.struct("score", "t_ms"), own=False))
    rows = rows.withColumn("gap", F.col("t_ms") - F.col("last.t_ms"))
    uneven = (F.max("gap") * 18 > max_ms) | (F.max("gap") * 2 > F.min("gap") * 3)
    coarse = rows.groupBy(*key).agg(uneven.alias("uneven")).where("uneven").select(F.col("recording_id").alias("coarse"), "uneven")
    # What was decided last before a frame: nothing open for sure, or a frame that opens a region, with the time of the first such one.
    quiet = low & (F.col("last.score") < offset)
    rows = scan(rows, key, ["frame"], width, quiet=Run("last", F.when(quiet, F.col("frame")), own=False), ended=Run("last", F.when(low, F.col("frame")), own=False), loud=Run("last", F.when(high, F.col("frame")), own=False))
    opens = high & F.col("quiet").isNotNull() & (F.coalesce("loud", F.lit(-1).cast("long")) < F.col("quiet"))
    rows = scan(rows, key, ["frame"], width, opened=Run("last", F.when(opens, F.struct("frame", "t_ms")), own=False))
    known = low & F.col("opened").isNotNull() & (F.coalesce("ended", F.lit(-1).cast("long")) < F.col("opened.frame")) & (F.col("t_ms") - F.col("opened.t_ms") <= max_ms)
    rows = rows.join(coarse, rows["recording_id"].eqNullSafe(F.col("coarse")), "left").withColumn("sync", known & F.col("uneven").isNull()).drop("coarse", "uneven")
    rows = scan(rows, key, ["frame"], width, piece=Run("last", F.when(F.col("sync"), F.col("frame")), own=False))
    both = F.when(F.col("sync"), F.array("piece", "frame")).otherwise(F.array("piece"))
    return rows.withColumn("piece", F.explode(both)).select("recording_id", "piece", "frame", "t_ms", "score")


def binarize(scores: DataFrame, onset: float = 0.5, offset: float = 0.363, max_ms: int | None = None, min_on_ms: int = 0, min_off_ms: int = 0, pad_onset_ms: int = 0, pad_offset_ms: int = 0, width: int = FRAMES) -> DataFrame:
    """As ``regions``, and a region longer than ``max_ms`` is cut where its score is least, in the later half of it.

    A frame that causes a cut can't also end the region, and a region's scores
    begin with that of the last frame before it, both as the reference has it.
    Padded regions that then overlap are one, and those less than ``min_off_ms`` apart.
    Without ``max_ms`` regions come from scans over bins of ``width`` frames; with it a fold
    goes over each piece of a recording that stands by itself.
    """
    if max_ms is None:
        # A first frame above the onset opens a region as any other does.
        spans = regions(scores, onset, offset, width)
    else:
        spans = _cut_regions(_pieces(scores, onset, offset, max_ms, width), onset, offset, max_ms)
    spans = spans.select("recording_id", (F.col("start_ms").cast("long") - pad_onset_ms).alias("start_ms"), (F.col("end_ms").cast("long") + pad_offset_ms).alias("end_ms"))
    order = ["start_ms", "end_ms"]
    if pad_onset_ms or pad_offset_ms or min_off_ms:
        spans = scan(spans, ["recording_id"], order, SPANS_MS, reached=Run("max", F.col("end_ms"), own=False))
        gap = F.col("start_ms") - F.col("reached")
        new = (F.col("reached").isNull() | ((gap > 0) & (gap >= min_off_ms))).cast("int")
        spans = scan(spans, ["recording_id"], order, SPANS_MS, island=Run("sum", new))
        spans = spans.groupBy("recording_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")
    spans = spans.where(F.col("end_ms") - F.col("start_ms") >= min_on_ms)
    spans = scan(spans, ["recording_id"], order, SPANS_MS, region=Run("sum", F.lit(1).cast("long"), own=False))
    return spans.select("recording_id", F.coalesce("region", F.lit(0).cast("long")).alias("region"), "start_ms", "end_ms")


def _cut_regions(scores: DataFrame, onset: float, offset: float, max_ms: int) -> DataFrame:
    """Regions (recording_id, start_ms, end_ms) by a fold over each piece."""
    frames = scores.groupBy("recording_id", "piece").agg(F.array_sort(F.collect_list(F.struct("frame", "t_ms", "score"))).alias("f"))
    frames = frames.withColumn("f", F.transform("f", lambda x, i: F.struct(i.alias("i"), x["t_ms"].cast("long").alias("t"), x["score"].cast("double").alias("y"))))
    head = F.col("f")[0]
    # The scores searched for a cut: that of one earlier frame (-1: none), and of all from ``low`` on.
    zero = F.struct((head["y"] > onset).alias("on"), head["t"].alias("start"), F.lit(0).alias("earlier"), F.lit(1).alias("low"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("found"))

    def least(acc: Column, x: Column) -> Column:
        extra = (acc["earlier"] >= 0).cast("int")
        half = F.floor((x["i"] - acc["low"] + extra) / 2).cast("int")
        first = acc["low"] + F.greatest(half - extra, F.lit(0))
        later = F.transform(F.slice("f", first + 1, x["i"] - first), lambda y: F.struct(y["y"].alias("y"), y["i"].alias("i"), y["t"].alias("t")))
        one = F.get("f", F.greatest(acc["earlier"], F.lit(0)))
        both = F.when((extra == 1) & (half == 0), F.array_append(later, F.struct(one["y"].alias("y"), one["i"].alias("i"), one["t"].alias("t")))).otherwise(later)
        return F.array_min(both)

    def step(acc: Column, x: Column) -> Column:
        long = x["t"] - acc["start"] > max_ms
        cut = least(acc, x)
        state = lambda on, start, earlier, low, found: F.struct(on.alias("on"), start.alias("start"), earlier.alias("earlier"), low.alias("low"), found.alias("found"))
        closed = lambda to: F.array_append(acc["found"], F.struct(acc["start"].alias("from"), to.alias("to")))
        still = F.struct(F.lit(True).alias("on"), acc["start"].alias("start"), acc["earlier"].alias("earlier"), acc["low"].alias("low"), acc["found"].alias("found"))
        waiting = state(x["y"] > onset, F.when(x["y"] > onset, x["t"]).otherwise(acc["start"]), acc["earlier"], F.when(x["y"] > onset, x["i"] + 1).otherwise(acc["low"]), acc["found"])
        parted = state(F.lit(True), cut["t"], F.lit(-1), F.greatest(cut["i"] + 1, acc["low"]), closed(cut["t"]))
        ended = state(F.lit(False), acc["start"], x["i"], x["i"] + 1, closed(x["t"]))
        return F.when(~acc["on"], waiting).when(long, parted).when(x["y"] < offset, ended).otherwise(still)

    def finish(acc: Column) -> Column:
        return F.when(acc["on"], F.array_append(acc["found"], F.struct(acc["start"].alias("from"), F.element_at("f", -1)["t"].alias("to")))).otherwise(acc["found"])

    spans = frames.select("recording_id", F.explode(F.aggregate(F.slice("f", 2, F.size("f")), zero, step, finish)).alias("s"))
    return spans.select("recording_id", F.col("s.from").alias("start_ms"), F.col("s.to").alias("end_ms"))


def drop_short(spans: DataFrame, least_ms: int) -> DataFrame:
    return spans.where(F.col("end_ms") - F.col("start_ms") >= least_ms)
