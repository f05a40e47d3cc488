"""Speaker turns: gaps and islands over a recording's segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.texts import blank, strip
from .folds import ranges
from .scans import Run, scan

#: Segments of a bin.
SEGMENTS = 4096
#: Seconds below which a piece of a turn is joined to its neighbour, in milliseconds.
SLIVER_MS = 200


def with_turns(segments: DataFrame, width: int = SEGMENTS) -> DataFrame:
    """Add ``turn``: from 0, one more where the speaker changes; null and empty are one speaker.

    The speaker before and the number of changes are carried over bins of ``width`` segments.
    """
    key, order = ["recording_id"], ["seg_idx"]
    rows = segments.withColumn("speaker", F.nullif(F.col("speaker"), F.lit("")))
    rows = scan(rows, key, order, width, _before=Run("last", F.struct("speaker"), own=False))
    new = F.when(F.col("_before").isNotNull() & ~F.col("_before.speaker").eqNullSafe(F.col("speaker")), 1).otherwise(0)
    return scan(rows, key, order, width, turn=Run("sum", new.cast("long"))).drop("_before")


def joined_text(separator: str = " ") -> Column:
    """Non-empty stripped texts in segment order."""
    ordered = F.array_sort(F.collect_list(F.when(~blank(F.col("text")), F.struct("seg_idx", strip(F.col("text")).alias("text")))))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), separator)


def group_turns(segments: DataFrame) -> DataFrame:
    """One row for each turn: first start, last segment's end, texts joined."""
    rows = with_turns(segments).groupBy("recording_id", "turn")
    return rows.agg(
        F.first("speaker", ignorenulls=True).alias("speaker"),
        F.min_by("start_ms", "seg_idx").alias("start_ms"), F.max_by("end_ms", "seg_idx").alias("end_ms"),
        F.min("seg_idx").alias("seg_first"), F.max("seg_idx").alias("seg_last"), F.count("*").alias("n_segments"), joined_text().alias("text"),
    )


def speakers(segments: DataFrame) -> DataFrame:
    """Distinct speakers in order of first appearance."""
    found = segments.where(F.coalesce("speaker", F.lit("")) != "").groupBy("recording_id", "speaker").agg(F.min("seg_idx").alias("seg_idx"))
    place = F.row_number().over(W.partitionBy("recording_id").orderBy("seg_idx")) - 1
    return found.withColumn("place", place.cast("long"))


def next_speaker_key(keys: DataFrame) -> DataFrame:
    """For each recording the key after the greatest SPEAKER_n; gaps don't matter."""
    number = F.regexp_extract("speaker", r"^SPEAKER_(\d+)$", 1).try_cast("long")
    following = F.coalesce(F.max(number), F.lit(-1)) + 1
    return keys.groupBy("recording_id").agg(following.alias("n")).select("recording_id", F.concat(F.lit("SPEAKER_"), F.format_string("%02d", "n")).alias("speaker"))


def coalesce_segments(segments: DataFrame, sliver_ms: int = SLIVER_MS, width: int = SEGMENTS) -> DataFrame:
    """Join short pieces within each turn until they reach ``sliver_ms``; a short rest joins the piece before.

    A segment that is long enough by itself ends a piece, whatever came before it. So a turn is cut after
    each of them, with a short rest left to the last part, and a fold over a part's segments finds
    where its pieces end: no list is as long as a turn. Missing times count as 0.
    """
    length = F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0)).cast("long")
    rows = with_turns(segments, width).withColumn("ms", length)
    key, whole = ["recording_id", "turn"], F.col("ms") >= sliver_ms
    rows = scan(rows, key, ["seg_idx"], width, part=Run("sum", whole.cast("long"), own=False), ahead=Run("next", F.when(whole, F.lit(True))))
    rest = F.sum("ms").over(W.partitionBy(*key, "part"))
    short = F.col("ahead").isNull() & (F.col("part") > 0) & (rest < sliver_ms)
    rows = rows.withColumn("part", F.coalesce("part", F.lit(0).cast("long"))).withColumn("part", F.col("part") - short.cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "ms", "start_ms", "end_ms", strip(F.coalesce("text", F.lit(""))).alias("text"))))
    turn = rows.groupBy(*key, "part").agg(F.first("speaker", ignorenulls=True).alias("speaker"), ordered.alias("segs"))
    enough = lambda held, x: held >= sliver_ms  # noqa: E731  the piece before is complete
    carry = lambda held, x, cut: F.when(cut, x["ms"]).otherwise(held + x["ms"])
    pieces = ranges(F.col("segs"), F.lit(0).cast("long"), enough, carry)
    piece = lambda r: F.slice("segs", r["from"] + 1, r["to"] - r["from"])
    sums = lambda r: F.aggregate(piece(r), F.lit(0).cast("long"), lambda a, x: a + x["ms"])
    turn = turn.withColumn("pieces", pieces)
    # A last piece that is too short belongs to the one before it.
    n = F.size("pieces")
    short = (n > 1) & (sums(F.element_at("pieces", -1)) < sliver_ms)
    merged = F.transform("pieces", lambda r, k: F.when(short & (k == n - 2), F.struct(r["from"].alias("from"), F.element_at("pieces", -1)["to"].alias("to"))).otherwise(r))
    turn = turn.withColumn("pieces", F.slice(merged, F.lit(1), n - short.cast("int")))
    flat = turn.select("recording_id", "speaker", "segs", F.explode("pieces").alias("r")).select("recording_id", "speaker", piece(F.col("r")).alias("p"))
    known = lambda field: F.transform(F.filter("p", lambda x: x[field].isNotNull()), lambda x: x[field])
    texts = F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != "")
    out = flat.select(
        "recording_id", "speaker", F.get(known("start_ms"), F.lit(0)).alias("start_ms"), F.try_element_at(known("end_ms"), F.lit(-1)).alias("end_ms"),
        F.array_join(texts, " ").alias("text"), F.col("p")[0]["seg_idx"].alias("from_idx"), F.element_at("p", -1)["seg_idx"].alias("to_idx"),
    )
    out = scan(out, ["recording_id"], ["from_idx"], width, seg_idx=Run("sum", F.lit(1).cast("long")))
    return out.withColumn("seg_idx", F.col("seg_idx") - 1)
