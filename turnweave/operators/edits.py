"""Edits of turns: splices, reassignments, a log with undo."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import once
from .interpolate import time_words

#: Edits that a recording's log keeps.
HISTORY = 100


def kept_places(was: list[str], now: list[str]) -> list[int]:
    """For each new word the place of the old word that it still is, else -1: the longest common run, then those on both sides of it.

    As ``difflib``'s matching blocks without junk, of which short lists cost it mostly its preparations.
    """
    out, at = [-1] * len(now), {}
    for i, w in enumerate(now):
        at.setdefault(w, []).append(i)
    left = [(0, len(was), 0, len(now))]
    while left:
        low, high, begin, end = left.pop()
        best, first, to, runs = 0, 0, 0, {}
        for i in range(low, high):
            runs, before = {}, runs
            for j in at.get(was[i], ()):
                if begin <= j < end:
                    n = runs[j] = before.get(j - 1, 0) + 1
                    if n > best:
                        best, first, to = n, i - n + 1, j - n + 1
        if best:
            out[to : to + best] = range(first, first + best)
            left += [(low, first, begin, to), (first + best, high, to + best, end)]
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def kept_words(old: pa.Array, new: pa.Array) -> pa.Array:
    """``kept_places`` of two columns of lists."""
    return pa.array([kept_places(a, b) for a, b in zip(old.to_pylist(), new.to_pylist())], pa.list_(pa.int32()))


def realign(turns: DataFrame) -> DataFrame:
    """Rows (recording_id, turn, words, text, start, end) with the words of the edited text.

    Words that stay keep their times, new ones are timed between them; a turn of
    which no time stays has no words.
    """
    timed = lambda w: w["start"].isNotNull() & w["end"].isNotNull()
    old = F.coalesce("words", F.array().cast("array<struct<word:string,start:double,end:double>>"))
    new = F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    rows = turns.withColumns({"_old": F.transform(old, lambda w: F.trim(F.coalesce(w["word"], F.lit("")))), "_new": new, "_was": old})
    rows = rows.withColumn("_kept", kept_words("_old", "_new"))

    def word(w: Column, i: Column) -> Column:
        was = F.get("_was", F.nullif(F.get("_kept", i), F.lit(-1)))
        return F.struct(w.alias("word"), F.when(timed(was), was["start"]).cast("double").alias("start"), F.when(timed(was), was["end"]).cast("double").alias("end"))

    def timed_words(words: Column) -> Column:
        known = F.exists(words, lambda w: w["start"].isNotNull())
        return F.when(known, time_words(words, F.col("start").cast("double"), F.col("end").cast("double"))).otherwise(F.slice(words, 1, 0))

    return rows.withColumn("words", once(F.transform("_new", word), timed_words)).select(*turns.columns)


def splice(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace a range of each recording's segments by one, or by none where the text is blank, and number anew.

    edits: recording_id, lo, hi, new_text, one row a recording.
    """
    rows = segments.join(edits, "recording_id", "left")
    inside = F.col("lo").isNotNull() & F.col("seg_idx").between(F.col("lo"), F.col("hi"))
    kept = rows.where(~inside).select("recording_id", "seg_idx", "speaker", "start_ms", "end_ms", "text")
    new = rows.where(inside).groupBy("recording_id").agg(
        F.min("seg_idx").alias("seg_idx"), F.min_by("speaker", "seg_idx").alias("speaker"), F.min_by("start_ms", "seg_idx").alias("start_ms"),
        F.max_by("end_ms", "seg_idx").alias("end_ms"), F.first("new_text").alias("text"),
    )
    new = new.where(F.trim("text") != "")
    place = F.row_number().over(W.partitionBy("recording_id").orderBy("seg_idx")) - 1
    return kept.unionByName(new).withColumn("seg_idx", place.cast("long"))


def turn_ranges(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of turns (recording_id, turn, new_text) as edits of segments; a turn that isn't there raises."""
    both = edits.join(turns.select("recording_id", "turn", "seg_first", "seg_last"), ["recording_id", "turn"], "left")
    lo = F.when(F.col("seg_first").isNull(), F.raise_error(F.concat(F.lit("no such turn: "), F.col("turn").cast("string")))).otherwise(F.col("seg_first"))
    return both.select("recording_id", lo.cast("long").alias("lo"), F.col("seg_last").alias("hi"), "new_text")


def reassign(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """Give ranges of segments another speaker. changes: recording_id, lo, hi, new_speaker, one row a recording."""
    rows = segments.join(changes, "recording_id", "left")
    inside = F.col("lo").isNotNull() & F.col("seg_idx").between(F.col("lo"), F.col("hi"))
    rows = rows.withColumn("changed", inside & ~F.nullif(F.col("speaker"), F.lit("")).eqNullSafe(F.col("new_speaker")))
    rows = rows.withColumn("speaker", F.when(inside, F.col("new_speaker")).otherwise(F.col("speaker")))
    if "words" in segments.columns:
        names = [f.name for f in segments.schema["words"].dataType.elementType.fields]
        if "speaker" in names:
            rows = rows.withColumn("words", F.when(inside, F.transform("words", lambda w: w.withField("speaker", F.col("new_speaker")))).otherwise(F.col("words")))
    return rows.drop("lo", "hi", "new_speaker")


def recent(log: DataFrame, most: int = HISTORY) -> DataFrame:
    """The newest ``most`` edits of each recording."""
    newest = F.row_number().over(W.partitionBy("recording_id").orderBy(F.desc("seq")))
    return log.withColumn("_n", newest).where(F.col("_n") <= most).drop("_n")


def standing(log: DataFrame) -> DataFrame:
    """Edits that no undo took back: an undo removes the newest that stands, and nothing if none does.

    log: recording_id, seq, kind (edit, reassign or undo). Depths as in matching
    brackets: an edit is undone if the depth falls below its own later on.
    """
    order = W.partitionBy("recording_id").orderBy("seq")
    step = F.when(F.col("kind") == "undo", -1).otherwise(1)
    rows = log.withColumn("_s", F.sum(step).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # Undos of nothing don't count: the sum minus its least value so far (0 at most).
    rows = rows.withColumn("depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(order.rowsBetween(W.unboundedPreceding, 0))))
    later = F.min("depth").over(order.rowsBetween(1, W.unboundedFollowing))
    return rows.withColumn("_later", later).where((F.col("kind") != "undo") & (F.col("_later").isNull() | (F.col("_later") >= F.col("depth")))).drop("_s", "_later", "depth")


def undo_last(segments: DataFrame, log: DataFrame) -> DataFrame:
    """Put back the segments of each recording's newest delta. log: recording_id, seq, lo, new_len, old_segments (structs like the segments)."""
    last = log.withColumn("_n", F.row_number().over(W.partitionBy("recording_id").orderBy(F.desc("seq")))).where("_n = 1").select("recording_id", "lo", "new_len", "old_segments")
    columns = ["speaker", "start_ms", "end_ms", "text"]
    rows = segments.join(last.select("recording_id", "lo", "new_len"), "recording_id", "left")
    kept = rows.where(F.col("lo").isNull() | (F.col("seg_idx") < F.col("lo")) | (F.col("seg_idx") >= F.col("lo") + F.col("new_len")))
    kept = kept.select("recording_id", F.struct(F.col("seg_idx").alias("a"), F.lit(0).alias("b")).alias("at"), *columns)
    back = last.select("recording_id", "lo", F.posexplode("old_segments").alias("b", "s")).select("recording_id", F.struct((F.col("lo") - 1).cast("long").alias("a"), (F.col("b") + 1).alias("b")).alias("at"), *(F.col(f"s.{c}").alias(c) for c in columns))
    place = F.row_number().over(W.partitionBy("recording_id").orderBy("at")) - 1
    return kept.unionByName(back).withColumn("seg_idx", place.cast("long")).drop("at")


def current(original: DataFrame, overlay: DataFrame) -> DataFrame:
    """The overlay's segments for recordings that have one, else the original's."""
    have = overlay.select("recording_id").distinct()
    return overlay.unionByName(original.join(have, "recording_id", "left_anti"), allowMissingColumns=True)


def latest(events: DataFrame, key: list[str], order: str, value: str, drop: Column | None = None) -> DataFrame:
    """Upserts as a fold: the last value of each key; keys whose last value ``drop`` holds for are gone."""
    last = events.groupBy(*key).agg(F.max_by(value, order).alias(value))
    return last if drop is None else last.where(~drop)


def enrol(keys: DataFrame, names: DataFrame, wanted: DataFrame) -> DataFrame:
    """A new speaker's key and name for each recording; a name that is taken, whatever its case, raises.

    keys: recording_id, speaker; names: recording_id, speaker, name; wanted: recording_id, name.
    """
    from ..functions.texts import speaker_label
    from .turns import next_speaker_key

    known = keys.select("recording_id", "speaker").unionByName(names.select("recording_id", "speaker")).distinct()
    labels = known.select("recording_id", F.lower(speaker_label(F.col("speaker"))).alias("taken"))
    taken = labels.unionByName(names.select("recording_id", F.lower("name").alias("taken"))).distinct().withColumn("clash", F.lit(True))
    both = wanted.withColumn("taken", F.lower("name")).join(taken, ["recording_id", "taken"], "left").join(next_speaker_key(known), "recording_id", "left")
    name = F.when(F.col("clash"), F.raise_error(F.concat(F.lit("name taken: "), F.col("name")))).otherwise(F.col("name"))
    return both.select("recording_id", F.coalesce("speaker", F.lit("SPEAKER_00")).alias("speaker"), name.alias("name"))
