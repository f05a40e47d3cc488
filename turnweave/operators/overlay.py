"""Translations laid over segments, fresh or stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .writers import WRITERS


def entries(segments: DataFrame, translated: DataFrame) -> DataFrame:
    """Overlay entries from segments and translations of equal place; without a start none; the last of equal starts holds.

    segments: recording_id, seg_idx, start_ms, text; translated: recording_id, seg_idx, tr.
    """
    both = segments.where("start_ms is not null").join(translated, ["recording_id", "seg_idx"])
    return both.groupBy("recording_id", "start_ms").agg(F.max_by(F.struct(F.col("text").alias("src"), "tr"), "seg_idx").alias("e")).select("recording_id", "start_ms", "e.src", "e.tr")


def translated(segments: DataFrame, overlay: DataFrame) -> DataFrame:
    """Segments with their translation where the text is still the one translated, else their own text, stale.

    An entry without a source text counts as fresh, an empty translation too.
    """
    found = segments.join(overlay.withColumn("_has", F.lit(True)), ["recording_id", "start_ms"], "left")
    fresh = F.coalesce(F.col("_has"), F.lit(False)) & (F.col("src").isNull() | F.col("src").eqNullSafe(F.col("text")))
    out = found.withColumn("stale", ~fresh).withColumn("text", F.when(fresh, F.col("tr")).otherwise(F.col("text")))
    return out.drop("src", "tr", "_has")


def exported(segments: DataFrame, entries: DataFrame, lang: str, form: str) -> DataFrame:
    """Lines of a translation in a writer's form, from the segments as they stand now; recordings without the language have none.

    entries: recording_id, lang, start_ms, src, tr.
    """
    own = entries.where(F.col("lang") == lang).drop("lang")
    known = segments.join(own.select("recording_id").distinct(), "recording_id", "left_semi")
    return WRITERS[form](translated(known, own))


def legacy_entries(rows: DataFrame) -> DataFrame:
    """Entries of the older form, which keeps no source text: recording_id, start_ms, text, place."""
    newest = F.row_number().over(W.partitionBy("recording_id", "start_ms").orderBy(F.desc("place")))
    kept = rows.where("start_ms is not null").withColumn("_n", newest).where("_n = 1")
    return kept.select("recording_id", "start_ms", F.lit(None).cast("string").alias("src"), F.col("text").alias("tr"))
