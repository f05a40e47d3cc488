"""A session's whole record: its row, segments as they stand, turns, names, and translations with what is stale in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import resolved_label
from .turns import group_turns


def translated_segments(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """Segments with ``translations``: in order of languages structs (lang, text, stale), one for each language of the recording.

    entries: recording_id, lang, start_ms, src, tr. A segment takes its language's entry of the same start, if
    that translates the text as it is now; else, or without a start, its own text, stale.
    An entry without a source text is never stale.
    """
    languages = entries.select("recording_id", "lang").distinct()
    # All languages of a place come in one row, and so do all of a recording.
    known = entries.where("start_ms is not null").groupBy("recording_id", "start_ms").agg(F.array_sort(F.collect_list(F.struct("lang", "src", "tr"))).alias("entry"))
    languages = languages.groupBy("recording_id").agg(F.array_sort(F.collect_list("lang")).alias("langs"))
    rows = segments.join(known, ["recording_id", "start_ms"], "left").join(languages, "recording_id", "left")

    def shown(lang: Column) -> Column:
        e = F.get(F.filter("entry", lambda x: x["lang"] == lang), F.lit(0))
        fresh = F.coalesce(e.isNotNull() & (e["src"].isNull() | e["src"].eqNullSafe(F.col("text"))), F.lit(False))
        return F.struct(lang.alias("lang"), F.when(fresh, e["tr"]).otherwise(F.col("text")).alias("text"), (~fresh).alias("stale"))

    return rows.withColumn("translations", F.coalesce(F.transform("langs", shown), F.array())).drop("entry", "langs")


def details(sessions: DataFrame, segments: DataFrame, entries: DataFrame, names: DataFrame, edits: DataFrame) -> DataFrame:
    """One row for each session with its columns and names (a map), segments, turns, translations and can_undo.

    sessions: id and any further columns; segments: recording_id (a session's id), seg_idx, start_ms, end_ms, speaker, text, as
    ``edits.current`` gives them; entries as above; names: recording_id, speaker, name; edits: recording_id.
    segments are structs (seg_idx, start_ms, end_ms, speaker, label, text, translations), turns structs (turn,
    speaker, label, start_ms, end_ms, text), translations structs (lang, n, stale) that count segments. What a session hasn't is
    empty. Every table is grouped once by session, whatever their number.
    """
    key = F.col("recording_id").alias("id")
    called = names.where("speaker is not null").groupBy("recording_id", "speaker").agg(F.max("name").alias("name"))
    shown = resolved_label(F.col("speaker"), F.col("name"))
    segs = translated_segments(segments, entries).join(called, ["recording_id", "speaker"], "left")
    counts = segs.select("recording_id", F.explode("translations").alias("t")).groupBy("recording_id", "t.lang").agg(F.count("*").alias("n"), F.count_if("t.stale").alias("stale"))
    counts = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lang", "n", "stale"))).alias("translations"))
    segs = segs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start_ms", "end_ms", "speaker", shown.alias("label"), "text", "translations"))).alias("segments"))
    turns = group_turns(segments).join(called, ["recording_id", "speaker"], "left")
    turns = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", shown.alias("label"), "start_ms", "end_ms", "text"))).alias("turns"))
    by_id = called.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("speaker", "name"))).alias("names"))
    edited = edits.select(key).distinct().withColumn("can_undo", F.lit(True))
    out = sessions
    for part in (by_id, segs, turns, counts, edited):
        out = out.join(part, "id", "left")
    empty = {c: F.coalesce(c, F.array()) for c in ("segments", "turns", "translations")}
    return out.withColumns(empty | {"names": F.coalesce("names", F.create_map().cast("map<string,string>")), "can_undo": F.coalesce("can_undo", F.lit(False))})
