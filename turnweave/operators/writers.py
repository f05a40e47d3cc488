"""Transcripts as text: subtitles, tables, markdown. Each writer gives ordered lines for each recording."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.texts import blank, resolved_label, safe_arrow, strip
from ..functions.times import clock, timestamp


def _spoken(text: Column, form: str = "[%s]: ") -> Column:
    a, b = form.split("%s")
    return F.when(F.col("speaker").isNotNull(), F.concat(F.lit(a), F.col("speaker"), F.lit(b), text)).otherwise(text)


def _lines(rows: DataFrame, line: Column) -> DataFrame:
    return rows.select("recording_id", F.col("seg_idx").alias("line"), line.alias("text"))


def txt(segments: DataFrame) -> DataFrame:
    return _lines(segments, _spoken(strip(F.coalesce("text", F.lit("")))))


def cues(segments: DataFrame) -> DataFrame:
    """One cue a segment (no words, default layout): recording_id, seg_idx, start_ms, end_ms, text."""
    text = _spoken(safe_arrow(strip(F.coalesce("text", F.lit("")))))
    return segments.select("recording_id", "seg_idx", "start_ms", "end_ms", text.alias("text"))


def srt(cue_rows: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("recording_id").orderBy("seg_idx"))
    rows = cue_rows.withColumn("_n", n)
    line = F.concat(F.col("_n").cast("string"), F.lit("\n"), timestamp(F.col("start_ms"), ",", True), F.lit(" --> "), timestamp(F.col("end_ms"), ",", True), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _lines(rows, line)


def vtt(cue_rows: DataFrame) -> DataFrame:
    line = F.concat(timestamp(F.col("start_ms")), F.lit(" --> "), timestamp(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    head = cue_rows.select("recording_id").distinct().select("recording_id", F.lit(-1).cast("long").alias("line"), F.lit("WEBVTT\n").alias("text"))
    return head.unionByName(_lines(cue_rows, line))


def tsv(segments: DataFrame) -> DataFrame:
    text = F.replace(strip(F.coalesce("text", F.lit(""))), F.lit("\t"), F.lit(" "))
    head = segments.select("recording_id").distinct().select("recording_id", F.lit(-1).cast("long").alias("line"), F.lit("start\tend\ttext").alias("text"))
    return head.unionByName(_lines(segments, F.concat_ws("\t", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), text)))


def aud(segments: DataFrame) -> DataFrame:
    text = F.replace(strip(F.coalesce("text", F.lit(""))), F.lit("\t"), F.lit(" "))
    seconds = lambda c: (F.col(c) / 1000).cast("string")
    return _lines(segments, F.concat_ws("\t", seconds("start_ms"), seconds("end_ms"), _spoken(text, "[[%s]]")))


def json(segments: DataFrame) -> DataFrame:
    body = F.array_sort(F.collect_list(F.struct("seg_idx", F.struct(F.col("start_ms").alias("start_ms"), "end_ms", "text", "speaker").alias("s"))))
    rows = segments.groupBy("recording_id").agg(F.transform(body, lambda x: x["s"]).alias("segments"))
    return rows.select("recording_id", F.lit(0).cast("long").alias("line"), F.to_json(F.struct("segments")).alias("text"))


def markdown(turns: DataFrame, names: DataFrame | None = None, title: str = "# Transcript") -> DataFrame:
    """One text a recording: title, then for each turn with text its label, span and text.

    turns: recording_id, turn, speaker, start_ms, end_ms, text; names: recording_id, speaker, name.
    """
    rows = turns.join(names, ["recording_id", "speaker"], "left") if names is not None else turns.withColumn("name", F.lit(None).cast("string"))
    head = F.concat(F.lit("**"), resolved_label(F.col("speaker"), F.col("name")), F.lit("** ["), clock(F.col("start_ms")), F.lit(" – "), clock(F.col("end_ms")), F.lit("]"))
    part = F.when(~blank(F.col("text")), F.struct("turn", F.concat(head, F.lit("\n\n"), strip(F.col("text"))).alias("part")))
    parts = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"])
    body = rows.groupBy("recording_id").agg(F.array_join(parts, "\n\n").alias("body"))
    return body.select("recording_id", F.concat(F.lit(f"{title}\n\n"), F.when(F.col("body") == "", "_No speech detected._").otherwise(F.col("body")), F.lit("\n")).alias("text"))


def rttm(spans: DataFrame) -> DataFrame:
    """SPEAKER lines with seconds to three places. spans: recording_id, ord, speaker, s_start, s_end."""
    seconds = lambda ms: F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col("recording_id").cast("string"), F.lit("1"), seconds(F.col("s_start")), seconds(F.col("s_end") - F.col("s_start")), F.lit("<NA> <NA>"), F.col("speaker"), F.lit("<NA> <NA>"))
    return spans.select("recording_id", F.col("ord").alias("line"), line.alias("text"))


def numbered(cues: DataFrame, recordings: DataFrame, split: bool = True, vtt: bool = False) -> tuple[DataFrame, DataFrame]:
    """A subtitle file of each recording as lines (recording_id, line, text), and how many cues each has (recording_id, n).

    cues: recording_id, seg_idx, part, start, end (seconds), text; recordings: recording_id. Cues are written only if they were
    ``split``; a file without any has its head alone (VTT) or is empty. All are counted either way.
    """
    n = F.row_number().over(W.partitionBy("recording_id").orderBy("seg_idx", "part"))
    stamp = lambda c: timestamp(F.bround(F.col(c) * 1000, 0).cast("long"), "." if vtt else ",", True)
    lines = cues.withColumn("line", n.cast("long")).select(
        "recording_id", "line", F.concat(F.col("line").cast("string"), F.lit("\n"), stamp("start"), F.lit(" --> "), stamp("end"), F.lit("\n"), strip(F.coalesce("text", F.lit(""))), F.lit("\n")).alias("text")
    )
    if not split:
        lines = lines.limit(0)
    head = recordings.select("recording_id").distinct().select("recording_id", F.lit(0).cast("long").alias("line"), F.lit("WEBVTT\n").alias("text"))
    counts = recordings.select("recording_id").distinct().join(cues.groupBy("recording_id").agg(F.count("*").alias("n")), "recording_id", "left").fillna(0, ["n"])
    return (head.unionByName(lines) if vtt else lines), counts


WRITERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "txt": txt, "vtt": lambda s: vtt(cues(s)), "srt": lambda s: srt(cues(s)), "tsv": tsv, "json": json, "aud": aud,
}
#: What ``all`` stands for.
ALL = ("txt", "vtt", "srt", "tsv", "json")


def writers(form: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The writers of one form, or of all but Audacity labels."""
    if form == "all":
        return {k: WRITERS[k] for k in ALL}
    if form not in WRITERS:
        raise ValueError(f"no such form: {form}")
    return {form: WRITERS[form]}


def save(lines: DataFrame, path: str) -> None:
    """Text files, one folder a recording, lines in order."""
    rows = lines.repartition("recording_id").sortWithinPartitions("recording_id", "line")
    rows.select("recording_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("recording_id").text(path)


def basename(path: Column, extension: str) -> Column:
    """The file's name with its last suffix replaced."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(f".{extension}"))
