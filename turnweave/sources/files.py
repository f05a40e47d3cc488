"""Transcripts, overlays, manifests, RTTM, TSV and audio as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import to_ms
from . import schemas


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON transcripts as segments: recording_id (the file's name), seg_idx, start_ms, end_ms, text, speaker, words."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = spark.read.schema(schemas.TRANSCRIPT).json(path, multiLine=True).select(name.alias("recording_id"), "language", F.posexplode("segments").alias("seg_idx", "s"))
    words = F.transform("s.words", lambda w: F.struct(w["word"].alias("word"), to_ms(w["start"]).alias("start_ms"), to_ms(w["end"]).alias("end_ms"), w["score"].alias("score"), F.nullif(w["speaker"], F.lit("")).alias("speaker")))
    return rows.select("recording_id", "language", F.col("seg_idx").cast("long").alias("seg_idx"), to_ms(F.col("s.start")).alias("start_ms"), to_ms(F.col("s.end")).alias("end_ms"), "s.text", F.nullif("s.speaker", F.lit("")).alias("speaker"), words.alias("words"))


def overlays(spark: SparkSession, path: str) -> DataFrame:
    """Translation overlays, one file each: recording_id, lang, start_ms, src, tr."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = spark.read.schema(schemas.OVERLAY).json(path, multiLine=True).select(name.alias("recording_id"), F.col("target_language").alias("lang"), F.explode("entries").alias("key", "e"))
    return rows.select("recording_id", "lang", to_ms(F.col("key").try_cast("double")).alias("start_ms"), "e.src", "e.tr")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as rows (path, hash, size, mtime, generation)."""
    rows = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)
    return rows.select("generation", F.explode("entries").alias("path", "e")).select("path", "e.*", "generation")


def tree(spark: SparkSession, path: str) -> DataFrame:
    """A folder's files with their hashes: path, hash, size, mtime_ns."""
    root = path.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = F.regexp_replace("path", "^file:/+", "/")
    return rows.select(F.substring(plain, F.lit(len(root) + 1), F.length(plain)).alias("path"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")).where(~F.col("path").endswith(".tmp"))


def rttm(spark: SparkSession, path: str) -> DataFrame:
    """Turns of RTTM files: recording_id, ord, s_start, s_end, speaker."""
    return parse_rttm(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


def parse_rttm(lines: DataFrame) -> DataFrame:
    """lines: value, ord."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    rows = lines.select("ord", parts.alias("p")).where((F.size("p") >= 8) & (F.get("p", F.lit(0)) == "SPEAKER"))
    start, length = to_ms(F.get("p", F.lit(3)).try_cast("double")), to_ms(F.get("p", F.lit(4)).try_cast("double"))
    return rows.select(F.get("p", F.lit(1)).alias("recording_id"), "ord", start.alias("s_start"), (start + length).alias("s_end"), F.get("p", F.lit(7)).alias("speaker"))


def corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A corpus table of tab-separated values with a head line."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="")


def usable_clips(clips: DataFrame, least_ms: int, most_ms: int) -> DataFrame:
    """Clips of fitting length whose sentence isn't empty without its [markers]. clips: sentence, duration_ms."""
    text = F.trim(F.regexp_replace("sentence", r"\[[^\]]*\]", ""))
    return clips.withColumn("sentence", text).where((F.col("sentence") != "") & F.col("duration_ms").between(least_ms, most_ms))


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """Audio files as bytes; decoding is a plug-in (``plugins.Decoder``)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("recording_id"), F.col("content").alias("bytes"), "length")


def env(spark: SparkSession, path: str) -> DataFrame:
    """KEY=VALUE lines; a comment goes where the value isn't quoted. Spark skips files whose names begin with a dot."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*([A-Za-z_]\w*)\s*=", 1).alias("key"), F.regexp_extract("value", r"^[^=]*=(.*)$", 1).alias("value")).where("key != ''")
    plain = F.trim("value")
    return rows.select("key", F.when(plain.rlike("^[\"']"), plain).otherwise(F.trim(F.regexp_replace(plain, r"\s#.*$", ""))).alias("value"))
