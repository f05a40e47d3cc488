"""The sample tables read as transcript tables, and the same as SQL.

Recordings are users, segments their events in order of time, speakers the kinds
of events. Time runs 600 times faster, so that neighbouring segments overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Microseconds of 2024-01-01, where the events begin.
EPOCH_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, seg_idx, event_id, start_ms, end_ms (some null), speaker (some null), text (some empty)."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    start = F.floor(us / 600_000)
    kind = F.col("event_type")
    speaker = F.when(kind == "click", "SPEAKER_00").when(kind == "view", "SPEAKER_01").when(kind == "signup", "SPEAKER_02").when(kind == "purchase", "guest")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("recording_id"), place.cast("long").alias("seg_idx"), "event_id", start.alias("start_ms"),
        F.when(F.col("event_id") % 29 != 0, start + F.floor(F.col("value") * 1000)).alias("end_ms"), speaker.alias("speaker"),
        F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.concat(F.lit(" "), kind, F.lit(" no "), (F.col("event_id") % 100).cast("string"))).alias("text"),
    )


SEGMENTS = f"""
seg AS (
  SELECT user_id AS recording_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seg_idx, event_id,
         CAST((epoch_us(ts) - {EPOCH_US}) // 600000 AS BIGINT) AS start_ms,
         CASE WHEN event_id % 29 != 0 THEN CAST((epoch_us(ts) - {EPOCH_US}) // 600000 AS BIGINT) + CAST(floor(value * 1000) AS BIGINT) END AS end_ms,
         CASE event_type WHEN 'click' THEN 'SPEAKER_00' WHEN 'view' THEN 'SPEAKER_01' WHEN 'signup' THEN 'SPEAKER_02' WHEN 'purchase' THEN 'guest' END AS speaker,
         CASE WHEN event_id % 13 = 0 THEN ' ' ELSE ' ' || event_type || ' no ' || CAST(event_id % 100 AS VARCHAR) END AS text
  FROM events
)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's words with times spread over it, some missing: recording_id, seg_idx, word_idx, word, start_ms, end_ms, speaker, seg_start, seg_end."""
    rows = segments(spark, sf_dir).where("end_ms is not null").select("*", F.posexplode(F.split(F.trim("text"), " ")).alias("word_idx", "word")).where("word != ''")
    width = F.floor((F.col("end_ms") - F.col("start_ms")) / 3)
    some = (F.col("event_id") + F.col("word_idx")) % 5 != 0
    start = F.col("start_ms") + width * F.col("word_idx")
    return rows.select(
        "recording_id", "seg_idx", F.col("word_idx").cast("long").alias("word_idx"), "word", F.when(some, start).alias("w_start"), F.when(some, start + width).alias("w_end"),
        "speaker", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"),
    ).withColumnsRenamed({"w_start": "start_ms", "w_end": "end_ms"})


WORDS = (
    SEGMENTS
    + """,
words AS (
  SELECT recording_id, seg_idx, word_idx, word,
         CASE WHEN (event_id + word_idx) % 5 != 0 THEN start_ms + (end_ms - start_ms) // 3 * word_idx END AS start_ms,
         CASE WHEN (event_id + word_idx) % 5 != 0 THEN start_ms + (end_ms - start_ms) // 3 * (word_idx + 1) END AS end_ms,
         speaker, start_ms AS seg_start, end_ms AS seg_end
  FROM (SELECT *, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS word_idx, unnest(parts) AS word
        FROM (SELECT *, string_split(trim(text), ' ') AS parts FROM seg WHERE end_ms IS NOT NULL)) WHERE word != ''
)"""
)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as probes: recording_id, probe_id, p_start, p_end; some of length 0."""
    rows = segments(spark, sf_dir).where("speaker = 'SPEAKER_00'")
    return rows.select("recording_id", F.col("event_id").alias("probe_id"), F.col("start_ms").alias("p_start"), F.coalesce("end_ms", "start_ms").alias("p_end"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other events as speaker spans: recording_id, ord, speaker, s_start, s_end."""
    rows = segments(spark, sf_dir).where("speaker != 'SPEAKER_00' and end_ms is not null")
    return rows.select("recording_id", F.col("seg_idx").alias("ord"), "speaker", F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"))


SPANS = (
    SEGMENTS
    + """,
probes AS (SELECT recording_id, event_id AS probe_id, start_ms AS p_start, coalesce(end_ms, start_ms) AS p_end FROM seg WHERE speaker = 'SPEAKER_00'),
spans AS (SELECT recording_id, seg_idx AS ord, speaker, start_ms AS s_start, end_ms AS s_end FROM seg WHERE speaker != 'SPEAKER_00' AND end_ms IS NOT NULL)"""
)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions: id, filename, status, stage, error, duration_ms, num_segments, created_at."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 7 == 0, "queued").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderkey") % 2 == 0, "error").otherwise("done")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("clip."), F.col("o_orderpriority"), F.lit(".wav"))).alias("filename"), status.alias("status"),
        F.when(status == "running", "aligning").alias("stage"), F.when(status == "error", "no speech").alias("error"),
        F.when(F.col("o_orderkey") % 5 != 0, F.floor("o_totalprice") * 20).alias("duration_ms"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 90).cast("long").alias("num_segments"),
        F.when(F.col("o_orderkey") % 17 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("created_at"),
    )


SESSIONS = """
sessions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 11 != 0 THEN 'clip.' || o_orderpriority || '.wav' END AS filename, status,
         CASE WHEN status = 'running' THEN 'aligning' END AS stage, CASE WHEN status = 'error' THEN 'no speech' END AS error,
         CASE WHEN o_orderkey % 5 != 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 20 END AS duration_ms,
         CASE WHEN o_orderkey % 3 != 0 THEN CAST(o_orderkey % 90 AS BIGINT) END AS num_segments,
         CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS created_at
  FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'queued' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'running'
                       WHEN o_orderkey % 2 = 0 THEN 'error' ELSE 'done' END AS status FROM orders)
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, hash, size, group (source)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size"), F.col("source").alias("group"), "doc_id")


FILES = """
files AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256(text) AS hash, n_chars AS size, source AS "group", doc_id FROM documents)"""
