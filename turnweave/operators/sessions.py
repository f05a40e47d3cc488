"""Sessions: cards, summaries, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times

#: Status, label, chip, viewable.
STATUS = (("queued", "Queued", "wait", False), ("running", "Processing", "run", False), ("done", "Transcribed", "ok", True), ("error", "Failed", "err", False))
OPTIONS = "language string, min_speakers int, max_speakers int"
TRANSLATIONS = "map<string, struct<status: string, service: string, error: string>>"


def _of_status(status: Column, field: int, default) -> Column:
    out = None
    for row in STATUS:
        test = status == row[0]
        out = F.when(test, F.lit(row[field])) if out is None else out.when(test, F.lit(row[field]))
    return out.otherwise(F.lit(default))


def cards(sessions: DataFrame) -> DataFrame:
    """sessions: id, filename, status, duration_ms, num_segments, created_at (ISO text)."""
    status = F.col("status")
    return sessions.select(
        "id", F.coalesce("filename", F.lit("")).alias("title"), "status",
        _of_status(status, 1, "Unprocessed").alias("label"), _of_status(status, 2, "").alias("chip"), _of_status(status, 3, False).alias("viewable"),
        bucket(status).alias("bucket"), F.when(F.col("duration_ms").isNull(), "").otherwise(times.duration(F.col("duration_ms"))).alias("length"),
        F.coalesce(F.col("num_segments").cast("long"), F.lit(0).cast("long")).alias("num_segments"), times.date(F.col("created_at")).alias("date"),
    )


def bucket(status: Column) -> Column:
    return F.when(status.isin("queued", "running"), "pending").when(status == "error", "failed").otherwise("done")


def decoded(sessions: DataFrame) -> DataFrame:
    """JSON columns as structs; what can't be read is empty."""
    options, translations = F.from_json("options", OPTIONS), F.from_json("translations", TRANSLATIONS)
    return sessions.withColumn("options", options).withColumn("translations", F.coalesce(translations, F.create_map().cast(TRANSLATIONS)))


def listed(sessions: DataFrame) -> DataFrame:
    """Newest first."""
    return sessions.orderBy(F.desc("created_at"), F.desc("id"))


def summary(sessions: DataFrame) -> DataFrame:
    length = F.coalesce("duration_ms", F.lit(0))
    done = F.col("status") == "done"
    n, n_done = F.count("*"), F.count_if(done)
    whole, finished = F.coalesce(F.sum(length), F.lit(0)), F.coalesce(F.sum(F.when(done, length)), F.lit(0))
    share = F.when(n == 0, 0).otherwise(F.rint(n_done * 100 / n)).cast("long")
    return sessions.agg(n.alias("total"), n_done.alias("done"), share.alias("done_pct"), whole.cast("long").alias("total_ms"), finished.cast("long").alias("done_ms"))


def active(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("status").isin("queued", "running"))


def any_active(sessions: DataFrame) -> DataFrame:
    """One row: whether any session is active. One match is enough to look for."""
    return active(sessions).limit(1).agg((F.count("*") > 0).alias("busy"))


def featured(sessions: DataFrame) -> DataFrame:
    """The first of the listed sessions."""
    return listed(sessions).limit(1)


def prefix(segments: DataFrame, length_ms: int = 30_000) -> DataFrame:
    """recording_id and the text of the segments that start in its first ``length_ms``."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), "")
    return segments.where((F.col("start_ms") >= 0) & (F.col("start_ms") < length_ms)).groupBy("recording_id").agg(said.alias("text"))


def setting(settings: DataFrame, key: str, default: str | None) -> DataFrame:
    """One row with the value of a setting, or the default."""
    return settings.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("value"))


def names(speaker_names: DataFrame) -> DataFrame:
    """A map from speaker to name for each session; of repeated keys the last holds."""
    pairs = speaker_names.groupBy("session_id", "speaker_key").agg(F.max_by("name", "seq").alias("name"))
    return pairs.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker_key", "name")))).alias("names"))


def state(events: DataFrame) -> DataFrame:
    """Each session's state after its events: the last, but done and error stay. events: id, seq, status."""
    ends = F.col("status").isin("done", "error")
    final = F.min_by("status", F.when(ends, F.col("seq")))
    last = F.max_by("status", "seq")
    return events.groupBy("id").agg(F.coalesce(F.when(F.max(ends), final), last).alias("status"), F.count("*").alias("n_events"))


def until_final(events: DataFrame) -> DataFrame:
    """Events up to and including the first final one of each session."""
    order = W.partitionBy("id").orderBy("seq")
    over = F.max(F.col("status").isin("done", "error").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("_over", F.coalesce(over, F.lit(0))).where("_over = 0").drop("_over")


#: The stages of a job in order.
STAGES = ("decoding", "transcribing", "loading_align", "aligning", "diarizing")


def stage_order(stages: DataFrame) -> DataFrame:
    """For each job whether its stages come in order without gaps. stages: id, seq, stage."""
    number = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    order = W.partitionBy("id").orderBy("seq")
    right = number == F.coalesce(F.lag(number).over(order), F.lit(0)) + 1
    return stages.withColumn("_right", right).groupBy("id").agg(F.bool_and("_right").alias("in_order"), F.count("*").alias("n"))


def requeued(sessions: DataFrame) -> DataFrame:
    """After a crash: queued and running sessions are queued, their stage and error gone."""
    was = F.col("status").isin("queued", "running")
    return sessions.withColumns({"requeued": was, "stage": F.when(~was, F.col("stage")), "error": F.when(~was, F.col("error")), "status": F.when(was, "queued").otherwise(F.col("status"))})


def rising(progress: DataFrame) -> DataFrame:
    """Only progress above all before. progress: id, seq, pct."""
    before = F.max("pct").over(W.partitionBy("id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return progress.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("pct") > F.col("_b"))).drop("_b")


def backup_state(facts: DataFrame) -> DataFrame:
    """facts: enabled, linked, activity, conflict, dirty."""
    value = F.when(~F.col("enabled"), "disabled").when(~F.col("linked"), "unlinked").when(F.col("activity").isNotNull(), F.col("activity")).when(F.col("conflict"), "conflict").when(F.col("dirty"), "dirty").otherwise("idle")
    return facts.withColumn("state", value)


def removed(sessions: DataFrame, names_: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and speaker names without those of ``gone`` (id)."""
    return sessions.join(gone, "id", "left_anti"), names_.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_anti")


def translation_status(events: DataFrame) -> DataFrame:
    """Per session and language the last status; its error only if that is error; the last service named.

    events: id, lang, seq, status, service, error.
    """
    return events.groupBy("id", "lang").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("service", F.when(F.col("service").isNotNull(), F.col("seq"))).alias("service"),
        F.max_by(F.when(F.col("status") == "error", F.col("error")), "seq").alias("error"),
    )


def queue_times(jobs: DataFrame) -> DataFrame:
    """When each job of one serial worker begins and ends. jobs: worker, job, arrives, takes.

    A job ends at the greatest, over jobs up to it, of that job's arrival plus all work from it on.
    """
    order = W.partitionBy("worker").orderBy("arrives", "job")
    work = F.sum("takes").over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = jobs.withColumn("_work", work)
    slack = F.max(F.col("arrives") - F.col("_work") + F.col("takes")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("ends", slack + F.col("_work"))
    return rows.withColumn("begins", F.col("ends") - F.col("takes")).drop("_work")


def newest_model(models: DataFrame) -> DataFrame:
    """models: name, path, vendored_at, priority; the newest, of equals the highest priority."""
    return models.groupBy("name").agg(F.max_by("path", F.struct("vendored_at", "priority")).alias("path"))
