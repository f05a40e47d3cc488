"""Streams of job, translation and channel events.

Every function takes a streaming (or batch) DataFrame and returns one; where state
is custom it lives in ``applyInPandasWithState``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINAL = ("done", "error")
#: Events that a subscriber's buffer holds.
BUFFER = 64


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each session and language, for output mode update or complete. events: id, lang, seq, status."""
    return events.groupBy("id", "lang").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def until_final(events: DataFrame) -> DataFrame:
    """Each session's events up to its first final one; what comes later is dropped. events: id, seq, status."""
    kind = events.schema["id"].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over = state.get[0] if state.exists else False
        rows = pd.concat(list(parts)).sort_values("seq")
        if not over:
            ends = rows["status"].isin(FINAL).to_numpy()
            n = int(ends.argmax()) + 1 if ends.any() else len(rows)
            state.update((bool(ends.any()),))
            yield rows.iloc[:n][["id", "seq", "status"]]

    return events.select("id", "seq", "status").groupBy("id").applyInPandasWithState(step, f"id {kind}, seq long, status string", "over boolean", "append", GroupStateTimeout.NoTimeout)


def bounded_channel(events: DataFrame, size: int = BUFFER) -> DataFrame:
    """What a subscriber that reads nothing in between keeps of each channel: the first ``size`` events; a drain event makes room.

    events: channel, seq, kind (event or drain), payload. Never blocks; the newest are dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        keep = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            if r.kind == "drain":
                held = 0
            elif held < size:
                held += 1
                keep.append((r.channel, r.seq, r.payload))
        state.update((held,))
        yield pd.DataFrame(keep, columns=["channel", "seq", "payload"])

    kind = events.schema["channel"].dataType.simpleString()
    return events.select("channel", "seq", "kind", "payload").groupBy("channel").applyInPandasWithState(step, f"channel {kind}, seq long, payload string", "held long", "append", GroupStateTimeout.NoTimeout)


def initial_events(sessions: DataFrame, eta: Column) -> DataFrame:
    """What a subscriber hears first: id, event, stage, eta_ms. A final status is itself; else the stage with its estimate, or the status.

    sessions: id, status, stage, and what ``eta`` needs.
    """
    going = ~F.col("status").isin(*FINAL)
    event = F.when(going & F.col("stage").isNotNull(), "stage").otherwise(F.col("status"))
    return sessions.select("id", event.alias("event"), F.when(going, F.col("stage")).alias("stage"), F.when(going & F.col("stage").isNotNull(), eta.cast("long")).alias("eta_ms"))


def with_initial(events: DataFrame, sessions: DataFrame, eta: Column | None = None) -> DataFrame:
    """Live events joined with what their session's durable row says first, as columns first, first_stage and first_eta_ms."""
    first = initial_events(sessions, F.lit(None) if eta is None else eta).withColumnsRenamed({"event": "first", "stage": "first_stage", "eta_ms": "first_eta_ms"})
    return events.join(first, "id", "left")


def language_maps(events: DataFrame) -> DataFrame:
    """Each session's languages with their latest statuses: id, statuses (structs of lang and status, by lang). For the batch that a subscriber gets first; ``latest_status`` streams the deltas."""
    return latest_status(events).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("lang", "status"))).alias("statuses"))


def transitions(events: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """The events at which a key's state differs from the one before, for batches (models' and backup's broadcasts)."""
    was = F.lag(state).over(W.partitionBy(key).orderBy(seq))
    return events.withColumn("_was", was).where(~F.col(state).eqNullSafe(F.col("_was"))).drop("_was")


def streamed_transitions(events: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """``transitions`` of a stream, whose events come in order of ``seq`` from batch to batch; never ends."""
    kinds = dict(events.dtypes)

    def step(group: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(seq)
        was = rows[state].shift()
        if held.exists:
            was.iloc[0] = held.get[0]
        held.update((rows[state].iloc[-1],))
        yield rows[(rows[state] != was)][[key, seq, state]]

    return events.select(key, seq, state).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {seq} {kinds[seq]}, {state} {kinds[state]}", f"{state} {kinds[state]}", "append", GroupStateTimeout.NoTimeout)


def one_shot(results: DataFrame, asked: DataFrame) -> DataFrame:
    """A flow's single result for everyone who asks, also after it came: asked (id, subscriber) with event ``pending`` until results (id, result) has it."""
    return asked.join(results.groupBy("id").agg(F.first("result").alias("result")), "id", "left").select("id", "subscriber", F.when(F.col("result").isNull(), "pending").otherwise("result").alias("event"), "result")


def live_turns(words: DataFrame, spans: DataFrame, late: str = "1 minute", longest: str | None = None) -> DataFrame:
    """An interval join of two streams with watermarks: words (recording_id, w_ts, word) in turns (recording_id, s_ts, e_ts, speaker).

    ``longest`` says how long turns are at most, which lets Spark forget older ones; without it every turn is kept.
    """
    left, right = words.withWatermark("w_ts", late), spans.withWatermark("s_ts", late)
    left, right = left.withColumnRenamed("recording_id", "w_recording"), right
    reach = f" and w_ts <= s_ts + interval {longest}" if longest else ""
    return left.join(right, F.expr(f"w_recording = recording_id and w_ts >= s_ts and w_ts < e_ts{reach}")).drop("w_recording")


def session_windows(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of each user's events. events: ts, user_id."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def push_when_dirty(events: DataFrame, push: Callable[[DataFrame, int], None], dirty: Callable[[DataFrame], bool], interval: str = "60 seconds"):
    """A writer that calls ``push`` for batches that ``dirty`` accepts; start it with ``start()``."""

    def each(batch: DataFrame, epoch: int) -> None:
        if dirty(batch):
            push(batch, epoch)

    return events.writeStream.foreachBatch(each).trigger(processingTime=interval)
