"""Channels with subscribers: bounded buffers, first states, replay, ends, and re-probes, as a stream and as a batch.

A log says what happens to channels in order of ``seq``: rows (seq, channel, kind, subscriber, status, payload) of kinds

- ``publish``: an event for everyone who is subscribed just then;
- ``remote``: what a probe of the other side shows from now on (``payload``; null: nothing there);
- ``subscribe``, ``read``, ``leave``: one subscriber's doing. Who subscribes again begins anew.

A subscriber's buffer holds ``SIZE`` events; what comes while it is full is lost, and counted. A read takes all that
is held. Nobody waits for anybody.

``Contract`` says what a channel's streams promise: whether a subscriber first hears the channel's last
event (the durable row before any), at which statuses a stream ends, whether a result that
came before is replayed and ends the stream at once, and with which statuses a remote's state is shown.

Results are rows (channel, subscriber, at, place, kind, seq, status, payload, remote, lost): what a subscriber
gets by the subscribe or read at ``at``, in order of ``place``; kind is ``initial``, ``replay``, ``event`` or, in streams that
keep alive, ``keepalive``; ``lost`` counts what the buffer had no room for since the read before.

``streamed`` keeps all this in state by (channel, share of its subscribers), which comes back after a
restart from the checkpoint; ``delivered`` computes the same from a whole log by scans and joins. An event
without a status is never heard first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.intervals import binned_overlaps
from ..operators.scans import Run, scan

SIZE = 64
#: Parts into which a channel's subscribers are dealt out in a stream; each gets all of the channel's events.
SHARES = 4
#: Sequence numbers of a bin, in batches.
BIN = 4096
COLUMNS = ("seq", "channel", "kind", "subscriber", "status", "payload")
RESULT = "channel string, subscriber string, at long, place int, kind string, seq long, status string, payload string, remote string, lost long"


@dataclass(frozen=True)
class Contract:
    """What a channel's streams promise; see the module."""

    initial: bool = True
    final: tuple[str, ...] = ()
    replay: bool = False
    reprobe: tuple[str, ...] = ()
    size: int = SIZE
    keepalive_ms: int | None = None


SESSIONS = Contract(final=("done", "error"))
BACKUP = Contract(reprobe=("conflict",))
LINKING = Contract(initial=False, final=("linked", "error"), replay=True)


def use_state_store(spark: SparkSession) -> None:
    """State with maps and timers needs the RocksDB store; it is chosen before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class _Buffer:
    heard: int
    lost: int
    events: list[tuple]


class _Streams(StatefulProcessor):
    """One share of a channel: its last event, result and remote, and its subscribers' buffers."""

    def __init__(self, contract: Contract):
        self.contract = contract

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "seq long, status string, payload string, result_seq long, result_status string, result string, remote string")
        self.open = handle.getMapState("open", "subscriber string", "heard long, lost long, seq array<long>, status array<string>, payload array<string>, remote array<string>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            ends = r.status in self.contract.final
            self.known.update((None, r.status, r.payload, None, r.status if ends else None, r.payload if ends else None, r.remote))

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = list(self.known.get()) if self.known.exists() else [None] * 7
        held = {k[0]: _Buffer(v[0], v[1], list(zip(*v[2:], strict=True))) for k, v in self.open.iterator()}
        before, now, out = set(held), timerValues.getCurrentProcessingTimeInMs(), []
        log = pd.concat(list(rows)).sort_values("seq").astype(object)
        for r in log.where(log.notna(), None).itertuples():
            if r.kind == "publish":
                known[:3] = r.seq, r.status, r.payload
                if r.status in self.contract.final:
                    known[3:6] = r.seq, r.status, r.payload
                event = (r.seq, r.status, r.payload, known[6] if r.status in self.contract.reprobe else None)
                for buffer in held.values():
                    if len(buffer.events) < self.contract.size:
                        buffer.events.append(event)
                    else:
                        buffer.lost += 1
            elif r.kind == "remote":
                known[6] = r.payload
            elif r.kind == "subscribe":
                held.pop(r.subscriber, None)
                first = None
                if self.contract.replay and known[4] is not None:
                    first = ("replay", *known[3:6])
                elif self.contract.initial and known[1] is not None:
                    first = ("initial", *known[:3])
                if first:
                    out.append((r.subscriber, r.seq, 0, *first, known[6] if first[2] in self.contract.reprobe else None, 0))
                if first is None or first[0] == "initial" and first[2] not in self.contract.final:
                    held[r.subscriber] = _Buffer(now, 0, [])
            elif r.kind == "read" and r.subscriber in held:
                buffer = held[r.subscriber]
                for place, event in enumerate(buffer.events):
                    out.append((r.subscriber, r.seq, place, "event", *event, buffer.lost))
                    if event[1] in self.contract.final:
                        del held[r.subscriber]
                        break
                else:
                    held[r.subscriber] = _Buffer(now if buffer.events else buffer.heard, 0, [])
            elif r.kind == "leave":
                held.pop(r.subscriber, None)
        self.known.update(tuple(known))
        self._keep(before, held)
        if self.contract.keepalive_ms and held and not before:
            self.handle.registerTimer(now + self.contract.keepalive_ms)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Every quiet subscriber hears that the stream is alive."""
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        held = {k[0]: _Buffer(v[0], v[1], list(zip(*v[2:], strict=True))) for k, v in self.open.iterator()}
        for subscriber, buffer in held.items():
            if not buffer.events and now - buffer.heard >= self.contract.keepalive_ms:
                out.append((subscriber, None, None, "keepalive", None, None, None, None, 0))
                buffer.heard = now
        self._keep(set(held), held)
        if held:
            self.handle.registerTimer(now + self.contract.keepalive_ms)
        yield self._rows(key, out)

    def _keep(self, before: set[str], held: dict[str, _Buffer]) -> None:
        for subscriber in before - held.keys():
            self.open.removeKey((subscriber,))
        for subscriber, b in held.items():
            columns = list(zip(*b.events, strict=True)) or [()] * 4
            self.open.updateValue((subscriber,), (b.heard, b.lost, *map(list, columns)))

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in RESULT.split(", ")]
        return pd.DataFrame([(key[0], *r) for r in out], columns=names).astype({"at": "Int64", "place": "Int32", "seq": "Int64", "lost": "Int64"})

    def close(self) -> None:
        pass


def _log(log: DataFrame) -> DataFrame:
    return log.select(F.col("seq").cast("long").alias("seq"), F.col("channel").cast("string").alias("channel"), "kind", F.col("subscriber").cast("string").alias("subscriber"), "status", "payload")


def streamed(log: DataFrame, durable: DataFrame | None = None, contract: Contract = SESSIONS, shares: int = SHARES) -> DataFrame:
    """Results of a streaming log, whose rows come in order of ``seq`` from batch to batch.

    durable: rows (channel, status, payload, remote) of what was known before the stream's first batch. Start
    it in output mode append, with the state store of ``use_state_store``.
    """
    everyone = F.sequence(F.lit(0), F.lit(shares - 1))
    mine = F.when(F.col("kind").isin("publish", "remote"), everyone).otherwise(F.array(F.pmod(F.xxhash64("subscriber"), F.lit(shares)).cast("int")))
    dealt = _log(log).withColumn("share", F.explode(mine))
    first = None
    if durable is not None:
        known = durable.select(F.col("channel").cast("string").alias("channel"), "status", "payload", F.col("remote").cast("string").alias("remote"))
        first = known.withColumn("share", F.explode(everyone)).groupBy("channel", "share")
    mode = "ProcessingTime" if contract.keepalive_ms else "None"
    return dealt.groupBy("channel", "share").transformWithStateInPandas(_Streams(contract), RESULT, "append", mode, first)


def delivered(log: DataFrame, durable: DataFrame | None = None, contract: Contract = SESSIONS, bin: int = BIN) -> DataFrame:
    """Results of a whole log: connections joined with the events published while they last, in bins of ``seq``."""
    log = _log(log)
    shown = F.col("status").isin(*contract.reprobe) if contract.reprobe else F.lit(False)
    ends = lambda c: c.isin(*contract.final) if contract.final else F.lit(False)
    publish, result = F.col("kind") == "publish", F.struct("seq", "status", "payload")
    of_channel = log.where(F.col("kind").isin("publish", "remote", "subscribe"))
    of_channel = scan(
        of_channel, ["channel"], ["seq"], bin, last=Run("last", F.when(publish, result), own=False), result=Run("last", F.when(publish & ends(F.col("status")), result), own=False),
        probe=Run("last", F.when(F.col("kind") == "remote", F.struct(F.col("payload").alias("remote"))), own=False),
    )
    if durable is None:
        known = log.select("channel", F.lit(None).cast("string").alias("d_status"), F.lit(None).cast("string").alias("d_payload"), F.lit(None).cast("string").alias("d_remote")).limit(0)
    else:
        known = durable.select(F.col("channel").cast("string").alias("channel"), F.col("status").alias("d_status"), F.col("payload").alias("d_payload"), F.col("remote").cast("string").alias("d_remote"))
    none = F.struct(F.lit(None).cast("long").alias("seq"), F.col("d_status").alias("status"), F.col("d_payload").alias("payload"))
    of_channel = of_channel.join(known, "channel", "left").withColumn("remote", F.when(F.col("probe").isNotNull(), F.col("probe.remote")).otherwise(F.col("d_remote")))
    of_channel = of_channel.withColumn("last", F.coalesce("last", F.when(F.col("d_status").isNotNull(), none))).withColumn("result", F.coalesce("result", F.when(ends(F.col("d_status")), none)))

    # Connections: from a subscribe to the subscriber's next subscribe or leave, unless what is heard first ends them.
    first = F.lit(None).cast("struct<kind:string,seq:bigint,status:string,payload:string>")
    if contract.initial:
        first = F.when(F.col("last.status").isNotNull(), F.struct(F.lit("initial").alias("kind"), "last.seq", "last.status", "last.payload"))
    if contract.replay:
        first = F.when(F.col("result").isNotNull(), F.struct(F.lit("replay").alias("kind"), "result.seq", "result.status", "result.payload")).otherwise(first)
    joined = of_channel.where("kind = 'subscribe'").select("channel", "subscriber", F.col("seq").alias("since"), first.alias("first"), "remote")
    own = log.where(F.col("kind").isin("subscribe", "read", "leave"))
    turns = scan(own, ["channel", "subscriber"], ["seq"], bin, until=Run("next", F.when(F.col("kind") != "read", F.col("seq")), own=False))
    latest = log.groupBy("channel").agg((F.max("seq") + 1).alias("over"))
    until = turns.where("kind = 'subscribe'").join(latest, "channel").select("channel", "subscriber", F.col("seq").alias("since"), F.coalesce("until", "over").alias("until"))
    begins = joined.where("first is not null").select(
        "channel", "subscriber", F.col("since").alias("at"), F.lit(0).alias("place"), "first.kind", "first.seq", "first.status", "first.payload",
        F.when(F.col("first.status").isin(*contract.reprobe) if contract.reprobe else F.lit(False), F.col("remote")).alias("remote"), F.lit(0).cast("long").alias("lost"),
    )
    stays = joined.where(F.col("first").isNull() | ((F.col("first.kind") == "initial") & ~ends(F.col("first.status")))).select("channel", "subscriber", "since").join(until, ["channel", "subscriber", "since"])

    # Each event of a connection with the read that takes it.
    events = of_channel.where("kind = 'publish'").select(F.col("channel").alias("recording_id"), F.col("seq").alias("p_start"), (F.col("seq") + 1).alias("p_end"), "status", "payload", F.when(shown, F.col("remote")).alias("remote"))
    lasting = stays.select(F.col("channel").alias("recording_id"), "subscriber", "since", (F.col("since") + 1).alias("s_start"), F.col("until").alias("s_end"))
    sent = binned_overlaps(events, lasting, bin).select(F.col("recording_id").alias("channel"), "subscriber", "since", F.col("p_start").alias("seq"), "status", "payload", "remote", F.col("s_end").alias("until"))
    reads = own.where("kind = 'read'").select("channel", "subscriber", "seq", F.col("seq").alias("read"))
    sent = scan(sent.unionByName(reads, allowMissingColumns=True), ["channel", "subscriber"], ["seq"], bin, at=Run("next", F.col("read"))).where("read is null and at < until").drop("read", "until")
    connection = ["channel", "subscriber", "since"]
    counts = sent.groupBy(*connection, "at").agg(F.greatest(F.count("*") - contract.size, F.lit(0)).cast("long").alias("lost"))
    held = sent.withColumn("place", F.row_number().over(W.partitionBy(*connection, "at").orderBy("seq"))).where(F.col("place") <= contract.size)
    if contract.final:
        over = held.where(ends(F.col("status"))).groupBy(*connection).agg(F.min("seq").alias("over"))
        held = held.join(over, connection, "left").where("over is null or seq <= over")
    taken = held.join(counts, [*connection, "at"]).select("channel", "subscriber", "at", (F.col("place") - 1).alias("place"), F.lit("event").alias("kind"), "seq", "status", "payload", "remote", "lost")
    return begins.unionByName(taken)


def buffered(events: DataFrame, key: str, seq: str, size: int = SIZE) -> DataFrame:
    """What a subscriber of each channel, there from the start, reads once at the end: the first ``size`` events (key, seq).

    With one subscriber and one read ``delivered`` comes to this; a task hands on no more than ``size`` events of a channel.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col(seq).asc_nulls_last()))
    return events.select(key, seq).withColumn("_place", place).where(F.col("_place") <= size).drop("_place")
