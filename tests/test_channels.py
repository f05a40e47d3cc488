"""Channels as streams in several batches against whole logs, and both against a plain broker."""

import random

import pytest
from pyspark.sql import functions as F

from turnweave.streaming import channels
from turnweave.streaming.channels import Contract


def make_log(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        kind = rng.choices(("publish", "remote", "subscribe", "read", "leave"), (60, 5, 10, 20, 5))[0]
        own = None if kind in ("publish", "remote") else f"s{rng.randrange(4)}"
        status = rng.choices(("running", "done", "linked", "conflict"), (80, 5, 5, 10))[0] if kind == "publish" else None
        rows.append((seq, f"c{rng.randrange(3)}", kind, own, status, rng.choice((None, f"p{seq}"))))
    return rows


def broker(log, durable, contract):
    """Queues in memory."""
    news, result, remote, queues, out = {}, {}, {}, {}, []
    for c, status, payload, probe in durable:
        news[c], remote[c] = (None, status, payload), probe
        if status in contract.final:
            result[c] = news[c]
    shown = lambda c, status: remote.get(c) if status in contract.reprobe else None
    for seq, c, kind, sub, status, payload in log:
        if kind == "publish":
            news[c] = (seq, status, payload)
            if status in contract.final:
                result[c] = news[c]
            for (own, _), q in queues.items():
                if own == c:
                    q["lost"] += len(q["items"]) >= contract.size
                    q["items"] += [(seq, status, payload, shown(c, status))] * (len(q["items"]) < contract.size)
        elif kind == "remote":
            remote[c] = payload
        elif kind == "subscribe":
            queues[c, sub] = {"items": [], "lost": 0}
            first = None
            if contract.replay and c in result:
                first, kind = result[c], "replay"
            elif contract.initial and c in news:
                first, kind = news[c], "initial"
            if first:
                out.append((c, sub, seq, 0, kind, *first, shown(c, first[1]), 0))
                if kind == "replay" or first[1] in contract.final:
                    del queues[c, sub]
        elif kind == "read" and (c, sub) in queues:
            q = queues[c, sub]
            queues[c, sub] = {"items": [], "lost": 0}
            for place, item in enumerate(q["items"]):
                out.append((c, sub, seq, place, "event", *item, q["lost"]))
                if item[1] in contract.final:
                    del queues[c, sub]
                    break
        elif kind == "leave":
            queues.pop((c, sub), None)
    return sorted(out, key=str)


CONTRACTS = {
    "plain": Contract(initial=False, size=3), "sessions": channels.SESSIONS, "small": Contract(final=("done",), size=2), "backup": channels.BACKUP, "linking": channels.LINKING,
    "all": Contract(initial=True, final=("linked",), replay=True, reprobe=("conflict", "linked"), size=4),
}
LOG = "seq long, channel string, kind string, subscriber string, status string, payload string"
DURABLE = [("c0", "running", "d0", "r0"), ("c1", "linked", None, None), ("c9", "done", "d9", None)]


def frames(spark, log):
    return spark.createDataFrame(log, LOG), spark.createDataFrame(DURABLE, "channel string, status string, payload string, remote string")


@pytest.mark.parametrize(("name", "bin"), [("plain", 4096), ("sessions", 16), ("small", 16), ("backup", 4096), ("linking", 4096), ("all", 16)])
def test_whole_logs_equal_a_broker(spark, name, bin):
    log = make_log(len(name))
    df, durable = frames(spark, log)
    found = channels.delivered(df, durable, CONTRACTS[name], bin)
    assert found.columns == [c.split(" ")[0] for c in channels.RESULT.split(", ")]
    rows = sorted((tuple(r) for r in found.collect()), key=str)
    assert rows == broker(log, DURABLE, CONTRACTS[name]) and len(rows) > 5
    if bin == 16:
        none = sorted((tuple(r) for r in channels.delivered(df, None, CONTRACTS[name], bin).collect()), key=str)
        assert none == broker(log, [], CONTRACTS[name])
        assert channels.delivered(df.limit(0), durable, CONTRACTS[name]).count() == 0


def run(spark, tmp_path, log, durable, contract, name, shares=2, batches=5):
    """The log as one file a batch, in order."""
    df, first = frames(spark, log)
    for k in range(batches):
        low, high = k * len(log) // batches, (k + 1) * len(log) // batches
        df.where(F.col("seq").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log" / f"part={k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "log" / "part=*"))
    results = channels.streamed(stream, first if durable else None, contract, shares)
    return results.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check"))


@pytest.mark.parametrize("name", ["sessions", "all"])
def test_streams_in_batches_equal_whole_logs(spark, tmp_path, name):
    channels.use_state_store(spark)
    log = make_log(3, 300)
    query = run(spark, tmp_path, log, True, CONTRACTS[name], f"channels_{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) >= 5
    rows = sorted((tuple(r) for r in spark.table(f"channels_{name}").collect()), key=str)
    assert rows == broker(log, DURABLE, CONTRACTS[name])


def test_quiet_subscribers_are_kept_alive(spark, tmp_path):
    channels.use_state_store(spark)
    log = [(0, "c", "subscribe", "s", None, None), (1, "d", "subscribe", "t", None, None), (2, "d", "leave", "t", None, None)]
    query = run(spark, tmp_path, log, False, Contract(keepalive_ms=500), "alive", batches=1).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(0.5)
            kept = spark.table("alive").where("kind = 'keepalive'").select("channel", "subscriber").collect()
            if len(kept) >= 2:
                break
    finally:
        query.stop()
    assert len(kept) >= 2 and {tuple(r) for r in kept} == {("c", "s")}
