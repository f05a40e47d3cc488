"""Queries over channels and their subscribers: what streams deliver, computed from the whole log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import channels
from . import inputs as i

QUERIES, SQL = {}, {}

#: Events as a log of 40 channels: clicks and views are published, signups subscribe, purchases read, errors leave.
_LOG = """log AS (
  SELECT event_id AS seq, 'c' || CAST(user_id % 40 AS VARCHAR) AS channel,
         CASE event_type WHEN 'signup' THEN 'subscribe' WHEN 'purchase' THEN 'read' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'leave' ELSE 'remote' END ELSE 'publish' END AS kind,
         's' || CAST(event_id % 5 AS VARCHAR) AS subscriber,
         CASE event_id % 30 WHEN 0 THEN 'done' WHEN 1 THEN 'error' WHEN 2 THEN 'linked' WHEN 3 THEN 'conflict' WHEN 4 THEN 'conflict' ELSE 'running' END AS status,
         CASE WHEN event_id % 4 != 0 THEN 'p' || CAST(event_id AS VARCHAR) END AS payload
  FROM events
), durable AS (SELECT 'c' || CAST(r AS VARCHAR) AS channel, CASE WHEN r % 3 = 0 THEN 'linked' WHEN r % 3 = 1 THEN 'queued' ELSE 'conflict' END AS status, 'd' || CAST(r AS VARCHAR) AS payload, 'r' || CAST(r AS VARCHAR) AS remote
  FROM (SELECT DISTINCT user_id % 40 AS r FROM events WHERE user_id % 40 < 30))"""


def _log(s, d):
    e = i.table(s, d, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    what = F.when(kind == "signup", "subscribe").when(kind == "purchase", "read").when(kind == "error", F.when(n % 3 == 0, "leave").otherwise("remote")).otherwise("publish")
    status = F.element_at(F.array(*map(F.lit, ("done", "error", "linked", "conflict", "conflict", "running"))), (F.least(n % 30, F.lit(5)) + 1).cast("int"))
    channel = F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string"))
    log = e.select(n.alias("seq"), channel.alias("channel"), what.alias("kind"), F.concat(F.lit("s"), (n % 5).cast("string")).alias("subscriber"), status.alias("status"), F.when(n % 4 != 0, F.concat(F.lit("p"), n.cast("string"))).alias("payload"))
    r = e.select((F.col("user_id") % 40).alias("r")).where("r < 30").distinct()
    text = lambda c: F.concat(F.lit(c), F.col("r").cast("string"))
    durable = r.select(text("c").alias("channel"), F.when(F.col("r") % 3 == 0, "linked").when(F.col("r") % 3 == 1, "queued").otherwise("conflict").alias("status"), text("d").alias("payload"), text("r").alias("remote"))
    return log, durable


def _sql(contract: channels.Contract) -> str:
    """Every event compared with every connection of its channel."""
    among = lambda c, values: f"({c} IN ({', '.join(repr(v) for v in values)}))" if values else "false"
    final, reprobe = (lambda c: among(c, contract.final)), (lambda c: among(c, contract.reprobe))
    replay = f"result_status IS NOT NULL AND {str(contract.replay).lower()}"
    initial = f"last_status IS NOT NULL AND {str(contract.initial).lower()}"
    return f"""WITH {_LOG},
pub AS (SELECT * FROM log WHERE kind = 'publish'),
probe AS (SELECT channel, seq, payload FROM log WHERE kind = 'remote' UNION ALL SELECT channel, -1, remote FROM durable),
news AS (SELECT channel, seq, status, payload FROM pub UNION ALL SELECT channel, -1, status, payload FROM durable),
at_ AS (
  SELECT l.*, (SELECT arg_max_null(p.payload, p.seq) FROM probe p WHERE p.channel = l.channel AND p.seq < l.seq) AS remote,
         (SELECT max(n.seq) FROM news n WHERE n.channel = l.channel AND n.seq < l.seq) AS last_seq, (SELECT max(n.seq) FROM news n WHERE n.channel = l.channel AND n.seq < l.seq AND {final('n.status')}) AS result_seq
  FROM log l WHERE kind IN ('publish', 'subscribe')
), sub AS (
  SELECT a.channel, a.subscriber, a.seq AS since, a.remote, a.last_seq, a.result_seq, n.status AS last_status, n.payload AS last_payload, r.status AS result_status, r.payload AS result_payload,
         coalesce((SELECT min(x.seq) FROM log x WHERE x.channel = a.channel AND x.subscriber = a.subscriber AND x.kind IN ('subscribe', 'leave') AND x.seq > a.seq), 1000000000000) AS until
  FROM at_ a LEFT JOIN news n ON n.channel = a.channel AND n.seq = a.last_seq LEFT JOIN news r ON r.channel = a.channel AND r.seq = a.result_seq WHERE a.kind = 'subscribe'
), begins AS (
  SELECT channel, subscriber, since, since AS "at", 0 AS place, CASE WHEN {replay} THEN 'replay' ELSE 'initial' END AS kind, CASE WHEN {replay} THEN result_seq ELSE last_seq END AS seq,
         CASE WHEN {replay} THEN result_status ELSE last_status END AS status, CASE WHEN {replay} THEN result_payload ELSE last_payload END AS payload, remote
  FROM sub WHERE ({replay}) OR ({initial})
), stays AS (SELECT s.* FROM sub s LEFT JOIN begins b USING (channel, subscriber, since) WHERE b.kind IS NULL OR (b.kind = 'initial' AND NOT {final('b.status')})
), sent AS (
  SELECT s.channel, s.subscriber, s.since, p.seq, p.status, p.payload, p.remote, (SELECT min(x.seq) FROM log x WHERE x.channel = s.channel AND x.subscriber = s.subscriber AND x.kind = 'read' AND x.seq > p.seq AND x.seq < s.until) AS "at"
  FROM stays s JOIN at_ p ON p.channel = s.channel AND p.kind = 'publish' AND p.seq > s.since AND p.seq < s.until
), placed AS (
  SELECT *, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY channel, subscriber, since, "at") - {contract.size}, 0) AS lost FROM sent WHERE "at" IS NOT NULL WINDOW w AS (PARTITION BY channel, subscriber, since, "at" ORDER BY seq)
), held AS (
  SELECT *, min(CASE WHEN {final('status')} THEN seq END) OVER (PARTITION BY channel, subscriber, since) AS stop FROM placed WHERE place <= {contract.size}
), all_ AS (
  SELECT channel, subscriber, "at", place, kind, nullif(seq, -1) AS seq, status, payload, CASE WHEN {reprobe('status')} THEN remote END AS remote, 0 AS lost FROM begins
  UNION ALL SELECT channel, subscriber, "at", place - 1, 'event', seq, status, payload, CASE WHEN {reprobe('status')} THEN remote END, lost FROM held WHERE stop IS NULL OR seq <= stop
)
SELECT channel, subscriber, CAST("at" AS BIGINT) AS "at", CAST(place AS INTEGER) AS place, kind, CAST(seq AS BIGINT) AS seq, status, payload, remote, CAST(lost AS BIGINT) AS lost FROM all_"""


def _add(name: str, contract: channels.Contract, doc: str) -> None:
    def f(s, d):
        log, durable = _log(s, d)
        return channels.delivered(log, durable, contract)

    f.__name__, f.__doc__ = name, doc
    QUERIES[name], SQL[name] = f, _sql(contract)


_add("w1_channel_reads", channels.Contract(initial=False, size=3), "W1: bounded buffers by subscriber, with reads in between.")
_add("w2_session_streams", channels.Contract(final=channels.SESSIONS.final, size=3), "W2, W3: a first state, events, and the end.")
_add("w5_backup_streams", channels.BACKUP, "W5: streams without an end, with the remote probed again on conflict.")
_add("w6_linking_streams", channels.LINKING, "W6: one result for everyone, also for those who come after it.")
