"""Queries over sessions, settings, files, labels and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aligners, texts, times
from ..operators import ctc, edits, manifest, metrics, sessions
from ..streaming import channels, status
from . import inputs as i

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_LENGTH = "CASE WHEN {0} >= 3600000 THEN CAST({0} // 3600000 AS VARCHAR) || 'h ' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || 'm' ELSE CAST({0} // 60000 AS VARCHAR) || 'm ' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || 's' END"
_DATE = "coalesce(strftime(TRY_CAST(created_at AS TIMESTAMP), '%b %d, %Y · %H:%M'), created_at)"


@query("p1_cards", f"""WITH {i.SESSIONS} SELECT id, coalesce(filename, '') AS title, status, CASE status WHEN 'queued' THEN 'Queued' WHEN 'running' THEN 'Processing' WHEN 'done' THEN 'Transcribed' WHEN 'error' THEN 'Failed' ELSE 'Unprocessed' END AS label,
CASE status WHEN 'queued' THEN 'wait' WHEN 'running' THEN 'run' WHEN 'done' THEN 'ok' WHEN 'error' THEN 'err' ELSE '' END AS chip, status = 'done' AS viewable, CASE WHEN status IN ('queued', 'running') THEN 'pending' WHEN status = 'error' THEN 'failed' ELSE 'done' END AS bucket,
CASE WHEN duration_ms IS NULL THEN '' ELSE {_LENGTH.format('duration_ms')} END AS length, coalesce(num_segments, 0) AS num_segments, {_DATE} AS date FROM sessions""")
def p1_cards(s, d):
    """P1, P14, T4, T6."""
    return sessions.cards(i.sessions(s, d))


@query("a7_summary", f"WITH {i.SESSIONS} SELECT count(*) AS total, count(*) FILTER (status = 'done') AS done, CAST(round_even(count(*) FILTER (status = 'done') * 100 / count(*), 0) AS BIGINT) AS done_pct, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_ms, CAST(sum(coalesce(duration_ms, 0)) FILTER (status = 'done') AS BIGINT) AS done_ms FROM sessions")
def a7_summary(s, d):
    return sessions.summary(i.sessions(s, d))


@query("s6_listed", f"WITH {i.SESSIONS} SELECT id, created_at FROM sessions")
def s6_listed(s, d):
    """All sessions, newest first."""
    return sessions.listed(i.sessions(s, d)).select("id", "created_at")


@query("o4_featured", f"WITH {i.SESSIONS} SELECT id, created_at FROM sessions ORDER BY created_at DESC, id DESC LIMIT 1")
def o4_featured(s, d):
    """The newest session."""
    return sessions.featured(i.sessions(s, d)).select("id", "created_at")


@query("o3_any_active", f"WITH {i.SESSIONS} SELECT count(*) > 0 AS busy FROM sessions WHERE status IN ('queued', 'running')")
def o3_any_active(s, d):
    """O3: whether any session is active."""
    return sessions.any_active(i.sessions(s, d))


@query("w3_initial_events", f"WITH {i.SESSIONS} SELECT id, CASE WHEN status IN ('done', 'error') THEN status WHEN stage IS NOT NULL THEN 'stage' ELSE status END AS event, CASE WHEN status NOT IN ('done', 'error') THEN stage END AS stage, CASE WHEN status NOT IN ('done', 'error') AND stage IS NOT NULL THEN CAST(floor(coalesce(duration_ms, 0) * 0.19 + 0.5) AS BIGINT) END AS eta_ms FROM sessions")
def w3_initial_events(s, d):
    """What a subscriber hears first of each session."""
    return status.initial_events(i.sessions(s, d), F.floor(F.coalesce("duration_ms", F.lit(0)) * 0.19 + 0.5))


@query("w7_language_maps", "SELECT user_id AS id, string_agg(lang || '=' || st, ',' ORDER BY lang) AS statuses FROM (SELECT user_id, event_type AS lang, arg_max(CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'running' END, event_id) AS st FROM events GROUP BY ALL) GROUP BY user_id")
def w7_language_maps(s, d):
    """The map of languages and statuses that a subscriber gets first; deltas follow."""
    e = i.table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("lang"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "done").otherwise("running").alias("status"))
    return status.language_maps(e).select("id", F.array_join(F.transform("statuses", lambda x: F.concat_ws("=", x["lang"], x["status"])), ",").alias("statuses"))


@query("w15_model_events", "SELECT model, seq, state FROM (SELECT event_type AS model, event_id AS seq, CASE WHEN floor(value) % 3 = 0 THEN 'loading' ELSE 'ready' END AS state, lag(CASE WHEN floor(value) % 3 = 0 THEN 'loading' ELSE 'ready' END) OVER (PARTITION BY event_type ORDER BY event_id) AS was FROM events) WHERE state IS DISTINCT FROM was")
def w15_model_events(s, d):
    """Transitions of models' states, as they are broadcast."""
    e = i.table(s, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("seq"), F.when(F.floor("value") % 3 == 0, "loading").otherwise("ready").alias("state"))
    return status.transitions(e, "model", "seq", "state").select("model", "seq", "state")


@query("u4_suppressed", "WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[A-Za-z0-9%]+')) AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_matches(x, '[0-9%$£]')) || ['the', 'a'])), ',') AS suppressed FROM t")
def u4_suppressed(s, d):
    """U4: tokens with numerals, and those configured, once each."""
    tokens = F.regexp_extract_all("text", F.lit("[A-Za-z0-9%]+"), F.lit(0))
    rows = i.table(s, d, "conversations").select("conv_id", "turn", texts.suppressed(tokens, ["the", "a"]).alias("t"))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort("t"), ",").alias("suppressed"))


@query("o9_language_prefix", f"WITH {i.SEGMENTS} SELECT recording_id, string_agg(text, '' ORDER BY seg_idx) AS text FROM seg WHERE start_ms < 30000 AND start_ms >= 0 GROUP BY recording_id")
def o9_language_prefix(s, d):
    """What starts in the first thirty seconds, by which a recording's language is told."""
    return sessions.prefix(i.segments(s, d), 30_000)


@query("m18_enrolled", "SELECT user_id AS recording_id, 'SPEAKER_' || lpad(CAST(count(DISTINCT event_type) AS VARCHAR), 2, '0') AS speaker, 'New' AS name FROM events GROUP BY user_id")
def m18_enrolled(s, d):
    """A new speaker of each recording whose speakers are numbered."""
    from ..operators.edits import enrol
    from pyspark.sql import Window as W

    kinds = i.table(s, d, "events").select(F.col("user_id").alias("recording_id"), "event_type").distinct()
    place = F.row_number().over(W.partitionBy("recording_id").orderBy("event_type")) - 1
    keys = kinds.select("recording_id", F.concat(F.lit("SPEAKER_"), F.lpad(place.cast("string"), 2, "0")).alias("speaker"))
    names = keys.where("speaker = 'SPEAKER_00'").withColumn("name", F.lit("Old"))
    return enrol(keys, names, keys.select("recording_id").distinct().withColumn("name", F.lit("New")))


@query("p10_active", f"WITH {i.SESSIONS} SELECT id, status FROM sessions WHERE status IN ('queued', 'running')")
def p10_active(s, d):
    return sessions.active(i.sessions(s, d)).select("id", "status")


@query("s7_setting", "SELECT coalesce(max(c_mktsegment) FILTER (c_custkey = 3), 'none') AS value FROM customer")
def s7_setting(s, d):
    return sessions.setting(i.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value")), "3", "none")


@query("s8_names", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(DISTINCT event_type) AS n, string_agg(event_type || '=' || x, ',' ORDER BY event_type) AS names FROM (SELECT user_id, event_type, arg_max(props, event_id) AS x FROM events GROUP BY ALL) GROUP BY user_id")
def s8_names(s, d):
    e = i.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("speaker_key"), F.col("props").alias("name"), F.col("event_id").alias("seq"))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("names")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return sessions.names(e).select("session_id", F.size("names").cast("long").alias("n"), entries.alias("names"))


@query("s5_decoded_options", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def s5_decoded_options(s, d):
    """JSON columns read leniently."""
    return i.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("p15_etas", f"WITH {i.SESSIONS} SELECT id, stage, CASE WHEN stage = 'aligning' THEN CAST(round_even(0.19::DOUBLE * nullif(duration_ms, 0) / 1000, 0) AS BIGINT) END AS eta FROM sessions WHERE status = 'running'")
def p15_etas(s, d):
    return i.sessions(s, d).where("status = 'running'").select("id", "stage", times.eta(F.col("stage"), F.col("duration_ms"), times.STAGE_FACTORS).alias("eta"))


@query("w11_requeued", f"WITH {i.SESSIONS} SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'queued' ELSE status END AS status, CASE WHEN status NOT IN ('queued', 'running') THEN stage END AS stage, CASE WHEN status NOT IN ('queued', 'running') THEN error END AS error, status IN ('queued', 'running') AS requeued FROM sessions")
def w11_requeued(s, d):
    return sessions.requeued(i.sessions(s, d)).select("id", "status", "stage", "error", "requeued")


@query("m4_removed", f"WITH {i.SESSIONS} SELECT id FROM sessions WHERE status != 'error'")
def m4_removed(s, d):
    x = i.sessions(s, d)
    return sessions.removed(x, x.select(F.col("id").alias("session_id")), x.where("status = 'error'").select("id"))[0].select("id")


_EVENTS = "e AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN 'done' ELSE 'running' END ELSE CASE WHEN event_id % 9 = 1 THEN 'error' ELSE 'running' END END AS status FROM events)"


def _status(s, d):
    kind, n = F.col("event_type"), F.col("event_id") % 9
    status = F.when(kind == "view", "queued").when((kind == "purchase") & (n == 0), "done").when((kind == "error") & (n == 1), "error").otherwise("running")
    return i.table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"))


@query("w9_states", f"WITH {_EVENTS} SELECT id, coalesce(arg_min(status, seq) FILTER (status IN ('done', 'error')), arg_max(status, seq)) AS status, count(*) AS n_events FROM e GROUP BY id")
def w9_states(s, d):
    """A session's state after its events; the final one stays."""
    return sessions.state(_status(s, d))


@query("w2_until_final", f"WITH {_EVENTS}, f AS (SELECT id, min(seq) AS last FROM e WHERE status IN ('done', 'error') GROUP BY id) SELECT e.id, seq, status FROM e LEFT JOIN f ON f.id = e.id WHERE f.last IS NULL OR seq <= f.last")
def w2_until_final(s, d):
    return sessions.until_final(_status(s, d))


@query("w1_bounded_channel", f"WITH {_EVENTS} SELECT id, seq FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) <= 64")
def w1_bounded_channel(s, d):
    """Of what a channel gets before it is read, the first 64."""
    return channels.buffered(_status(s, d), "id", "seq")


@query("w8_latest_translation", "SELECT user_id AS id, event_type AS lang, arg_max(CASE WHEN event_id % 6 = 0 THEN 'error' ELSE 'done' END, event_id) AS status, arg_max(CASE WHEN event_id % 4 != 0 THEN 'svc' || CAST(event_id % 3 AS VARCHAR) END, event_id) AS service, arg_max_null(CASE WHEN event_id % 6 = 0 THEN 'e' || CAST(event_id AS VARCHAR) END, event_id) AS error FROM events GROUP BY ALL")
def w8_latest_translation(s, d):
    """W8, M7."""
    k = F.col("event_id")
    e = i.table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("lang"), k.alias("seq"), F.when(k % 6 == 0, "error").otherwise("done").alias("status"), F.when(k % 4 != 0, F.concat(F.lit("svc"), (k % 3).cast("string"))).alias("service"), F.concat(F.lit("e"), k.cast("string")).alias("error"))
    return sessions.translation_status(e)


@query("m5_upserted_names", "SELECT user_id AS id, event_type AS k, arg_max(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE props END, event_id) AS value FROM events GROUP BY ALL HAVING trim(value) != ''")
def m5_upserted_names(s, d):
    """M2, M5, M6: the last value holds; a blank removes."""
    e = i.table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("k"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("props")).alias("value"), F.col("event_id").alias("seq"))
    return edits.latest(e, ["id", "k"], "seq", "value", texts.blank(F.col("value")))


@query("f26_rising", "SELECT user_id AS id, event_id AS seq, CAST(floor(value) AS BIGINT) AS pct FROM events QUALIFY pct > coalesce(max(pct) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)")
def f26_rising(s, d):
    return sessions.rising(i.table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.floor("value").alias("pct")))


@query("w10_stage_order", "WITH e AS (SELECT l_orderkey AS id, n AS seq, CASE WHEN l_orderkey % 5 = 0 AND n = 2 THEN 1 WHEN n > 5 THEN 0 ELSE n END AS n FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)), p AS (SELECT *, n = coalesce(lag(n) OVER (PARTITION BY id ORDER BY seq), 0) + 1 AS ok FROM e) SELECT id, bool_and(ok) AS in_order, count(*) AS n FROM p GROUP BY id")
def w10_stage_order(s, d):
    """All lines of an order as its stages; those after the fifth are unknown ones."""
    from pyspark.sql import Window as W

    l = i.table(s, d, "lineitem").withColumn("n", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")))  # noqa: E741
    at = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("n") == 2), 1).otherwise(F.col("n"))
    stage = F.coalesce(F.get(F.array(*map(F.lit, sessions.STAGES[:5])), at - 1), F.lit("unknown"))
    return sessions.stage_order(l.select(F.col("l_orderkey").alias("id"), F.col("n").alias("seq"), stage.alias("stage")))


@query("w12_queue_times", "WITH RECURSIVE j AS (SELECT user_id % 40 AS worker, event_id AS job, event_id AS arrives, CAST(floor(value) AS BIGINT) AS takes, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS k FROM events), f AS (SELECT worker, job, k, arrives AS begins, arrives + takes AS ends FROM j WHERE k = 1 UNION ALL SELECT j.worker, j.job, j.k, greatest(j.arrives, f.ends), greatest(j.arrives, f.ends) + j.takes FROM f JOIN j ON j.worker = f.worker AND j.k = f.k + 1) SELECT worker, job, begins, ends FROM f")
def w12_queue_times(s, d):
    e = i.table(s, d, "events").select((F.col("user_id") % 40).alias("worker"), F.col("event_id").alias("job"), F.col("event_id").alias("arrives"), F.floor("value").alias("takes"))
    return sessions.queue_times(e).select("worker", "job", "begins", "ends")


@query("w13_backup_states", "SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'disabled' WHEN event_id % 7 = 0 THEN 'unlinked' WHEN event_type = 'click' THEN 'pushing' WHEN event_id % 5 = 0 THEN 'conflict' WHEN event_id % 2 = 0 THEN 'dirty' ELSE 'idle' END AS state FROM events")
def w13_backup_states(s, d):
    k = F.col("event_id")
    facts = i.table(s, d, "events").select(k.alias("id"), (k % 11 != 0).alias("enabled"), (k % 7 != 0).alias("linked"), F.when(F.col("event_type") == "click", "pushing").alias("activity"), (k % 5 == 0).alias("conflict"), (k % 2 == 0).alias("dirty"))
    return sessions.backup_state(facts).select("id", "state")


@query("s17_newest_model", "SELECT p_brand AS name, arg_max(p_name, (p_size, p_partkey)) AS path FROM part GROUP BY p_brand")
def s17_newest_model(s, d):
    """S17, O6, A21."""
    p = i.table(s, d, "part")
    return sessions.newest_model(p.select(F.col("p_brand").alias("name"), F.col("p_name").alias("path"), F.col("p_size").alias("vendored_at"), F.col("p_partkey").alias("priority")))


@query("u5_stream_sets", f"WITH {i.SESSIONS} SELECT 'close' AS action, id FROM sessions WHERE num_segments < 30 AND status NOT IN ('queued', 'running') UNION ALL SELECT 'open', id FROM sessions WHERE status IN ('queued', 'running') AND (num_segments >= 30 OR num_segments IS NULL)")
def u5_stream_sets(s, d):
    """Streams to open and to close."""
    x = i.sessions(s, d)
    live, open_ = sessions.active(x).select("id"), x.where("num_segments < 30").select("id")
    return open_.exceptAll(live).select(F.lit("close").alias("action"), "id").unionByName(live.exceptAll(open_).select(F.lit("open").alias("action"), "id"))


@query("u2_taken_names", "SELECT DISTINCT lower(x) AS name FROM (SELECT c_name AS x FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT upper(c_mktsegment) FROM customer)")
def u2_taken_names(s, d):
    """All names taken, whatever their case."""
    c, p = i.table(s, d, "customer"), i.table(s, d, "supplier")
    return c.select(F.col("c_name").alias("x")).union(p.select("s_name")).union(c.select(F.upper("c_mktsegment"))).select(F.lower("x").alias("name")).distinct()


@query("j7_changed", f"WITH {i.FILES} SELECT path FROM files WHERE hash NOT IN (SELECT hash FROM files WHERE doc_id % 3 = 0)")
def j7_changed(s, d):
    f = i.files(s, d)
    return manifest.changed(f, f.where("doc_id % 3 = 0")).select("path")


@query("j8_stray", f"WITH {i.FILES} SELECT path FROM files WHERE path NOT IN (SELECT path FROM files WHERE doc_id % 3 = 0)")
def j8_stray(s, d):
    f = i.files(s, d)
    return manifest.stray(f, f.where("doc_id % 3 = 0")).select("path")


@query("j9_present", f"WITH {i.FILES} SELECT path FROM files WHERE hash IN (SELECT hash FROM files WHERE doc_id % 3 = 0)")
def j9_present(s, d):
    f = i.files(s, d)
    return manifest.present(f, f.where("doc_id % 3 = 0").select("hash").distinct()).select("path")


@query("u1_orphans", f"WITH {i.FILES} SELECT DISTINCT hash FROM files EXCEPT SELECT hash FROM files WHERE doc_id % 2 = 0")
def u1_orphans(s, d):
    """U1, A14."""
    f = i.files(s, d)
    return manifest.orphans(manifest.object_keys(f), f.where("doc_id % 2 = 0"))


@query("m16_push_plan", f"WITH {i.FILES}, o AS (SELECT DISTINCT hash FROM files WHERE doc_id % 3 != 0), l AS (SELECT DISTINCT hash FROM files WHERE doc_id % 5 != 0) SELECT hash, 'upload' AS action FROM l WHERE hash NOT IN (SELECT hash FROM o) UNION ALL SELECT hash, 'skip' FROM l WHERE hash IN (SELECT hash FROM o) UNION ALL SELECT hash, 'collect' FROM o WHERE hash NOT IN (SELECT hash FROM l)")
def m16_push_plan(s, d):
    f = i.files(s, d)
    return manifest.push_plan(f.where("doc_id % 5 != 0"), f.where("doc_id % 3 != 0").select("hash").distinct(), f.where("doc_id % 7 = 0"))


@query("a13_totals", f"WITH {i.FILES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files")
def a13_totals(s, d):
    return manifest.totals(i.files(s, d))


@query("a15_roots", f"""WITH {i.FILES} SELECT "group", sha256(string_agg(path || chr(0) || hash || chr(0), '' ORDER BY path)) AS root, count(*) AS files FROM files GROUP BY "group" """)
def a15_roots(s, d):
    return manifest.root(i.files(s, d))


@query("a16_signatures", f"""WITH {i.FILES} SELECT "group", sha256(string_agg(path || chr(0) || CAST(size AS VARCHAR) || chr(0) || CAST(doc_id AS VARCHAR), chr(0) ORDER BY path)) AS signature FROM files GROUP BY "group" """)
def a16_signatures(s, d):
    return manifest.signature(i.files(s, d).withColumn("mtime_ns", F.col("doc_id")))


@query("j13_compared", f"""WITH {i.FILES}, l AS (SELECT "group", count(*) AS r FROM files WHERE "group" != 'src1' GROUP BY "group"), q AS (SELECT "group", count(*) AS r FROM files WHERE "group" != 'src2' AND ("group" < 'src5' OR doc_id % 2 = 0) GROUP BY "group") SELECT coalesce(l."group", q."group") AS "group", CASE WHEN q.r IS NULL THEN 'fresh' WHEN l.r IS NULL THEN 'remote only' WHEN l.r = q.r THEN 'in sync' ELSE 'diverged' END AS state FROM l FULL JOIN q ON l."group" = q."group" """)
def j13_compared(s, d):
    f = i.files(s, d)
    return manifest.compare(manifest.root(f.where("`group` != 'src1'")), manifest.root(f.where("`group` != 'src2' and (`group` < 'src5' or doc_id % 2 = 0)")))


def _neighbours(s, d):
    t = i.table(s, d, "documents").select("doc_id", "text")
    return t.select(F.col("doc_id").alias("id"), F.col("text").alias("reference")).join(t.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("hypothesis")), "id")


@query("a17_error_rates")
def a17_error_rates(s, d):
    """Character error rates between neighbouring texts, too long for SQL's distance; tested against a table."""
    return metrics.error_rates(_neighbours(s, d)).select("id", "cer")


@query("a17_word_error_rates")
def a17_word_error_rates(s, d):
    """Word error rates, which DuckDB has no function for; tested against a table."""
    return metrics.error_rates(_neighbours(s, d)).select("id", "wer")


_TURN_PAIRS = r"""n AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM conversations),
p AS (SELECT r.id, r.x AS r, h.x AS h FROM n r JOIN n h ON h.conv_id = r.conv_id AND h.turn = r.turn + 1)"""


def _turn_pairs(s, d):
    c = i.table(s, d, "conversations")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return c.join(following, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("reference"), "hypothesis")


@query("a17_turn_character_error_rates", f"WITH {_TURN_PAIRS}, c AS (SELECT id, translate(replace(r, ' ', ''), 'ßäçèéêíñóöü', 'ABCDEFGHIJK') AS r, translate(replace(h, ' ', ''), 'ßäçèéêíñóöü', 'ABCDEFGHIJK') AS h FROM p) SELECT id, round(levenshtein(r, h) / greatest(length(r), 1), 4) AS cer FROM c")
def a17_turn_character_error_rates(s, d):
    """A17 between neighbouring turns of a conversation; the SQL's distance counts bytes, so it writes each letter as one."""
    return metrics.error_rates(_turn_pairs(s, d)).select("id", "cer")


@query(
    "a17_turn_word_error_rates",
    f"""WITH RECURSIVE {_TURN_PAIRS},
w AS (SELECT id, list_filter(string_split(r, ' '), lambda v: v != '') AS a, list_filter(string_split(h, ' '), lambda v: v != '') AS b FROM p),
t AS (
  SELECT id, a, b, 0 AS i, range(0, len(b) + 1) AS row FROM w
  UNION ALL
  SELECT id, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: j + list_min(list_transform(range(1, j + 1), lambda k: u[k] - k)))
  FROM (SELECT *, list_transform(range(0, len(b) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(row[j + 1] + 1, row[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END) END) AS u FROM t WHERE i < len(a))
)
SELECT id, round(row[len(b) + 1] / greatest(len(a), 1), 4) AS wer FROM t WHERE i = len(a)""",
)
def a17_turn_word_error_rates(s, d):
    return metrics.error_rates(_turn_pairs(s, d)).select("id", "wer")


@query("a18_speaker_counts", "SELECT user_id AS id, count(DISTINCT event_type) AS speakers FROM events GROUP BY user_id")
def a18_speaker_counts(s, d):
    return i.table(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.countDistinct("event_type").alias("speakers"))


@query("a10_weighted_scores", "SELECT l_orderkey AS id, sum(CAST(l_quantity AS BIGINT) * n) / sum(n) AS score FROM (SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE l_linenumber END AS n FROM lineitem) GROUP BY l_orderkey")
def a10_weighted_scores(s, d):
    l = i.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("long").alias("score"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber")).alias("n_tokens"))  # noqa: E741
    return metrics.weighted_score(l)


@query("a11_mean_logs", "SELECT l_orderkey AS id, coalesce(round(avg(ln(l_discount)) FILTER (l_discount > 0), 9), 0.0) AS score FROM lineitem GROUP BY l_orderkey")
def a11_mean_logs(s, d):
    return metrics.mean_log(i.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_discount").alias("p"))).withColumn("score", F.round("score", 9))


@query("a12_sequence_scores", "SELECT o_orderkey AS id, round(o_totalprice * 10 / 11, 6) AS score FROM orders")
def a12_sequence_scores(s, d):
    return i.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(metrics.sequence_score(F.col("o_totalprice"), F.lit(10)), 6).alias("score"))


@query("a19_real_time_factors", "SELECT user_id AS id, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS ms, max(event_id) AS audio_ms, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) / nullif(max(event_id), 0) AS rtf FROM events GROUP BY user_id")
def a19_real_time_factors(s, d):
    e = i.table(s, d, "events").select(F.col("user_id").alias("id"), F.floor(F.col("value") * 1000).alias("ms"), F.col("event_id").alias("audio_ms"))
    return metrics.real_time_factor(e)


@query("a20_eligible", "SELECT event_type AS speaker, count(*) AS n FROM events GROUP BY event_type HAVING count(*) >= 1900 // 5")
def a20_eligible(s, d):
    return metrics.eligible(i.table(s, d, "events").select(F.col("event_type").alias("speaker")), 1896, 5)


@query("a5_runs", "WITH p AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, length(event_type) AS token, event_id AS frame, CAST(event_id % 16 AS DOUBLE) / 16 AS score FROM events), m AS (SELECT *, CASE WHEN token != lag(token) OVER (PARTITION BY id ORDER BY step) THEN 1 ELSE 0 END AS new FROM p), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY id ORDER BY step) AS BIGINT) AS run FROM m) SELECT id, run, first(token) AS token, min(frame) AS \"from\", max(frame) + 1 AS \"to\", avg(score) AS score FROM r GROUP BY id, run")
def a5_runs(s, d):
    return ctc.merge_repeats(_path(s, d))


def _path(s, d):
    from pyspark.sql import Window as W

    step = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return i.table(s, d, "events").select(F.col("user_id").alias("id"), step.alias("step"), F.length("event_type").cast("long").alias("token"), F.col("event_id").alias("frame"), ((F.col("event_id") % 16).cast("double") / 16).alias("score"))


@query("a6_words", "WITH p AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run, CASE WHEN event_type = 'view' THEN '|' ELSE substr(event_type, 1, 1) END AS label, event_id AS f, event_id + 2 + event_id % 3 AS t, CAST(event_id % 16 AS DOUBLE) / 16 AS score FROM events), w AS (SELECT *, CAST(sum(CASE WHEN label = '|' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY run) AS BIGINT) AS word FROM p) SELECT id, word, string_agg(label, '' ORDER BY run) AS text, min(f) AS \"from\", max(t) AS \"to\", sum(score * (t - f)) / sum(t - f) AS score FROM w WHERE label != '|' GROUP BY id, word")
def a6_words(s, d):
    from pyspark.sql import Window as W

    run = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    label = F.when(F.col("event_type") == "view", "|").otherwise(F.substring("event_type", 1, 1))
    rows = i.table(s, d, "events").select(F.col("user_id").alias("id"), run.alias("run"), label.alias("label"), F.col("event_id").alias("from"), (F.col("event_id") + 2 + F.col("event_id") % 3).alias("to"), ((F.col("event_id") % 16).cast("double") / 16).alias("score"))
    return ctc.merge_words(rows)


@query("p6_language_tags", "SELECT DISTINCT tag, regexp_full_match(tag, '[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})?') AS valid FROM (SELECT lang AS tag FROM documents UNION ALL SELECT lang || '-' || source FROM documents UNION ALL SELECT event_type FROM events UNION ALL SELECT '')")
def p6_language_tags(s, d):
    t = i.table(s, d, "documents")
    tags = t.select(F.col("lang").alias("tag")).union(t.select(F.concat_ws("-", "lang", "source"))).union(i.table(s, d, "events").select("event_type")).union(s.range(1).select(F.lit("")))
    return tags.distinct().select("tag", texts.valid_language(F.col("tag")).alias("valid"))


@query("p7_languages", "SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'es' END AS code FROM documents")
def p7_languages(s, d):
    """Spellings of languages to codes, by a small table."""
    known = s.createDataFrame(texts.language_rows(), "spelling string, code string")
    spelled = F.when(F.col("lang") == "de", "German").when(F.col("lang") == "es", "Castilian").when(F.col("lang") == "fr", "FR").otherwise(F.col("lang"))
    rows = i.table(s, d, "documents").select("doc_id", F.lower(spelled).alias("spelling"))
    return rows.join(F.broadcast(known.distinct()), "spelling", "left").select("doc_id", "code")


@query("p16_numerals", "SELECT conv_id, turn, regexp_matches(text, '[0-9%$£]') AS numeral FROM conversations")
def p16_numerals(s, d):
    """P16."""
    return i.table(s, d, "conversations").select("conv_id", "turn", texts.has_numeral(F.col("text")).alias("numeral"))


def _aligners_sql() -> str:
    return ", ".join(f"('{lang}', '{model}', '{kind}')" for kind, table in (("bundle", aligners.BUNDLES), ("hub", aligners.HUB)) for lang, model in table.items())


@query("n5_aligners", f"""WITH known(lang, model, kind) AS (VALUES {_aligners_sql()}), d AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'ja' WHEN 1 THEN 'xx' WHEN 2 THEN 'sv' ELSE lang END AS language, CASE doc_id % 10 WHEN 0 THEN 'own/model' WHEN 1 THEN ' ' WHEN 2 THEN 'VOXPOPULI_ASR_BASE_10K_IT' END AS chosen FROM documents)
SELECT doc_id, coalesce(nullif(trim(chosen), ''), model) AS model, CASE WHEN nullif(trim(chosen), '') IS NULL THEN kind WHEN chosen IN (SELECT model FROM known WHERE kind = 'bundle') THEN 'bundle' ELSE 'hub' END AS kind FROM d LEFT JOIN known ON known.lang = d.language""")
def n5_aligners(s, d):
    """The model that aligns each text's language."""
    n = F.col("doc_id")
    language = F.when(n % 7 == 0, "ja").when(n % 7 == 1, "xx").when(n % 7 == 2, "sv").otherwise(F.col("lang"))
    chosen = F.when(n % 10 == 0, "own/model").when(n % 10 == 1, " ").when(n % 10 == 2, "VOXPOPULI_ASR_BASE_10K_IT")
    return i.table(s, d, "documents").select("doc_id", aligners.aligner(language, chosen).alias("a")).select("doc_id", "a.model", "a.kind")


@query("n3_detected", "WITH e AS (SELECT user_id AS recording_id, event_type AS language, max(floor(value)) / 128 AS probability, sum(floor(value) * 100) AS length_ms FROM events GROUP BY ALL), l AS (SELECT recording_id, sum(length_ms) AS length_ms FROM e GROUP BY recording_id) SELECT e.recording_id, arg_min(language, (-probability, language)) AS language, max(probability) AS probability, bool_and(l.length_ms < 30000) AS short FROM e JOIN l ON l.recording_id = e.recording_id GROUP BY e.recording_id")
def n3_detected(s, d):
    """Each recording's language by a detector's scores; values stand for them."""
    e = i.table(s, d, "events").select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("language"), F.floor("value").alias("v"))
    scores = e.groupBy("recording_id", "language").agg((F.max("v") / 128).alias("probability"))
    return aligners.detected(scores, e.groupBy("recording_id").agg((F.sum("v") * 100).alias("length_ms")))


@query("p17_options", "SELECT DISTINCT x, CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS INTEGER) END AS number, nullif(trim(x), '') AS text FROM (SELECT CAST(p_size AS VARCHAR) AS x FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT '  ')")
def p17_options(s, d):
    """P17, P8."""
    p = i.table(s, d, "part")
    rows = p.select(F.col("p_size").cast("string").alias("x")).union(p.select("p_brand")).union(s.range(1).select(F.lit("  "))).distinct()
    return rows.select("x", texts.number_option(F.col("x")).alias("number"), texts.text_option(F.col("x")).alias("text"))


@query("p13_usable_clips", r"SELECT event_id AS id, trim(regexp_replace(CASE WHEN event_id % 4 = 0 THEN '[noise] ' ELSE '[a] ' || event_type END, '\[[^\]]*\]', '', 'g')) AS sentence FROM events WHERE event_id % 4 != 0 AND floor(value) BETWEEN 10 AND 90")
def p13_usable_clips(s, d):
    from ..sources.files import usable_clips

    sentence = F.when(F.col("event_id") % 4 == 0, "[noise] ").otherwise(F.concat(F.lit("[a] "), F.col("event_type")))
    return usable_clips(i.table(s, d, "events").select(F.col("event_id").alias("id"), sentence.alias("sentence"), F.floor("value").alias("duration_ms")), 10, 90).select("id", "sentence")


@query("t5_lengths", f"WITH {i.SESSIONS} SELECT id, CASE WHEN duration_ms >= 3600000 THEN CAST(duration_ms // 3600000 AS VARCHAR) || 'h ' || lpad(CAST(duration_ms // 60000 % 60 AS VARCHAR), 2, '0') || 'm' ELSE CAST(duration_ms // 60000 AS VARCHAR) || 'm' END AS total, CASE WHEN duration_ms < 1024 THEN CAST(duration_ms AS VARCHAR) || ' B' WHEN duration_ms < 1048576 THEN printf('%d.%d KB', CAST(round_even(duration_ms * 10 / 1024, 0) AS BIGINT) // 10, CAST(round_even(duration_ms * 10 / 1024, 0) AS BIGINT) % 10) WHEN duration_ms < 1073741824 THEN printf('%d.%d MB', CAST(round_even(duration_ms * 10 / 1048576, 0) AS BIGINT) // 10, CAST(round_even(duration_ms * 10 / 1048576, 0) AS BIGINT) % 10) END AS size FROM sessions")
def t5_lengths(s, d):
    """T5, T8."""
    return i.sessions(s, d).select("id", times.total(F.col("duration_ms")).alias("total"), times.size(F.col("duration_ms")).alias("size"))


@query("t7_ago", f"WITH {i.SESSIONS}, a AS (SELECT id, created_at, CAST(epoch(TIMESTAMP '1998-10-04 00:00:30') - epoch(TRY_CAST(created_at AS TIMESTAMP)) AS BIGINT) AS s FROM sessions) SELECT id, CASE WHEN s < 45 THEN 'just now' WHEN s < 3600 THEN CAST(greatest(s // 60, 1) AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE {_DATE} END AS ago FROM a")
def t7_ago(s, d):
    now = F.to_timestamp(F.lit("1998-10-04 00:00:30"))
    return i.sessions(s, d).select("id", times.ago(F.col("created_at"), now).alias("ago"))


@query("k2_basenames", f"WITH {i.SESSIONS} SELECT id, CASE WHEN filename IS NOT NULL THEN 'clip.' || substr(filename, 6, length(filename) - 9) || '.srt' END AS name FROM sessions")
def k2_basenames(s, d):
    from ..operators.writers import basename

    return i.sessions(s, d).select("id", basename(F.concat(F.lit("/in/"), F.col("filename")), "srt").alias("name"))


@query("a23_compression")
def a23_compression(s, d):
    return metrics.compression_ratio(i.table(s, d, "conversations")).select("conv_id", "turn", "ratio")


@query("m14_migrated", "SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS model FROM customer UNION ALL SELECT s_suppkey, s_name, 'base' FROM supplier")
def m14_migrated(s, d):
    """Appended rows that have a column more."""
    old = i.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = i.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("base").alias("model"))
    return old.unionByName(new, allowMissingColumns=True)
