"""Queries over segments, words and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts, times
from ..operators import align, edits, folds, interpolate, intervals, overlay, subtitles, turns, writers
from . import inputs as i

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_TURNS = (
    i.SEGMENTS
    + """,
marked AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS new
           FROM seg WINDOW w AS (PARTITION BY recording_id ORDER BY seg_idx)),
islands AS (SELECT * EXCLUDE new, CAST(sum(new) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS BIGINT) AS turn FROM marked),
turns AS (
  SELECT recording_id, turn, first(speaker) AS speaker, arg_min_null(start_ms, seg_idx) AS start_ms, arg_max_null(end_ms, seg_idx) AS end_ms,
         min(seg_idx) AS seg_first, max(seg_idx) AS seg_last, count(*) AS n_segments,
         coalesce(string_agg(CASE WHEN trim(text) != '' THEN trim(text) END, ' ' ORDER BY seg_idx), '') AS text
  FROM islands GROUP BY recording_id, turn
)"""
)
_LABEL = "CASE WHEN coalesce({0}, '') = '' THEN 'Speaker' WHEN regexp_full_match({0}, 'SPEAKER_[0-9]+') THEN 'Speaker ' || CAST(CAST(substr({0}, 9) AS BIGINT) + 1 AS VARCHAR) ELSE {0} END"
_CLOCK = "CASE WHEN {0} IS NULL THEN '--:--' WHEN {0} >= 3600000 THEN CAST({0} // 3600000 AS VARCHAR) || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') ELSE CAST({0} // 60000 AS VARCHAR) || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') END"
_STAMP = "lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || '{1}' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"
_HOURS = "printf('%02d', {0} // 3600000) || ':' || " + _STAMP


def turn_rows(s, d):
    return turns.group_turns(i.segments(s, d))


@query("f5_turns", f"WITH {_TURNS} SELECT recording_id, turn, speaker, {_LABEL.format('speaker')} AS label, start_ms, end_ms, {_CLOCK.format('start_ms')} AS begins, {_CLOCK.format('end_ms')} AS ends, seg_first, seg_last, n_segments, text FROM turns")
def f5_turns(s, d):
    """Speaker turns with labels and clock spans."""
    t = turn_rows(s, d)
    return t.select("recording_id", "turn", "speaker", texts.speaker_label(F.col("speaker")).alias("label"), "start_ms", "end_ms", times.clock(F.col("start_ms")).alias("begins"), times.clock(F.col("end_ms")).alias("ends"), "seg_first", "seg_last", "n_segments", "text")


@query("p3_built_turns", f"WITH {_TURNS} SELECT recording_id, turn, start_ms, text FROM turns WHERE text != ''")
def p3_built_turns(s, d):
    """Turns without words go, the others keep their numbers."""
    return turn_rows(s, d).where("text != ''").select("recording_id", "turn", "start_ms", "text")


@query("a8_speakers", f"WITH {i.SEGMENTS} SELECT recording_id, speaker, min(seg_idx) AS seg_idx, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY min(seg_idx)) - 1 AS BIGINT) AS place FROM seg WHERE coalesce(speaker, '') != '' GROUP BY recording_id, speaker")
def a8_speakers(s, d):
    return turns.speakers(i.segments(s, d))


@query("a9_next_speaker", f"WITH {i.SEGMENTS} SELECT recording_id, 'SPEAKER_' || printf('%02d', coalesce(max(TRY_CAST(substr(speaker, 9) AS BIGINT)) FILTER (starts_with(speaker, 'SPEAKER_')), -1) + 1) AS speaker FROM seg GROUP BY recording_id")
def a9_next_speaker(s, d):
    return turns.next_speaker_key(i.segments(s, d))


_COALESCED = (
    _TURNS.replace("WITH ", "")
    + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY recording_id, turn ORDER BY seg_idx) AS k, greatest(coalesce(end_ms - start_ms, 0), 0) AS ms FROM islands),
fold AS (
  SELECT recording_id, turn, k, seg_idx, CASE WHEN ms >= 20000 THEN 0 ELSE ms END AS held, 0 AS piece, CASE WHEN ms >= 20000 THEN 1 ELSE 0 END AS done FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.recording_id, n.turn, n.k, n.seg_idx, CASE WHEN f.held + n.ms >= 20000 THEN 0 ELSE f.held + n.ms END, f.done, f.done + CASE WHEN f.held + n.ms >= 20000 THEN 1 ELSE 0 END
  FROM fold f JOIN numbered n ON n.recording_id = f.recording_id AND n.turn = f.turn AND n.k = f.k + 1
),
pieces AS (SELECT *, least(piece, greatest(max(done) OVER (PARTITION BY recording_id, turn) - 1, 0)) AS p FROM fold)"""
)


@query(
    "f6_coalesced",
    f"""WITH RECURSIVE {_COALESCED}
SELECT recording_id, first(speaker) AS speaker, arg_min(start_ms, seg_idx) AS start_ms, arg_max(end_ms, seg_idx) AS end_ms,
       coalesce(string_agg(CASE WHEN trim(text) != '' THEN trim(text) END, ' ' ORDER BY seg_idx), '') AS text, min(seg_idx) AS from_idx, max(seg_idx) AS to_idx,
       CAST(row_number() OVER (PARTITION BY recording_id ORDER BY min(seg_idx)) - 1 AS BIGINT) AS seg_idx
FROM islands JOIN pieces USING (recording_id, turn, seg_idx) GROUP BY recording_id, turn, p""",
)
def f6_coalesced(s, d):
    """F6 with 20 seconds, as the sample's segments are long."""
    return turns.coalesce_segments(i.segments(s, d), 20_000)


@query("j1_overlaps", f"WITH {i.SPANS} SELECT recording_id, probe_id, ord, speaker, least(p_end, s_end) - greatest(p_start, s_start) AS overlap_ms FROM probes JOIN spans USING (recording_id) WHERE s_start < p_end AND s_end > p_start AND least(p_end, s_end) > greatest(p_start, s_start)")
def j1_overlaps(s, d):
    return intervals.overlaps(i.probes(s, d), i.spans(s, d)).select("recording_id", "probe_id", "ord", "speaker", "overlap_ms")


@query("j1_binned", SQL["j1_overlaps"])
def j1_binned(s, d):
    return intervals.binned_overlaps(i.probes(s, d), i.spans(s, d)).select("recording_id", "probe_id", "ord", "speaker", "overlap_ms")


_DOMINANT = (
    i.SPANS
    + """,
each AS (SELECT recording_id, probe_id, speaker, sum(least(p_end, s_end) - greatest(p_start, s_start)) AS ms, min(s_start) AS s, arg_min(ord, (s_start, ord)) AS o
         FROM probes JOIN spans USING (recording_id) WHERE least(p_end, s_end) > greatest(p_start, s_start) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY recording_id, probe_id ORDER BY ms DESC, s, o) AS r FROM each)"""
)


@query("j2_dominant_speaker", f"WITH {_DOMINANT} SELECT p.recording_id, p.probe_id, p.p_start, p.p_end, b.speaker, CAST(coalesce(b.ms, 0) AS BIGINT) AS overlap_ms FROM probes p LEFT JOIN best b ON b.recording_id = p.recording_id AND b.probe_id = p.probe_id AND b.r = 1")
def j2_dominant_speaker(s, d):
    return intervals.dominant_speaker(i.probes(s, d), i.spans(s, d))


@query(
    "j3_nearest_speaker",
    f"""WITH {_DOMINANT}, near AS (
  SELECT p.recording_id, p.probe_id, s.speaker, row_number() OVER (PARTITION BY p.recording_id, p.probe_id ORDER BY abs((s_start + s_end) - (p_start + p_end)), s_start, ord) AS r
  FROM probes p JOIN spans s USING (recording_id))
SELECT p.recording_id, p.probe_id, p.p_start, p.p_end, coalesce(b.speaker, n.speaker) AS speaker, CAST(coalesce(b.ms, 0) AS BIGINT) AS overlap_ms
FROM probes p LEFT JOIN best b ON b.recording_id = p.recording_id AND b.probe_id = p.probe_id AND b.r = 1
LEFT JOIN near n ON n.recording_id = p.recording_id AND n.probe_id = p.probe_id AND n.r = 1""",
)
def j3_nearest_speaker(s, d):
    return intervals.dominant_speaker(i.probes(s, d), i.spans(s, d), nearest=True, binned=True)


@query("j5_as_of_word", f"WITH {i.WORDS}, asks AS (SELECT recording_id, event_id AS ask_id, start_ms + 7000 AS at_ms FROM seg), w AS (SELECT recording_id, start_ms, seg_idx * 10 + word_idx AS word_idx, word FROM words WHERE start_ms IS NOT NULL) SELECT a.recording_id, a.ask_id, a.at_ms, arg_max(w.word_idx, (w.start_ms, w.word_idx)) AS word_idx, arg_max(w.word, (w.start_ms, w.word_idx)) AS word FROM asks a LEFT JOIN w ON w.recording_id = a.recording_id AND w.start_ms <= a.at_ms GROUP BY ALL")
def j5_as_of_word(s, d):
    """The word at a playhead."""
    asks = i.segments(s, d).select("recording_id", F.col("event_id").alias("ask_id"), (F.col("start_ms") + 7000).alias("at_ms"))
    return intervals.as_of(asks, i.words(s, d).withColumn("word_idx", F.col("seg_idx") * 10 + F.col("word_idx")))


@query("p19_word_classes", f"WITH {i.WORDS} SELECT recording_id, seg_idx, word_idx, CASE WHEN start_ms IS NULL THEN 'future' WHEN end_ms <= 2000000 THEN 'played' WHEN start_ms <= 2000000 THEN 'active' ELSE 'future' END AS class FROM words")
def p19_word_classes(s, d):
    now = 2_000_000
    kind = F.when(F.col("start_ms").isNull(), "future").when(F.col("end_ms") <= now, "played").when(F.col("start_ms") <= now, "active").otherwise("future")
    return i.words(s, d).select("recording_id", "seg_idx", "word_idx", kind.alias("class"))


@query("j11_active_speakers", f"WITH {i.SPANS} SELECT DISTINCT recording_id, speaker FROM spans WHERE least(s_end, 2000000) > greatest(s_start, 1000000)")
def j11_active_speakers(s, d):
    return intervals.active_speakers(i.spans(s, d), 1_000_000, 2_000_000)


@query("a22_support", f"WITH {i.SPANS}, m AS (SELECT *, CASE WHEN s_start - max(s_end) OVER (PARTITION BY recording_id ORDER BY s_start, s_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 5000 THEN 0 ELSE 1 END AS new FROM spans), g AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY s_start, s_end ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT recording_id, min(s_start) AS s_start, max(s_end) AS s_end, count(*) AS n FROM g GROUP BY recording_id, island")
def a22_support(s, d):
    return intervals.support(i.spans(s, d), 5_000)


@query("p18_min_duration", f"WITH {i.SEGMENTS} SELECT recording_id, seg_idx, start_ms, end_ms FROM seg WHERE end_ms - start_ms >= 10000")
def p18_min_duration(s, d):
    return folds.drop_short(i.segments(s, d), 10_000).select("recording_id", "seg_idx", "start_ms", "end_ms")


@query(
    "f7_chunks",
    f"""WITH RECURSIVE {i.SEGMENTS},
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) AS k FROM seg WHERE end_ms IS NOT NULL),
fold AS (
  SELECT recording_id, k, seg_idx, start_ms, end_ms, start_ms AS begin, end_ms AS last, 0 AS chunk FROM o WHERE k = 1
  UNION ALL
  SELECT o.recording_id, o.k, o.seg_idx, o.start_ms, o.end_ms, CASE WHEN cut THEN o.start_ms ELSE begin END, o.end_ms, chunk + CASE WHEN cut THEN 1 ELSE 0 END
  FROM (SELECT f.recording_id AS r, f.k + 1 AS n, f.begin, f.last, f.chunk, o2.end_ms - f.begin > 300000 AND f.last - f.begin > 0 AS cut
        FROM fold f JOIN o o2 ON o2.recording_id = f.recording_id AND o2.k = f.k + 1) x JOIN o ON o.recording_id = x.r AND o.k = x.n
)
SELECT recording_id, CAST(chunk AS BIGINT) AS chunk, arg_min(start_ms, seg_idx) AS start_ms, arg_max(end_ms, seg_idx) AS end_ms, count(*) AS n_segments FROM fold GROUP BY recording_id, chunk""",
)
def f7_chunks(s, d):
    return folds.merge_chunks(i.segments(s, d).where("end_ms is not null"), 300_000).drop("segments")


@query(
    "f9_batches",
    """WITH RECURSIVE o AS (SELECT conv_id AS doc, turn AS pos, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
fold AS (
  SELECT doc, pos, k, 0 AS batch, 1 AS cnt, n AS chars FROM o WHERE k = 1
  UNION ALL
  SELECT doc, pos, k, batch + full_, CASE WHEN full_ = 1 THEN 1 ELSE cnt + 1 END, CASE WHEN full_ = 1 THEN n ELSE chars + n END
  FROM (SELECT o.doc, o.pos, o.k, o.n, f.batch, f.cnt, f.chars, CASE WHEN f.cnt >= 3 OR f.chars + o.n > 1500 THEN 1 ELSE 0 END AS full_ FROM fold f JOIN o ON o.doc = f.doc AND o.k = f.k + 1)
)
SELECT doc, pos, CAST(batch AS BIGINT) AS batch, CAST(row_number() OVER (PARTITION BY doc, batch ORDER BY pos) - 1 AS BIGINT) AS place FROM fold""",
)
def f9_batches(s, d):
    """F9 with 3 texts and 1,500 characters, as the sample's documents are short."""
    c = i.table(s, d, "conversations")
    return folds.batches(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), "text"), 3, 1500)


_SCORES = f"{i.SEGMENTS}, scores AS (SELECT recording_id, seg_idx AS frame, start_ms AS t_ms, CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS score FROM seg)"


def _scores(s, d):
    return i.segments(s, d).select("recording_id", F.col("seg_idx").alias("frame"), F.col("start_ms").alias("t_ms"), ((F.col("event_id") * 7919 % 1000).cast("double") / 1000).alias("score"))


@query(
    "f8_regions",
    f"""WITH {_SCORES},
st AS (SELECT *, coalesce(last_value(CASE WHEN score > 0.5 THEN 1 WHEN score < 0.363 THEN 0 END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS act FROM scores),
wa AS (SELECT *, coalesce(lag(act) OVER (PARTITION BY recording_id ORDER BY frame), 0) AS was FROM st),
re AS (SELECT *, sum(CASE WHEN act = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS region FROM wa)
SELECT recording_id, CAST(region AS BIGINT) - 1 AS region, min(t_ms) AS start_ms, max(t_ms) AS end_ms FROM re WHERE act = 1 OR was = 1 GROUP BY recording_id, region""",
)
def f8_regions(s, d):
    return folds.regions(_scores(s, d))


@query(
    "f8_binarized",
    f"""WITH RECURSIVE {_SCORES},
f AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY frame) AS i, {{'y': score, 't': t_ms}} AS x FROM scores),
st AS (
  SELECT recording_id, i, x, x.y > 0.5 AS act, x.t AS start, [x] AS held, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM f WHERE i = 1
  UNION ALL
  SELECT recording_id, i, x, CASE WHEN NOT act THEN x.y > 0.5 ELSE long OR x.y >= 0.363 END, CASE WHEN NOT act AND x.y > 0.5 THEN x.t WHEN act AND long THEN held[cut].t ELSE start END,
         CASE WHEN NOT act THEN held WHEN long THEN list_append(held[cut + 1:], x) WHEN x.y < 0.363 THEN [x] ELSE list_append(held, x) END,
         CASE WHEN act AND (long OR x.y < 0.363) THEN start END, CASE WHEN act AND long THEN held[cut].t WHEN act AND x.y < 0.363 THEN x.t END
  FROM (SELECT s.recording_id, f.i, f.x, act, start, held, f.x.t - start > 200000 AS long, len(held) // 2 + list_position(held[len(held) // 2 + 1:], list_min(held[len(held) // 2 + 1:])) AS cut
        FROM st s JOIN f ON f.recording_id = s.recording_id AND f.i = s.i + 1)
), spans AS (
  SELECT recording_id, a - 100 AS a, b + 100 AS b FROM st WHERE a IS NOT NULL
  UNION ALL SELECT recording_id, start - 100, x.t + 100 FROM st QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY i DESC) = 1 AND act
), m AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY recording_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS new FROM spans
), g AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m
)
SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY min(a)) - 1 AS BIGINT) AS region, CAST(min(a) AS BIGINT) AS start_ms, CAST(max(b) AS BIGINT) AS end_ms FROM g GROUP BY recording_id, k""",
)
def f8_binarized(s, d):
    """F8 with a longest duration and padding."""
    return folds.binarize(_scores(s, d), max_ms=200_000, pad_onset_ms=100, pad_offset_ms=100)


_NEAR = """nb AS (SELECT *, row_number() OVER w AS rn, count(start_ms) OVER (PARTITION BY recording_id, seg_idx) AS known, count(*) OVER (PARTITION BY recording_id, seg_idx) AS n FROM words WINDOW w AS (PARTITION BY recording_id, seg_idx ORDER BY word_idx)),
lr AS (SELECT *, last_value(CASE WHEN start_ms IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS lp, first_value(CASE WHEN start_ms IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS rp,
                 last_value(start_ms IGNORE NULLS) OVER b AS ls, first_value(start_ms IGNORE NULLS) OVER a AS rs, last_value(end_ms IGNORE NULLS) OVER b AS le, first_value(end_ms IGNORE NULLS) OVER a AS re
       FROM nb WINDOW b AS (PARTITION BY recording_id, seg_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY recording_id, seg_idx ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(
    "f3_filled_words",
    f"""WITH {i.WORDS}, {_NEAR}
SELECT recording_id, seg_idx, word_idx,
       CASE WHEN start_ms IS NOT NULL OR known = 0 OR known = n THEN start_ms WHEN lp IS NULL THEN rs WHEN rp IS NULL THEN ls WHEN rn - lp <= rp - rn THEN ls ELSE rs END AS start_ms,
       CASE WHEN end_ms IS NOT NULL OR known = 0 OR known = n THEN end_ms WHEN lp IS NULL THEN re WHEN rp IS NULL THEN le WHEN rn - lp <= rp - rn THEN le ELSE re END AS end_ms
FROM lr""",
)
def f3_filled_words(s, d):
    """gaps filled with the nearest time by place."""
    rows = i.words(s, d).select("recording_id", "seg_idx", "word_idx", "start_ms", "end_ms")
    return interpolate.fill_gaps(rows, ["recording_id", "seg_idx"], "word_idx", ["start_ms", "end_ms"])


@query(
    "f10_spread_words",
    f"""WITH {i.WORDS},
g AS (SELECT *, sum(CASE WHEN start_ms IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id, seg_idx ORDER BY word_idx) AS run,
             last_value(end_ms IGNORE NULLS) OVER (PARTITION BY recording_id, seg_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
             first_value(start_ms IGNORE NULLS) OVER (PARTITION BY recording_id, seg_idx ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM words),
h AS (SELECT *, coalesce(l, seg_start) AS lo, coalesce(r, seg_end) - coalesce(l, seg_start) AS w, count(*) OVER q AS n, row_number() OVER (PARTITION BY recording_id, seg_idx, run, start_ms IS NULL ORDER BY word_idx) - 1 AS k
      FROM g WINDOW q AS (PARTITION BY recording_id, seg_idx, run, start_ms IS NULL))
SELECT recording_id, seg_idx, word_idx, CASE WHEN start_ms IS NULL AND w >= 0 THEN lo + CAST(w * k // n AS BIGINT) ELSE start_ms END AS start_ms,
       CASE WHEN start_ms IS NULL AND w >= 0 THEN lo + CAST(w * (k + 1) // n AS BIGINT) ELSE end_ms END AS end_ms FROM h""",
)
def f10_spread_words(s, d):
    rows = i.words(s, d).withColumnsRenamed({"seg_start": "from_ms", "seg_end": "to_ms"})
    return interpolate.spread(rows, ["recording_id", "seg_idx"], "word_idx").select("recording_id", "seg_idx", "word_idx", "start_ms", "end_ms")


@query(
    "f10_borrowed",
    f"""WITH RECURSIVE {i.WORDS},
w AS (SELECT recording_id, seg_idx, word_idx, start_ms / 50000.0::DOUBLE AS s, end_ms / 50000.0::DOUBLE AS e, seg_start / 50000.0::DOUBLE AS lo, seg_end / 50000.0::DOUBLE AS hi,
             row_number() OVER (PARTITION BY recording_id, seg_idx ORDER BY word_idx) - 1 AS p, count(*) OVER (PARTITION BY recording_id, seg_idx) AS n,
             count(start_ms) OVER (PARTITION BY recording_id, seg_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS k FROM words),
a AS (SELECT * FROM w WHERE s IS NOT NULL UNION ALL SELECT DISTINCT recording_id, seg_idx, NULL, NULL, NULL, lo, hi, -1, n, 0 FROM w),
g AS (SELECT recording_id, seg_idx, k, p, s, e, lead(s) OVER q AS rs, lead(e) OVER q AS re, coalesce(lead(p) OVER q, n) - p - 1 AS m, coalesce(e, lo) AS b, coalesce(lead(s) OVER q, hi) AS f FROM a WINDOW q AS (PARTITION BY recording_id, seg_idx ORDER BY k)),
z AS (
  SELECT *, CAST(NULL AS DOUBLE) AS was, CAST(0 AS DOUBLE) AS give, CASE WHEN m > 0 AND f >= b THEN least(greatest(coalesce(re - rs - 0.1::DOUBLE, 0), 0), greatest(m * 0.1::DOUBLE - (f - b), 0)) ELSE 0 END AS take FROM g WHERE k = 0
  UNION ALL
  SELECT * EXCLUDE (lack, l, r), CASE WHEN lack > 0 THEN least(l, greatest(lack / 2, lack - r)) ELSE 0 END AS give, CASE WHEN lack > 0 THEN least(r, lack - least(l, greatest(lack / 2, lack - r))) ELSE 0 END AS take
  FROM (SELECT g.*, z.rs + z.take AS was, CASE WHEN g.m > 0 AND g.f >= g.b THEN greatest(g.m * 0.1::DOUBLE - (g.f - g.b), 0) ELSE 0 END AS lack,
               greatest(coalesce(g.e - (z.rs + z.take) - 0.1::DOUBLE, 0), 0) AS l, greatest(coalesce(g.re - g.rs - 0.1::DOUBLE, 0), 0) AS r FROM z JOIN g ON g.recording_id = z.recording_id AND g.seg_idx = z.seg_idx AND g.k = z.k + 1)
)
SELECT w.recording_id, w.seg_idx, w.word_idx,
       round(CASE WHEN w.s IS NOT NULL THEN z.was WHEN z.f >= z.b THEN z.b - z.give + (w.p - z.p - 1) * (z.f - z.b + z.give + z.take) / z.m END, 6) AS "start",
       round(CASE WHEN w.s IS NOT NULL THEN w.e - z.give WHEN z.f >= z.b THEN z.b - z.give + (w.p - z.p) * (z.f - z.b + z.give + z.take) / z.m END, 6) AS "end"
FROM w JOIN z USING (recording_id, seg_idx, k)""",
)
def f10_borrowed(s, d):
    """F10 with borrowing, on time so short that most gaps lack some."""
    c = lambda name: F.col(name) / 50000.0
    rows = i.words(s, d).select(F.col("recording_id").alias("recording_id"), F.col("seg_idx").alias("turn"), "word_idx", "word", c("start_ms").alias("start"), c("end_ms").alias("end"), c("seg_start").alias("turn_start"), c("seg_end").alias("turn_end"))
    return interpolate.time_turns(rows).select("recording_id", F.col("turn").alias("seg_idx"), "word_idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "f11_paths",
    f"""WITH RECURSIVE {i.SEGMENTS},
em AS (SELECT recording_id AS id, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) - 1 AS t, list_transform(range(0, 5), lambda k: -CAST((event_id * (k + 3) * 31 + k * 17) % 97 AS DOUBLE) / 50) AS f FROM seg),
sz AS (SELECT id, count(*) AS frames, greatest(least(count(*) - 1, 4), 1) AS n FROM em GROUP BY id),
mv AS (SELECT em.id, t, frames, n, f[1] AS stay, list_transform(range(1, n + 1), lambda k: CASE WHEN (em.id + k) % 7 = 0 THEN list_max(f[2:5]) ELSE f[(em.id * k) % 4 + 2] END) AS move FROM em JOIN sz ON sz.id = em.id),
fw AS (
  SELECT id, CAST(0 AS BIGINT) AS t, list_transform(range(0, n + 1), lambda j: CASE WHEN j > 0 THEN '-inf'::DOUBLE WHEN n <= frames THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS score FROM sz
  UNION ALL
  SELECT fw.id, fw.t + 1, list_transform(range(0, n + 1), lambda j: CASE WHEN j > 0 THEN greatest(score[j + 1] + stay, score[j] + move[j]) WHEN fw.t < frames - n THEN score[1] + stay ELSE 'inf'::DOUBLE END)
  FROM fw JOIN mv ON mv.id = fw.id AND mv.t = fw.t
), best AS (SELECT fw.id, arg_max(fw.t, (score[n + 1], -fw.t)) AS t, max(n) AS n FROM fw JOIN sz ON sz.id = fw.id GROUP BY fw.id
), bk AS (
  SELECT id, t, n AS j, CAST(NULL AS BIGINT) AS token, CAST(NULL AS DOUBLE) AS p FROM best
  UNION ALL
  SELECT id, t - 1, CASE WHEN on_ THEN j - 1 ELSE j END, j - 1, CASE WHEN on_ THEN m ELSE stay END
  FROM (SELECT bk.id, bk.t, bk.j, stay, move[bk.j] AS m, score[bk.j] + move[bk.j] > score[bk.j + 1] + stay AS on_
        FROM bk JOIN fw ON fw.id = bk.id AND fw.t = bk.t - 1 JOIN mv ON mv.id = bk.id AND mv.t = bk.t - 1 WHERE bk.j > 0)
)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS BIGINT) AS step, CAST(token AS BIGINT) AS token, CAST(t AS BIGINT) AS frame, round(exp(p), 9) AS score
FROM bk WHERE token IS NOT NULL AND id IN (SELECT id FROM bk WHERE j = 0)""",
)
def f11_paths(s, d):
    """Each recording's segments as frames over five symbols, and the best path of a few tokens."""
    from ..operators import ctc

    frame = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: -((F.col("event_id") * (k + 3) * 31 + k * 17) % 97).cast("double") / 50)
    rows = i.segments(s, d).groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", frame.alias("f")))), lambda x: x["f"]).alias("emission"))
    tokens = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size("emission") - 1, F.lit(4)), F.lit(1))), lambda k: F.when((F.col("recording_id") + k) % 7 == 0, -1).otherwise((F.col("recording_id") * k) % 4 + 1).cast("int"))
    return ctc.paths(rows.select(F.col("recording_id").alias("id"), "emission", tokens.alias("tokens"))).select("id", "step", "token", "frame", F.round("score", 9).alias("score"))


@query("m9_realigned")
def m9_realigned(s, d):
    """M9: texts of segments with a word put in and one taken out, timed anew; longest common runs aren't SQL's to find."""
    w = i.words(s, d).groupBy("recording_id", "seg_idx", "seg_start", "seg_end").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms"))).alias("w"))
    words = F.transform("w", lambda x: F.struct(x["word"].alias("word"), (x["start_ms"] / 1000.0).alias("start"), (x["end_ms"] / 1000.0).alias("end")))
    text = F.concat(F.lit("really "), F.array_join(F.transform(F.slice("w", 1, 2), lambda x: x["word"]), " "))
    rows = w.select("recording_id", F.col("seg_idx").alias("turn"), words.alias("words"), text.alias("text"), (F.col("seg_start") / 1000.0).alias("start"), (F.col("seg_end") / 1000.0).alias("end"))
    # Of the inner form Spark would find the words once more to see which lists are empty.
    return edits.realign(rows).select("recording_id", "turn", F.posexplode_outer("words").alias("place", "w")).where("place is not null").select("recording_id", "turn", F.col("place").cast("long").alias("place"), "w.word", F.round("w.start", 6).alias("start"), F.round("w.end", 6).alias("end"))


_CHARS = """
docs AS (SELECT doc_id AS id, text FROM documents),
chars AS (SELECT id, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS char_idx, unnest(c) AS char FROM (SELECT id, string_split(text, '') AS c FROM docs)),
ends AS (SELECT *, CASE WHEN lead(char) OVER (PARTITION BY id ORDER BY char_idx) = ' ' THEN 1 ELSE 0 END AS e FROM chars),
placed AS (SELECT id, char_idx, char, CAST(coalesce(sum(e) OVER (PARTITION BY id ORDER BY char_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS word_idx FROM ends),
timed AS (SELECT *, char_idx * 20 AS start_ms, char_idx * 20 + 15 AS end_ms, CAST((char_idx * 31 + id) % 8 AS DOUBLE) / 8 AS score FROM placed)"""


def _docs(s, d):
    return i.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _timed(s, d):
    rows = align.characters(_docs(s, d))
    score = ((F.col("char_idx") * 31 + F.col("id")) % 8).cast("double") / 8
    return rows.withColumns({"start_ms": F.col("char_idx") * 20, "end_ms": F.col("char_idx") * 20 + 15, "score": score})


def _characters():
    """Starts, ends and scores of a text's characters, in its row."""
    n = F.length("text")
    steps = lambda first: F.when(n > 0, F.sequence(F.lit(first).cast("long"), (n - 1).cast("long") * 20 + first, F.lit(20).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    eight = F.array(*(((F.lit(k * 31) + F.col("id")) % 8).cast("double") / 8 for k in range(8)))  # they repeat every eight
    return steps(0), steps(15), F.slice(F.flatten(F.array_repeat(eight, (n / 8).cast("int") + 1)), F.lit(1), n)


@query("f1_word_index", f"WITH {_CHARS} SELECT id, max(word_idx) AS last_word, count(*) AS n, CAST(sum(word_idx * (char_idx + 1)) AS BIGINT) AS mark FROM placed GROUP BY id")
def f1_word_index(s, d):
    """numbers of words on characters, summed up for each text."""
    rows = align.characters(_docs(s, d))
    return rows.groupBy("id").agg(F.max("word_idx").alias("last_word"), F.count("*").alias("n"), F.sum(F.col("word_idx") * (F.col("char_idx") + 1)).alias("mark"))


@query("a1_words", f"WITH {_CHARS} SELECT id, word_idx, string_agg(char, '' ORDER BY char_idx) AS word, min(start_ms) AS start_ms, max(end_ms) AS end_ms, floor(avg(score) * 1000 + 0.5) / 1000 AS score FROM timed WHERE char != ' ' GROUP BY id, word_idx")
def a1_words(s, d):
    rows = _docs(s, d).select("id", F.explode(align.word_runs(F.col("text"), *_characters())).alias("w"))
    return rows.select("id", "w.word_idx", "w.word", "w.start_ms", "w.end_ms", "w.score")


_SPANS_SQL = r"""
parts AS (SELECT id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS sentence, unnest(p) AS part
          FROM (SELECT id, string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(1), 'g'), chr(1)) AS p FROM docs)),
whole AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY id ORDER BY sentence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM parts),
spans AS (SELECT id, sentence // 2 AS sentence, CAST(b AS BIGINT) AS "from", CAST(b + length(part) AS BIGINT) AS "to" FROM whole WHERE sentence % 2 = 0 AND length(part) > 0)"""


@query("f23_sentence_spans", f'WITH {_CHARS}, {_SPANS_SQL} SELECT id, sentence, "from", "to" FROM spans')
def f23_sentence_spans(s, d):
    rows = align.sentence_spans(_docs(s, d))
    return rows.select("id", "sentence", F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"))


def _clamped(p: str) -> str:
    return f"least(greatest({p}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)"


def _likelihood(k: str, n: str, p: str) -> str:
    return f"({k} * ln({_clamped(p)}) + ({n} - {k}) * ln(1 - {_clamped(p)}))"


#: Texts of documents with the last words of some sentences made abbreviations, so that there is something to learn.
_BOUNDS = rf"""docs AS (SELECT doc_id AS id, lang, regexp_replace(text, ' (\p{{L}}+), (\p{{L}})', ' \1 ' || CASE lang WHEN 'de' THEN 'bzw.' WHEN 'fr' THEN 'p.ex.' ELSE 'etc.' END || ' \2', 'g') AS text FROM documents),
tok AS (SELECT lang, unnest(w) AS w, unnest(list_concat([NULL], w[1:len(w) - 1])) AS b FROM (SELECT lang, list_filter(string_split_regex(text, '\s+'), lambda v: v != '') AS w FROM docs)),
pl AS (SELECT lang, lower(regexp_replace(w, '[^\p{{L}}\p{{N}}.-]', '', 'g')) AS w, lower(regexp_replace(b, '[^\p{{L}}\p{{N}}.-]', '', 'g')) AS b FROM tok),
ty AS (SELECT lang, rtrim(w, '.') AS type, suffix(w, '.') AS period, rtrim(b, '.') AS before, coalesce(suffix(b, '.'), false) AS aft FROM pl WHERE rtrim(w, '.') != ''),
cn AS (SELECT lang, type, count(*) AS n, count(*) FILTER (period) AS k FROM ty GROUP BY ALL),
wh AS (SELECT lang, sum(n)::DOUBLE AS every, sum(k)::DOUBLE AS periods FROM cn GROUP BY lang),
sh AS (
  SELECT lang, type FROM (SELECT cn.lang, type, n, k, every, periods, length(type) - length(replace(type, '.', '')) AS inside FROM cn JOIN wh ON wh.lang = cn.lang WHERE k > 0 AND NOT regexp_full_match(type, '[0-9.-]+'))
  WHERE length(type) > inside AND -2 * ({_likelihood('k', 'n', 'periods / every')} - {_likelihood('k', 'n', '0.99::DOUBLE')}) * exp(-(length(type) - inside)) * (inside + 1) * pow((length(type) - inside)::DOUBLE, -(n - k)) >= 0.3
), en AS (SELECT ty.lang, ty.type, count(*) AS first FROM ty WHERE aft AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.lang = ty.lang AND sh.type = ty.before) GROUP BY ALL),
br AS (SELECT lang, sum(first)::DOUBLE AS b FROM en GROUP BY lang),
st AS (
  SELECT lang, type FROM (SELECT en.lang, en.type, first::DOUBLE AS first, n::DOUBLE AS n, b, every, (n - first) / greatest(every - b, 1) AS rest FROM en JOIN cn ON cn.lang = en.lang AND cn.type = en.type JOIN br ON br.lang = en.lang JOIN wh ON wh.lang = en.lang)
  WHERE first / b > rest AND 2 * ({_likelihood('first', 'b', 'first / b')} + {_likelihood('(n - first)', '(every - b)', 'rest')} - {_likelihood('first', 'b', 'n / every')} - {_likelihood('(n - first)', '(every - b)', 'n / every')}) >= 30
), pr AS (SELECT id, lang, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS k, unnest(p) AS part FROM (SELECT id, lang, string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(1), 'g'), chr(1)) AS p FROM docs)),
nb AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, lead(part, 2) OVER (PARTITION BY id ORDER BY k) AS following FROM pr),
lw AS (SELECT *, lower(regexp_replace(regexp_extract(part, '(\S*)$', 1), '[^\p{{L}}\p{{N}}.-]', '', 'g')) AS last, regexp_extract(coalesce(following, ''), '^(\S*)', 1) AS nw FROM nb WHERE k % 2 = 0),
go AS (SELECT *, suffix(last, '.') AND (EXISTS (SELECT 1 FROM sh WHERE sh.lang = lw.lang AND sh.type = rtrim(lw.last, '.')) OR regexp_full_match(rtrim(last, '.'), '\p{{L}}'))
              AND NOT (regexp_matches(nw, '^[^\p{{L}}]*\p{{Lu}}') AND EXISTS (SELECT 1 FROM st WHERE st.lang = lw.lang AND st.type = rtrim(lower(regexp_replace(lw.nw, '[^\p{{L}}\p{{N}}.-]', '', 'g')), '.'))) AS goes_on FROM lw),
gr AS (SELECT *, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM go)"""


@query("f23_spans_by_language", f'WITH {_BOUNDS} SELECT id, CAST(sentence AS BIGINT) AS sentence, CAST(min(f) AS BIGINT) AS "from", CAST(max(f + length(part)) AS BIGINT) AS "to" FROM gr GROUP BY id, sentence HAVING max(f + length(part)) > min(f)')
def f23_spans_by_language(s, d):
    """sentence bounds with abbreviations and sentence starters learned from the corpus by language."""
    from ..operators import sentence_bounds

    short = F.when(F.col("lang") == "de", "bzw.").when(F.col("lang") == "fr", "p.ex.").otherwise("etc.")
    text = F.regexp_replace(F.col("text"), F.lit(r" (\p{L}+), (\p{L})"), F.concat(F.lit(" $1 "), short, F.lit(" $2")))
    docs = i.table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", text.alias("text"))
    return sentence_bounds.spans(docs, sentence_bounds.learn(docs))


@query("a2_sentences", f"""WITH {_CHARS}, {_SPANS_SQL} SELECT id, sentence, coalesce(string_agg(char, '' ORDER BY char_idx) FILTER (char_idx < "to"), '') AS text, min(start_ms) AS start_ms, max(end_ms) FILTER (char != ' ') AS end_ms FROM timed JOIN spans USING (id) WHERE char_idx >= "from" AND char_idx <= "to" GROUP BY id, sentence""")
def a2_sentences(s, d):
    """A2 with the reference's closed upper bound."""
    rows = _docs(s, d).select("id", F.explode(align.sentence_runs(F.col("text"), *_characters()[:2])).alias("s"))
    return rows.select("id", "s.sentence", "s.text", "s.start_ms", "s.end_ms")


@query("a3_merged_sentences", f"WITH {i.SEGMENTS}, r AS (SELECT recording_id AS id, seg_idx AS sentence, text, start_ms // 200000 AS start_ms, end_ms // 200000 AS end_ms FROM seg) SELECT id, start_ms, end_ms, string_agg(text, ' ' ORDER BY sentence) AS text, count(*) AS n, min(sentence) AS sentence FROM r WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL GROUP BY id, start_ms, end_ms")
def a3_merged_sentences(s, d):
    part = lambda c: F.floor(F.col(c) / 200_000).alias(c)
    return align.merge_sentences(i.segments(s, d).select(F.col("recording_id").alias("id"), F.col("seg_idx").alias("sentence"), "text", part("start_ms"), part("end_ms")))


@query("p12_clean_chars", r"""WITH d AS (SELECT conv_id * 100 + turn AS id, text FROM conversations), c AS (SELECT id, text, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS char_idx, unnest(x) AS char FROM (SELECT id, text, string_split(lower(text), '') AS x FROM d)) SELECT id, count(*) AS n, CAST(sum(char_idx) AS BIGINT) AS mark, md5(string_agg(CASE WHEN char = ' ' THEN '|' ELSE char END, '' ORDER BY char_idx)) AS chars FROM c WHERE char_idx >= length(text) - length(regexp_replace(text, '^\s+', '')) AND char_idx < length(regexp_replace(text, '\s+$', '')) GROUP BY id""")
def p12_clean_chars(s, d):
    c = i.table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_idx", "char"))), lambda x: x["char"]), "")
    return align.clean_characters(c).groupBy("id").agg(F.count("*").alias("n"), F.sum("char_idx").alias("mark"), F.md5(joined).alias("chars"))


@query("a4_flat_words", f"WITH {i.WORDS} SELECT recording_id, seg_idx, word_idx, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx, word_idx) - 1 AS BIGINT) AS global_idx, word, start_ms, end_ms FROM words")
def a4_flat_words(s, d):
    """Words out of their segments, numbered throughout."""
    nested = i.words(s, d).groupBy("recording_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms"))).alias("words"))
    return align.flat_words(nested)


@query("p2_turn_words", f"WITH {i.WORDS} SELECT recording_id, seg_idx, word_idx, trim(word) AS word, CASE WHEN end_ms IS NOT NULL THEN start_ms END AS start_ms, CASE WHEN start_ms IS NOT NULL THEN end_ms END AS end_ms FROM words WHERE trim(word) != '' UNION ALL SELECT recording_id, seg_idx, 0, trim(text), NULL, NULL FROM seg WHERE end_ms IS NULL AND trim(text) != ''")
def p2_turn_words(s, d):
    """Words with both times or none; a segment without words stands for one."""
    both = lambda c, o: F.when(F.col(o).isNotNull(), F.col(c)).alias(c)
    own = i.words(s, d).where(~texts.blank(F.col("word"))).select("recording_id", "seg_idx", "word_idx", texts.strip(F.col("word")).alias("word"), both("start_ms", "end_ms"), both("end_ms", "start_ms"))
    lone = i.segments(s, d).where("end_ms is null").where(~texts.blank(F.col("text")))
    none = F.lit(None).cast("long")
    return own.unionByName(lone.select("recording_id", "seg_idx", F.lit(0).cast("long").alias("word_idx"), texts.strip(F.col("text")).alias("word"), none.alias("start_ms"), none.alias("end_ms")))


_OVERLAY = (
    i.SEGMENTS
    + """,
entries AS (SELECT recording_id, start_ms, arg_max(CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'was ' || text ELSE text END, seg_idx) AS src0, max(seg_idx) AS k,
                   arg_max(CASE WHEN event_id % 5 = 0 THEN '' ELSE upper(text) END, seg_idx) AS tr FROM seg WHERE event_id % 3 != 0 GROUP BY recording_id, start_ms),
ov AS (SELECT e.recording_id, e.start_ms, CASE WHEN s.event_id % 4 = 0 THEN NULL ELSE src0 END AS src, tr FROM entries e JOIN seg s ON s.recording_id = e.recording_id AND s.seg_idx = e.k)"""
)


def _overlay(s, d):
    src = F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 7 == 0, F.concat(F.lit("was "), F.col("text"))).otherwise(F.col("text"))
    tr = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.upper("text"))
    rows = i.segments(s, d).where("event_id % 3 != 0").select("recording_id", "start_ms", F.struct(src.alias("src"), tr.alias("tr")).alias("e"), "seg_idx")
    return rows.groupBy("recording_id", "start_ms").agg(F.max_by("e", "seg_idx").alias("e")).select("recording_id", "start_ms", "e.src", "e.tr")


@query("j4_translated", f"WITH {_OVERLAY} SELECT s.recording_id, s.start_ms, seg_idx, speaker, CASE WHEN o.tr IS NOT NULL AND (o.src IS NULL OR o.src = s.text) THEN o.tr ELSE s.text END AS text, NOT (o.tr IS NOT NULL AND (o.src IS NULL OR o.src = s.text)) AS stale FROM seg s LEFT JOIN ov o ON o.recording_id = s.recording_id AND o.start_ms = s.start_ms")
def j4_translated(s, d):
    return overlay.translated(i.segments(s, d), _overlay(s, d)).select("recording_id", "start_ms", "seg_idx", "speaker", "text", "stale")


@query("j10_entries", f"WITH {i.SEGMENTS} SELECT recording_id, start_ms // 100000 AS start_ms, arg_max(text, seg_idx) AS src, arg_max(upper(text), seg_idx) AS tr FROM seg WHERE event_id % 2 = 0 GROUP BY ALL")
def j10_entries(s, d):
    """Equal starts collide, the last holds."""
    rows = i.segments(s, d).withColumn("start_ms", F.floor(F.col("start_ms") / 100_000))
    return overlay.entries(rows, i.segments(s, d).where("event_id % 2 = 0").select("recording_id", "seg_idx", F.upper("text").alias("tr")))


@query("t1_timestamps", f"WITH {i.SEGMENTS} SELECT recording_id, seg_idx, {_HOURS.format('start_ms', ',')} AS srt, CASE WHEN start_ms >= 3600000 THEN {_HOURS.format('start_ms', '.')} ELSE {_STAMP.format('start_ms', '.')} END AS vtt, {_CLOCK.format('end_ms')} AS clock FROM seg")
def t1_timestamps(s, d):
    """T1, T2, T3."""
    t = F.col("start_ms")
    return i.segments(s, d).select("recording_id", "seg_idx", times.timestamp(t, ",", True).alias("srt"), times.timestamp(t).alias("vtt"), times.clock(F.col("end_ms")).alias("clock"))


def _full(s, d):
    return i.segments(s, d).where("end_ms is not null")


_SAID = "CASE WHEN speaker IS NOT NULL THEN '[' || speaker || ']: ' || {0} ELSE {0} END"


@query("k3_txt", f"WITH {i.SEGMENTS} SELECT recording_id, seg_idx AS line, {_SAID.format('trim(text)')} AS text FROM seg WHERE end_ms IS NOT NULL")
def k3_txt(s, d):
    return writers.txt(_full(s, d))


@query("k4_srt", f"WITH {i.SEGMENTS} SELECT recording_id, seg_idx AS line, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) AS VARCHAR) || chr(10) || {_HOURS.format('start_ms', ',')} || ' --> ' || {_HOURS.format('end_ms', ',')} || chr(10) || {_SAID.format('trim(text)')} || chr(10) AS text FROM seg WHERE end_ms IS NOT NULL")
def k4_srt(s, d):
    """A cue for each segment."""
    return writers.WRITERS["srt"](_full(s, d))


@query("k5_vtt", f"WITH {i.SEGMENTS}, c AS (SELECT recording_id, seg_idx AS line, CASE WHEN start_ms >= 3600000 THEN {_HOURS.format('start_ms', '.')} ELSE {_STAMP.format('start_ms', '.')} END || ' --> ' || CASE WHEN end_ms >= 3600000 THEN {_HOURS.format('end_ms', '.')} ELSE {_STAMP.format('end_ms', '.')} END || chr(10) || {_SAID.format('trim(text)')} || chr(10) AS text FROM seg WHERE end_ms IS NOT NULL) SELECT * FROM c UNION ALL SELECT DISTINCT recording_id, -1, 'WEBVTT' || chr(10) FROM c")
def k5_vtt(s, d):
    return writers.WRITERS["vtt"](_full(s, d))


@query("k6_tsv", f"WITH {i.SEGMENTS} SELECT recording_id, seg_idx AS line, CAST(start_ms AS VARCHAR) || chr(9) || CAST(end_ms AS VARCHAR) || chr(9) || replace(trim(text), chr(9), ' ') AS text FROM seg WHERE end_ms IS NOT NULL UNION ALL SELECT DISTINCT recording_id, -1, 'start' || chr(9) || 'end' || chr(9) || 'text' FROM seg WHERE end_ms IS NOT NULL")
def k6_tsv(s, d):
    return writers.tsv(_full(s, d))


_SECONDS = "CAST({0} // 1000 AS VARCHAR) || '.' || CASE WHEN {0} % 1000 = 0 THEN '0' ELSE rtrim(lpad(CAST({0} % 1000 AS VARCHAR), 3, '0'), '0') END"


@query("k7_audacity", f"WITH {i.SEGMENTS} SELECT recording_id, seg_idx AS line, {_SECONDS.format('start_ms')} || chr(9) || {_SECONDS.format('end_ms')} || chr(9) || CASE WHEN speaker IS NOT NULL THEN '[[' || speaker || ']]' ELSE '' END || replace(trim(text), chr(9), ' ') AS text FROM seg WHERE end_ms IS NOT NULL")
def k7_audacity(s, d):
    """K7: seconds as numbers print."""
    return writers.aud(_full(s, d))


@query("k8_json", f"""WITH {i.SEGMENTS} SELECT recording_id, 0 AS line, '{{"segments":[' || string_agg('{{"start_ms":' || start_ms || ',"end_ms":' || end_ms || ',"text":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN speaker IS NULL THEN '' ELSE ',"speaker":' || CAST(to_json(speaker) AS VARCHAR) END || '}}', ',' ORDER BY seg_idx) || ']}}' AS text FROM seg WHERE end_ms IS NOT NULL GROUP BY recording_id""")
def k8_json(s, d):
    return writers.json(_full(s, d))


@query(
    "k9_markdown",
    f"""WITH {_TURNS}, parts AS (SELECT recording_id, turn, CASE WHEN text != '' THEN '**' || coalesce(CASE WHEN speaker = 'guest' THEN 'A guest' WHEN speaker = 'SPEAKER_01' THEN NULL END, {_LABEL.format('speaker')}) || '** [' || {_CLOCK.format('start_ms')} || ' – ' || {_CLOCK.format('end_ms')} || ']' || chr(10) || chr(10) || text END AS part FROM turns)
SELECT recording_id, '# Transcript' || chr(10) || chr(10) || coalesce(string_agg(part, chr(10) || chr(10) ORDER BY turn), '_No speech detected._') || chr(10) AS text FROM parts GROUP BY recording_id""",
)
def k9_markdown(s, d):
    """Markdown with users' names for speakers."""
    t = turn_rows(s, d)
    names = t.where("speaker in ('guest', 'SPEAKER_01')").select("recording_id", "speaker", F.when(F.col("speaker") == "guest", "A guest").otherwise("").alias("name")).distinct()
    return writers.markdown(t, names)


_SECONDS = "CAST({0} // 1000 AS VARCHAR) || '.' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


@query("k13_rttm", f"WITH {i.SPANS} SELECT recording_id, ord AS line, 'SPEAKER ' || recording_id || ' 1 ' || {_SECONDS.format('s_start')} || ' ' || {_SECONDS.format('(s_end - s_start)')} || ' <NA> <NA> ' || speaker || ' <NA> <NA>' AS text FROM spans")
def k13_rttm(s, d):
    return writers.rttm(i.spans(s, d))


@query("s13_rttm_read", f"WITH {i.SPANS} SELECT CAST(recording_id AS VARCHAR) AS recording_id, ord, s_start, s_end, speaker FROM spans")
def s13_rttm_read(s, d):
    from ..sources.files import parse_rttm

    return parse_rttm(writers.rttm(i.spans(s, d)).select(F.col("text").alias("value"), F.col("line").alias("ord")))


@query("f15_default_cues", f"WITH {i.WORDS} SELECT recording_id, seg_idx, CASE WHEN count(start_ms) > 0 AND count(end_ms) > 0 THEN min(start_ms) ELSE first(seg_start) END AS start_ms, CASE WHEN count(start_ms) > 0 AND count(end_ms) > 0 THEN max(end_ms) ELSE first(seg_end) END AS end_ms, CASE WHEN first(speaker) IS NOT NULL THEN '[' || first(speaker) || ']: ' ELSE '' END || string_agg(word, ' ' ORDER BY word_idx) AS text FROM words GROUP BY recording_id, seg_idx")
def f15_default_cues(s, d):
    """F15, F16 without bounds."""
    return subtitles.default_cues(i.words(s, d))


@query(
    "f15_layout",
    f"""WITH RECURSIVE {i.WORDS},
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx, word_idx) AS i FROM words),
f AS (
  SELECT recording_id, i, word, CAST(length(word) AS BIGINT) AS line, CAST(1 AS BIGINT) AS lines, CAST(0 AS BIGINT) AS cue, coalesce(start_ms, seg_start) AS last_, true AS head FROM o WHERE i = 1
  UNION ALL
  SELECT recording_id, i, word, CASE WHEN stays THEN line + length(word) ELSE length(word) END, CASE WHEN stays THEN lines WHEN fresh THEN 1 ELSE lines + 1 END, CASE WHEN NOT stays AND fresh THEN cue + 1 ELSE cue END, coalesce(start_ms, last_), NOT stays
  FROM (SELECT o.recording_id, o.i, o.word, o.start_ms, f.line, f.lines, f.cue, f.last_, f.line + length(o.word) <= 42 AND NOT coalesce(o.start_ms - f.last_ > 3000, false) AS stays, coalesce(o.start_ms - f.last_ > 3000, false) OR f.lines >= 2 AS fresh
        FROM f JOIN o ON o.recording_id = f.recording_id AND o.i = f.i + 1)
), j AS (SELECT f.*, o.start_ms, o.end_ms, o.speaker, o.seg_start, o.seg_end, row_number() OVER (PARTITION BY f.recording_id, f.cue ORDER BY f.i) AS n FROM f JOIN o USING (recording_id, i))
SELECT recording_id, cue, CASE WHEN count(start_ms) > 0 AND count(end_ms) > 0 THEN min(start_ms) ELSE arg_min(seg_start, i) END AS start_ms, CASE WHEN count(start_ms) > 0 AND count(end_ms) > 0 THEN max(end_ms) ELSE arg_min(seg_end, i) END AS end_ms,
       coalesce('[' || max(speaker) FILTER (n = 1) || ']: ', '') || string_agg(CASE WHEN n = 1 THEN '' WHEN head THEN ' ' || chr(10) ELSE ' ' END || word, '' ORDER BY i) AS text
FROM j GROUP BY recording_id, cue""",
)
def f15_layout(s, d):
    return subtitles.layout(i.words(s, d), subtitles.Layout(42, 2))


@query(
    "f17_karaoke",
    f"""WITH {i.WORDS},
a AS (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS place, min(start_ms) OVER s AS first_, coalesce(CASE WHEN speaker IS NOT NULL THEN '[' || speaker || ']: ' END, '') AS pre, list(word) OVER (PARTITION BY recording_id, seg_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ws
      FROM words WINDOW w AS (PARTITION BY recording_id, seg_idx ORDER BY word_idx), s AS (PARTITION BY recording_id, seg_idx)),
t AS (SELECT *, coalesce(lag(end_ms) OVER (PARTITION BY recording_id, seg_idx ORDER BY word_idx), first_) AS last_ FROM a WHERE start_ms IS NOT NULL)
SELECT recording_id, seg_idx, place, CAST(1 AS INTEGER) AS part, start_ms, end_ms, pre || array_to_string(list_transform(ws, lambda w, i: CASE WHEN i = place + 1 THEN '<u>' || w || '</u>' ELSE w END), ' ') AS text FROM t
UNION ALL SELECT recording_id, seg_idx, place, CAST(0 AS INTEGER), last_, start_ms, pre || array_to_string(ws, ' ') FROM t WHERE last_ != start_ms""",
)
def f17_karaoke(s, d):
    return subtitles.karaoke(i.words(s, d))


def _conjunctions_sql() -> str:
    from ..operators.cue_rules import CONJUNCTIONS

    return ", ".join(f"('{lang}', [{', '.join(repr(w) for w in words.split())}])" for lang, words in CONJUNCTIONS.items())


#: Turns of conversations in five languages as segments; each second turn has words, of which each fifth has no time. Words are looked at one by one.
_SPLIT = f"""con(lang, words) AS (VALUES {_conjunctions_sql()}),
tu AS (SELECT conv_id, turn, text, turn * 30.0::DOUBLE AS s0, ['en', 'fr', 'de', 'es', 'zh'][conv_id % 5 + 1] AS lang, turn % 2 = 0 AS timed, lead(turn * 30.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn) AS following,
              list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda v: v != '') AS w FROM conversations),
sg AS (SELECT tu.*, len(w) AS n, CASE WHEN tu.lang = 'zh' THEN 30 ELSE 45 END AS longest, CASE WHEN tu.lang = 'zh' THEN 20 ELSE 30 END AS least, CASE WHEN tu.lang = 'zh' THEN '，' ELSE ',' END AS comma, CASE WHEN tu.lang = 'zh' THEN 0 ELSE 1 END AS sp,
              coalesce(con.words, []) AS conj FROM tu LEFT JOIN con ON con.lang = tu.lang WHERE len(w) > 0),
pt AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS held, CAST(list_sum(list_transform(w, lambda v: length(v) + CASE WHEN timed THEN 0 ELSE sp END)) AS BIGINT) AS ahead, CAST([] AS BIGINT[]) AS cuts FROM sg
  UNION ALL
  SELECT conv_id, turn, i + 1, CASE WHEN long AND held >= least THEN mid + 1 WHEN NOT long AND aft THEN i + 1 WHEN NOT long AND bef THEN i ELSE last END,
         CASE WHEN long AND held >= least THEN CAST(coalesce(list_sum(list_transform(w[mid + 2:i + 1], lambda v: length(v) + CASE WHEN timed THEN 0 ELSE sp END)), 0) AS BIGINT) WHEN NOT long AND aft THEN 0 WHEN NOT long AND bef THEN size ELSE held + size END,
         left_, CASE WHEN long AND held >= least THEN list_append(cuts, mid) WHEN NOT long AND aft THEN list_append(cuts, i) WHEN NOT long AND bef THEN list_append(cuts, i - 1) ELSE cuts END
  FROM (SELECT *, held + size >= longest AS long, held >= least AND left_ >= least AND suffix(x, comma) AS aft, held >= least AND left_ >= least AND list_contains(conj, lower(x)) AS bef, CAST(floor((last + i) / 2 + 0.5) AS BIGINT) AS mid
        FROM (SELECT pt.*, sg.* EXCLUDE (conv_id, turn), w[i + 1] AS x, length(w[i + 1]) + sp AS size, ahead - length(w[i + 1]) - sp AS left_ FROM pt JOIN sg USING (conv_id, turn) WHERE i < n))
), tm AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM sg WHERE timed
  UNION ALL
  SELECT conv_id, turn, i + 1, CASE WHEN i % 5 != 2 THEN s0 + i * 0.25::DOUBLE ELSE b END, CASE WHEN i % 5 != 2 THEN s0 + i * 0.25::DOUBLE + 0.2::DOUBLE WHEN i + 1 < n THEN s0 + (i + 1) * 0.25::DOUBLE WHEN coalesce(following, 0) = 0 THEN b + length(w[i + 1]) * 0.25::DOUBLE WHEN following - b <= 1 THEN following ELSE following - 0.5 END
  FROM tm JOIN sg USING (conv_id, turn) WHERE i < n
), ct AS (SELECT conv_id, turn, unnest(list_concat([-1], cuts)) AS lo, unnest(list_append(cuts, n - 1)) AS hi, generate_subscripts(list_append(cuts, n - 1), 1) - 1 AS part FROM pt JOIN sg USING (conv_id, turn) WHERE i = n
), pc AS (SELECT sg.*, lo + 1 AS lo, hi + 1 AS hi, part FROM ct JOIN sg USING (conv_id, turn) WHERE hi > lo
), tc AS (
  SELECT pc.*, CASE WHEN timed THEN f.a ELSE s0 + 29 * lo / n::DOUBLE END AS a, CASE WHEN timed THEN l.b ELSE s0 + 29 * hi / n::DOUBLE END AS b, CASE WHEN hi >= n THEN following WHEN timed THEN x.a END AS near
  FROM pc LEFT JOIN tm f ON f.conv_id = pc.conv_id AND f.turn = pc.turn AND f.i = lo + 1 LEFT JOIN tm l ON l.conv_id = pc.conv_id AND l.turn = pc.turn AND l.i = hi LEFT JOIN tm x ON x.conv_id = pc.conv_id AND x.turn = pc.turn AND x.i = hi + 1
), cue AS (
  SELECT conv_id AS recording_id, CAST(turn AS BIGINT) AS seg_idx, CAST(part AS BIGINT) AS part, a AS "start", CASE WHEN near != 0 AND near - b <= 0.8::DOUBLE THEN near ELSE b END AS "end", CASE WHEN sp = 0 THEN array_to_string(w[lo + 1:hi], '') ELSE array_to_string(w[lo + 1:hi], ' ') END AS text FROM tc
)"""


def _split_cues(s, d):
    from ..operators import cue_rules

    c = i.table(s, d, "conversations")
    start = F.col("turn") * 30.0
    lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es", "zh"))), (F.col("conv_id") % 5 + 1).cast("int"))
    parts = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: w != "")
    word = lambda w, k: F.struct(w.alias("word"), F.when(k % 5 != 2, start + k * 0.25).alias("start"), F.when(k % 5 != 2, start + k * 0.25 + 0.2).alias("end"))
    rows = c.select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("seg_idx"), lang.alias("lang"), start.alias("start"), (start + 29).alias("end"), "text", F.when(F.col("turn") % 2 == 0, F.transform(parts, word)).alias("words"))
    return subtitles.split_by_language(rows, cue_rules.rules(rows, cue_rules.conjunctions(s)))


@query("f20_split_cues", f'WITH RECURSIVE {_SPLIT} SELECT recording_id, seg_idx, part, round("start", 6) AS "start", round("end", 6) AS "end", text FROM cue')
def f20_split_cues(s, d):
    """Split cues of turns in five languages, each by its own rules."""
    return _split_cues(s, d).withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


_MILLIS = "CAST(round_even({0} * 1000, 0) AS BIGINT)"


@query("k15_numbered_files", f"""WITH RECURSIVE {_SPLIT}, num AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx, part) AS k, {_MILLIS.format('"start"')} AS ms0, {_MILLIS.format('"end"')} AS ms1 FROM cue)
SELECT recording_id, k AS line, CAST(k AS VARCHAR) || chr(10) || {_HOURS.format('ms0', '.')} || ' --> ' || {_HOURS.format('ms1', '.')} || chr(10) || trim(text) || chr(10) AS text FROM num UNION ALL SELECT DISTINCT conv_id, 0, 'WEBVTT' || chr(10) FROM conversations""")
def k15_numbered_files(s, d):
    """Split cues as a numbered file for each recording."""
    c = i.table(s, d, "conversations").select(F.col("conv_id").alias("recording_id"))
    return writers.numbered(_split_cues(s, d), c, vtt=True)[0]


@query("f22_next_start", f"WITH {i.SEGMENTS} SELECT recording_id, seg_idx, lead(start_ms) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS next_ms, CASE WHEN lead(start_ms) OVER (PARTITION BY recording_id ORDER BY seg_idx) - end_ms <= 800 THEN lead(start_ms) OVER (PARTITION BY recording_id ORDER BY seg_idx) ELSE end_ms END AS shown_to FROM seg")
def f22_next_start(s, d):
    """a cue lasts to the next segment's start if that is near."""
    from pyspark.sql import Window as W

    following = F.lead("start_ms").over(W.partitionBy("recording_id").orderBy("seg_idx"))
    rows = i.segments(s, d).withColumn("next_ms", following)
    return rows.select("recording_id", "seg_idx", "next_ms", F.when(F.col("next_ms") - F.col("end_ms") <= 800, F.col("next_ms")).otherwise(F.col("end_ms")).alias("shown_to"))


@query("m8_edited_turns", f"WITH {_TURNS}, e AS (SELECT recording_id, seg_first AS lo, seg_last AS hi, CASE WHEN recording_id % 4 = 0 THEN ' ' ELSE 'said anew' END AS new_text FROM turns WHERE turn = 2), kept AS (SELECT s.recording_id, s.seg_idx, s.speaker, s.start_ms, s.end_ms, s.text FROM seg s LEFT JOIN e USING (recording_id) WHERE e.lo IS NULL OR s.seg_idx < e.lo OR s.seg_idx > e.hi), new AS (SELECT s.recording_id, min(s.seg_idx) AS seg_idx, first(s.speaker) AS speaker, arg_min_null(s.start_ms, s.seg_idx) AS start_ms, arg_max_null(s.end_ms, s.seg_idx) AS end_ms, first(e.new_text) AS text FROM seg s JOIN e ON e.recording_id = s.recording_id AND s.seg_idx BETWEEN e.lo AND e.hi GROUP BY s.recording_id HAVING trim(first(e.new_text)) != '') SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) - 1 AS BIGINT) AS seg_idx, speaker, start_ms, end_ms, text FROM (SELECT * FROM kept UNION ALL SELECT * FROM new)")
def m8_edited_turns(s, d):
    """A turn becomes one segment with new text, or goes."""
    t = turn_rows(s, d)
    wanted = t.where("turn = 2").select("recording_id", "turn", F.when(F.col("recording_id") % 4 == 0, " ").otherwise("said anew").alias("new_text"))
    return edits.splice(i.segments(s, d), edits.turn_ranges(t, wanted))


@query("m10_reassigned", f"WITH {_TURNS}, e AS (SELECT recording_id, seg_first AS lo, seg_last AS hi, 'SPEAKER_07' AS sp FROM turns WHERE turn = 1) SELECT s.recording_id, s.seg_idx, CASE WHEN e.lo IS NOT NULL AND s.seg_idx BETWEEN e.lo AND e.hi THEN e.sp ELSE s.speaker END AS speaker, coalesce(s.seg_idx BETWEEN e.lo AND e.hi, false) AS changed FROM seg s LEFT JOIN e USING (recording_id)")
def m10_reassigned(s, d):
    change = turn_rows(s, d).where("turn = 1").select("recording_id", F.col("seg_first").alias("lo"), F.col("seg_last").alias("hi"), F.lit("SPEAKER_07").alias("new_speaker"))
    return edits.reassign(i.segments(s, d), change).select("recording_id", "seg_idx", "speaker", "changed")


@query("o5_recent_edits", f"WITH {i.SEGMENTS} SELECT recording_id, seg_idx AS seq FROM seg QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx DESC) <= 100")
def o5_recent_edits(s, d):
    """O5, M12."""
    return edits.recent(i.segments(s, d).select("recording_id", F.col("seg_idx").alias("seq")))


@query("m11_standing_edits", f"WITH {i.SEGMENTS}, l AS (SELECT recording_id, seg_idx AS seq, CASE WHEN event_id % 5 < 2 THEN 'undo' ELSE 'edit' END AS kind FROM seg), s AS (SELECT *, sum(CASE WHEN kind = 'undo' THEN -1 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY seq) AS x FROM l), z AS (SELECT *, x - least(0, min(x) OVER (PARTITION BY recording_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS d FROM s) SELECT recording_id, seq, kind FROM z a WHERE kind = 'edit' AND NOT EXISTS (SELECT 1 FROM z b WHERE b.recording_id = a.recording_id AND b.seq > a.seq AND b.d < a.d)")
def m11_standing_edits(s, d):
    """Edits that no undo took back."""
    log = i.segments(s, d).select("recording_id", F.col("seg_idx").alias("seq"), F.when(F.col("event_id") % 5 < 2, "undo").otherwise("edit").alias("kind"))
    return edits.standing(log)


@query("s9_current", f"WITH {i.SEGMENTS} SELECT recording_id, seg_idx, CASE WHEN recording_id % 3 = 0 THEN upper(text) ELSE text END AS text FROM seg WHERE recording_id % 3 != 0 OR seg_idx < 5")
def s9_current(s, d):
    """The overlay's segments where a recording has one."""
    own = i.segments(s, d).select("recording_id", "seg_idx", "text")
    return edits.current(own, own.where("recording_id % 3 = 0 and seg_idx < 5").withColumn("text", F.upper("text")))


@query("f24_round_robin", f"WITH {_TURNS} SELECT recording_id, turn, turn % 3 AS person, start_ms FROM turns")
def f24_round_robin(s, d):
    return turn_rows(s, d).select("recording_id", "turn", (F.col("turn") % 3).alias("person"), "start_ms")


@query("f25_concatenated", f"WITH {i.SPANS} SELECT recording_id, ord, coalesce(CAST(sum(s_end - s_start + 400) OVER (PARTITION BY recording_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS at_ms, s_end - s_start AS length_ms FROM spans")
def f25_concatenated(s, d):
    """clips one after the other with gaps of 0.4 seconds."""
    from pyspark.sql import Window as W

    before = F.sum(F.col("s_end") - F.col("s_start") + 400).over(W.partitionBy("recording_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    return i.spans(s, d).select("recording_id", "ord", F.coalesce(before, F.lit(0)).alias("at_ms"), (F.col("s_end") - F.col("s_start")).alias("length_ms"))


@query("f14_frame_times", f"WITH {i.SEGMENTS} SELECT recording_id, seg_idx, CAST(floor(CAST(seg_idx * (end_ms - start_ms) AS DOUBLE) / 200 + 0.5) AS BIGINT) AS at_ms FROM seg")
def f14_frame_times(s, d):
    return i.segments(s, d).select("recording_id", "seg_idx", align.frame_ms(F.col("seg_idx"), F.col("end_ms") - F.col("start_ms"), F.lit(200)).alias("at_ms"))


def _record_parts(s, d):
    """Segments, overlay entries by language, names, and edits of recordings whose ids are sessions' ids."""
    seg = i.segments(s, d).withColumn("recording_id", F.col("recording_id").cast("string"))
    n = F.col("event_id")
    each = seg.where(n % 11 != 0).withColumn("lang", F.explode(F.when(n % 4 == 0, F.array(F.lit("de"))).otherwise(F.array(F.lit("de"), F.lit("fr")))))
    src = F.when(n % 7 == 0, F.lit(None)).when(n % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    entries = each.groupBy("recording_id", "lang", "start_ms").agg(F.max_by(F.struct(src.alias("src"), F.concat(F.col("lang"), F.lit(" "), F.upper("text")).alias("tr")), "seg_idx").alias("e")).select("recording_id", "lang", "start_ms", "e.src", "e.tr")
    names = seg.where((F.col("recording_id").cast("long") + F.length("speaker")) % 3 == 0).select("recording_id", "speaker", F.concat(F.lit("N "), F.col("speaker")).alias("name")).distinct()
    return seg, entries, names, seg.where(n % 50 == 0).select("recording_id")


_RECORDS = (
    _TURNS
    + """,
ent AS (SELECT CAST(recording_id AS VARCHAR) AS id, lang, start_ms, arg_max_null(CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN text || '!' ELSE text END, seg_idx) AS src, arg_max(lang || ' ' || upper(text), seg_idx) AS tr
        FROM seg, (VALUES ('de'), ('fr')) AS l(lang) WHERE event_id % 11 != 0 AND (lang = 'de' OR event_id % 4 != 0) GROUP BY ALL),
nam AS (SELECT DISTINCT CAST(recording_id AS VARCHAR) AS id, speaker, 'N ' || speaker AS name FROM seg WHERE (recording_id + length(speaker)) % 3 = 0),
lng AS (SELECT DISTINCT id, lang FROM ent),
tra AS (SELECT s.recording_id, s.seg_idx, lng.lang, e.lang IS NOT NULL AND (e.src IS NULL OR e.src = s.text) AS fresh, e.tr, s.text FROM seg s JOIN lng ON lng.id = CAST(s.recording_id AS VARCHAR)
        LEFT JOIN ent e ON e.id = lng.id AND e.lang = lng.lang AND e.start_ms = s.start_ms),
shw AS (SELECT recording_id, seg_idx, string_agg(lang || ':' || CASE WHEN fresh THEN tr ELSE text END || ':' || CAST(NOT fresh AS VARCHAR), ';' ORDER BY lang) AS t FROM tra GROUP BY ALL),
cnt AS (SELECT CAST(recording_id AS VARCHAR) AS id, lang, count(*) AS n, count(*) FILTER (NOT fresh) AS stale FROM tra GROUP BY ALL)"""
)
_NAMED = "coalesce(nam.name, " + _LABEL + ")"


@query(
    "j12_details",
    f"""WITH {i.SESSIONS}, {_RECORDS},
sg AS (SELECT CAST(s.recording_id AS VARCHAR) AS id, string_agg(s.seg_idx || '|' || s.start_ms || '|' || coalesce(CAST(s.end_ms AS VARCHAR), '') || '|' || {_NAMED.format('s.speaker')} || '|' || s.text || '|' || coalesce(shw.t, ''), chr(10) ORDER BY s.seg_idx) AS segments
       FROM seg s LEFT JOIN nam ON nam.id = CAST(s.recording_id AS VARCHAR) AND nam.speaker = s.speaker LEFT JOIN shw ON shw.recording_id = s.recording_id AND shw.seg_idx = s.seg_idx GROUP BY 1),
tn AS (SELECT CAST(t.recording_id AS VARCHAR) AS id, string_agg(turn || '|' || {_NAMED.format('t.speaker')} || '|' || start_ms || '|' || coalesce(CAST(end_ms AS VARCHAR), '') || '|' || text, chr(10) ORDER BY turn) AS turns
       FROM turns t LEFT JOIN nam ON nam.id = CAST(t.recording_id AS VARCHAR) AND nam.speaker = t.speaker GROUP BY 1)
SELECT s.id, s.status, coalesce((SELECT string_agg(speaker || '=' || name, ',' ORDER BY speaker) FROM nam WHERE nam.id = s.id), '') AS names, coalesce(sg.segments, '') AS segments, coalesce(tn.turns, '') AS turns,
       coalesce((SELECT string_agg(lang || ':' || n || '/' || stale, ',' ORDER BY lang) FROM cnt WHERE cnt.id = s.id), '') AS translations, EXISTS (SELECT 1 FROM seg WHERE event_id % 50 = 0 AND CAST(recording_id AS VARCHAR) = s.id) AS can_undo
FROM sessions s LEFT JOIN sg ON sg.id = s.id LEFT JOIN tn ON tn.id = s.id""",
)
def j12_details(s, d):
    """A session's whole record, whatever is missing, printed part by part."""
    from ..operators.details import details

    x = details(i.sessions(s, d), *_record_parts(s, d))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = lambda c, f, mark="\n": F.array_join(F.transform(c, f), mark)
    one = lambda t: F.concat_ws(":", t["lang"], t["text"], t["stale"].cast("string"))
    return x.select(
        "id", "status", rows(F.array_sort(F.map_entries("names")), lambda e: F.concat_ws("=", e["key"], e["value"]), ",").alias("names"),
        rows("segments", lambda g: F.concat_ws("|", g["seg_idx"], text(g["start_ms"]), text(g["end_ms"]), g["label"], g["text"], rows(g["translations"], one, ";"))).alias("segments"),
        rows("turns", lambda t: F.concat_ws("|", t["turn"], t["label"], text(t["start_ms"]), text(t["end_ms"]), t["text"])).alias("turns"),
        rows("translations", lambda t: F.concat(t["lang"], F.lit(":"), t["n"], F.lit("/"), t["stale"]), ",").alias("translations"), "can_undo",
    )


@query(
    "k16_translated_srt",
    f"""WITH {_RECORDS}, own AS (SELECT s.recording_id, s.seg_idx, s.start_ms, s.end_ms, s.speaker, CASE WHEN t.fresh THEN t.tr ELSE s.text END AS shown FROM seg s JOIN tra t ON t.recording_id = s.recording_id AND t.seg_idx = s.seg_idx AND t.lang = 'fr' WHERE s.end_ms IS NOT NULL)
SELECT CAST(recording_id AS VARCHAR) AS recording_id, seg_idx AS line, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) AS VARCHAR) || chr(10) || {_HOURS.format('start_ms', ',')} || ' --> ' || {_HOURS.format('end_ms', ',')} || chr(10) || {_SAID.format('trim(shown)')} || chr(10) AS text FROM own""",
)
def k16_translated_srt(s, d):
    """Subtitles in French, from the segments as they stand and their overlay; recordings without one have none."""
    seg, entries, _, _ = _record_parts(s, d)
    return overlay.exported(seg.where("end_ms is not null"), entries, "fr", "srt")
