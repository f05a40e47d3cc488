"""Properties that hold for any transcript."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnweave.operators import turns
from turnweave.operators.interpolate import time_words
from turnweave.operators.subtitles import Splitter

segment = st.tuples(st.integers(0, 300), st.sampled_from(["", " ", "a", " b c "]), st.sampled_from([None, "", "A", "B"]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(segment, min_size=1, max_size=25))
def test_turns_and_pieces_cover_all_segments_once(spark, rows):
    at, data = 0, []
    for k, (n, text, speaker) in enumerate(rows):
        data.append(("r", k, at, at + n, text, speaker))
        at += n
    df = spark.createDataFrame(data, "recording_id string, seg_idx long, start_ms long, end_ms long, text string, speaker string")
    t = turns.group_turns(df).orderBy("turn").collect()
    assert [(r.seg_first, r.seg_last) for r in t][0][0] == 0 and t[-1].seg_last == len(rows) - 1
    assert all(a.seg_last + 1 == b.seg_first and a.speaker != b.speaker for a, b in zip(t, t[1:]))
    p = turns.coalesce_segments(df).orderBy("seg_idx").collect()
    assert sorted(k for r in p for k in range(r.from_idx, r.to_idx + 1)) == list(range(len(rows)))
    long = {r.turn: sum(n for n, _, _ in rows[r.seg_first : r.seg_last + 1]) >= 200 for r in t}
    for r in p:
        turn = next(x for x in t if x.seg_first <= r.from_idx <= x.seg_last)
        assert r.to_idx <= turn.seg_last
        if long[turn.turn]:
            assert r.end_ms - r.start_ms >= 200


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(many=st.lists(st.lists(st.one_of(st.none(), st.floats(0.01, 2.0)), min_size=1, max_size=12), min_size=5, max_size=30))
def test_timed_words_are_in_order(spark, many):
    rows = []
    for k, lengths in enumerate(many):
        at, words = 0.0, []
        for n in lengths:
            words.append(("w", None, None) if n is None else ("w", at, at + n))
            at += n or 0.05
        rows.append((k, words, at))
    df = spark.createDataFrame(rows, "k long, w array<struct<word:string,start:double,end:double>>, high double")
    for r in df.select("k", time_words(F.col("w"), F.lit(0.0), F.col("high")).alias("x")).collect():
        timed = [w for w in r.x if w.start is not None]
        assert all(a.end <= b.start + 1e-6 for a, b in zip(timed, timed[1:])) or None in many[r.k]
        assert all(w.end >= w.start - 1e-6 for w in timed)
        assert [w.word for w in r.x] == ["w"] * len(many[r.k])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(many=st.lists(st.lists(st.text("abc,", min_size=1, max_size=12), min_size=1, max_size=60), min_size=5, max_size=30))
def test_split_points_rise_and_leave_no_word_out(spark, many):
    df = spark.createDataFrame([(k, w) for k, w in enumerate(many)], "k long, w array<string>")
    for r in df.select("k", Splitter("en", frozenset({"a"})).points(F.col("w"), F.lit(False)).alias("cuts")).collect():
        words = many[r.k]
        assert all(0 <= c < len(words) for c in r.cuts)
        parts = [words[a + 1 : b + 1] for a, b in zip([-1, *r.cuts], [*r.cuts, len(words) - 1])]
        if r.cuts == sorted(set(r.cuts)):
            assert [w for p in parts for w in p] == words
