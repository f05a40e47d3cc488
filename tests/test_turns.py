"""Turns, coalescing and edits on small hand-made transcripts."""

import random

import pytest

from turnweave.functions import texts, times
from turnweave.operators import edits, turns
from turnweave.operators.interpolate import time_words
from pyspark.sql import functions as F

SCHEMA = "recording_id string, seg_idx long, start_ms long, end_ms long, text string, speaker string"


def seg(spark, rows):
    return spark.createDataFrame([("r", i, a, b, t, s) for i, (a, b, t, s) in enumerate(rows)], SCHEMA)


def tur(df):
    return [(r.turn, r.speaker, r.start_ms, r.end_ms, r.seg_first, r.seg_last, r.text) for r in turns.group_turns(df).orderBy("turn").collect()]


def test_turns_of_two_speakers(spark):
    df = seg(spark, [(0, 1000, " a ", "A"), (1000, 2000, "b", "A"), (2000, 3000, "c", "B"), (3000, 4000, "d", "A")])
    assert tur(df) == [(0, "A", 0, 2000, 0, 1, "a b"), (1, "B", 2000, 3000, 2, 2, "c"), (2, "A", 3000, 4000, 3, 3, "d")]


def test_no_speaker_and_empty_speaker_are_one(spark):
    assert len(tur(seg(spark, [(0, 1, "a", None), (1, 2, "b", ""), (2, 3, "c", None)]))) == 1


def test_a_turn_ends_with_its_last_segment(spark):
    assert tur(seg(spark, [(0, 9000, "a", "A"), (1000, 2000, "", "A"), (3000, None, "b", "B")])) == [(0, "A", 0, 2000, 0, 1, "a"), (1, "B", 3000, None, 2, 2, "b")]


def test_no_segments_no_turns(spark):
    assert tur(seg(spark, [(0, 1, "a", "A")]).limit(0)) == []


def model(rows, least=200):
    """The same rule as a loop."""
    out, i = [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and (rows[j][3] or "") == (rows[i][3] or ""):
            j += 1
        pieces, held, total = [], [], 0
        for r in rows[i:j]:
            held.append(r)
            total += (r[1] - r[0]) if r[0] is not None and r[1] is not None else 0
            if total >= least:
                pieces.append(held)
                held, total = [], 0
        if held:
            pieces[-1:] = [pieces[-1] + held] if pieces else [held]
        for p in pieces:
            starts, ends = [r[0] for r in p if r[0] is not None], [r[1] for r in p if r[1] is not None]
            out.append((starts[0] if starts else None, ends[-1] if ends else None, " ".join(r[2].strip() for r in p if r[2].strip()), p[0][3] or None))
        i = j
    return out


def test_coalescing_equals_a_loop_and_is_idempotent(spark):
    rng = random.Random(1)
    for _ in range(4):
        t, rows = 0, []
        for _ in range(30):
            d = rng.choice([10, 50, 90, 150, 250])
            rows.append((t if rng.random() > 0.1 else None, t + d, rng.choice([" x", "y ", ""]), rng.choice(["A", "B", None])))
            t += d
        once = turns.coalesce_segments(seg(spark, rows))
        got = [(r.start_ms, r.end_ms, r.text, r.speaker) for r in once.orderBy("seg_idx").collect()]
        assert got == model(rows)
        if all(r[0] is not None for r in rows):
            twice = turns.coalesce_segments(once)
            assert [(r.start_ms, r.end_ms) for r in twice.orderBy("seg_idx").collect()] == [(a, b) for a, b, _, _ in got]


def test_short_pieces_join_within_a_speaker_only(spark):
    df = seg(spark, [(0, 100, "a", "A"), (100, 200, "b", "A"), (200, 250, "c", "B"), (250, 300, "d", "A")])
    assert [(r.text, r.speaker) for r in turns.coalesce_segments(df).orderBy("seg_idx").collect()] == [("a b", "A"), ("c", "B"), ("d", "A")]


def test_next_key_ignores_gaps_and_other_names(spark):
    df = spark.createDataFrame([("a", "SPEAKER_04"), ("a", "Bob"), ("b", "Eve"), ("c", "SPEAKER_99"), ("d", "SPEAKER_01x")], "recording_id string, speaker string")
    assert {r.recording_id: r.speaker for r in turns.next_speaker_key(df).collect()} == {"a": "SPEAKER_05", "b": "SPEAKER_00", "c": "SPEAKER_100", "d": "SPEAKER_00"}


def test_labels_and_times(spark):
    df = spark.createDataFrame([("SPEAKER_00", 0), ("", 59_999), (None, 3_600_000), ("Bob", 3_725_250)], "s string, ms long")
    got = [tuple(r) for r in df.select(texts.speaker_label(F.col("s")), times.clock(F.col("ms")), times.timestamp(F.col("ms")), times.timestamp(F.col("ms"), ",", True), times.duration(F.col("ms"))).collect()]
    assert got == [
        ("Speaker 1", "0:00", "00:00.000", "00:00:00,000", "0m 00s"), ("Speaker", "0:59", "00:59.999", "00:00:59,999", "0m 59s"),
        ("Speaker", "1:00:00", "01:00:00.000", "01:00:00,000", "1h 00m"), ("Bob", "1:02:05", "01:02:05.250", "01:02:05,250", "1h 02m"),
    ]
    with pytest.raises(Exception, match="negative"):
        spark.sql("select -1L as ms").select(times.timestamp(F.col("ms"))).collect()


def test_times_round_half_to_even(spark):
    df = spark.createDataFrame([(0.0005,), (0.0015,), (1.2345,), (2.5,)], "s double")
    assert [r[0] for r in df.select(times.to_ms(F.col("s"))).collect()] == [round(x * 1000) for x in (0.0005, 0.0015, 1.2345, 2.5)]


def w(word, start=None, end=None):
    return {"word": word} if start is None else {"word": word, "start": start, "end": end}


def timed(spark, words, low, high):
    kind = "w array<struct<word:string,start:double,end:double>>, low double, high double"
    df = spark.createDataFrame([([(x["word"], x.get("start"), x.get("end")) for x in words], low, high)], kind)
    return df.select(time_words(F.col("w"), F.col("low"), F.col("high")).alias("x")).first().x


def lengths(words):
    return [round(x.end - x.start, 6) for x in words]


def test_new_words_share_a_gap(spark):
    out = timed(spark, [w("a", 0.0, 1.0), w("x"), w("y"), w("b", 2.0, 3.0)], 0.0, 3.0)
    assert [(x.start, x.end) for x in out] == [(0.0, 1.0), (1.0, 1.5), (1.5, 2.0), (2.0, 3.0)]


def test_new_words_borrow_from_both_sides(spark):
    assert lengths(timed(spark, [w("a", 0.0, 1.0), w("x"), w("b", 1.0, 2.0)], 0.0, 2.0)) == [0.95, 0.1, 0.95]
    assert lengths(timed(spark, [w("a", 0.0, 0.1), w("x"), w("b", 0.1, 2.0)], 0.0, 2.0)) == [0.1, 0.1, 1.8]
    # The word between lends to the left first and has less for the right.
    assert lengths(timed(spark, [w("x"), w("a", 0.0, 0.22), w("y"), w("b", 0.22, 0.32)], 0.0, 1.0)) == [0.1, 0.1, 0.02, 0.1]


def test_words_without_anchors_stay_untimed(spark):
    assert timed(spark, [w("x"), w("b", 2.0, 3.0)], None, None)[0].start is None
    assert timed(spark, [w("a", 0.0, 3.0), w("x"), w("b", 2.0, 4.0)], 0.0, 4.0)[1].start is None
    assert timed(spark, [], 0.0, 1.0) == []


def test_realigning_keeps_the_times_of_words_that_stay(spark):
    old = [("one", 0.0, 1.0), ("two", 1.0, 2.0), ("three", 2.0, 3.0)]
    kind = "recording_id string, turn long, words array<struct<word:string,start:double,end:double>>, text string, start double, end double"
    texts = ["one 2 three", "all new here", "one three", "one two three four", "", None]
    got = {r.turn: [tuple(x) for x in r.words] for r in edits.realign(spark.createDataFrame([("r", k, old, t, 0.0, 4.0) for k, t in enumerate(texts)], kind)).collect()}
    assert got == {0: [("one", 0.0, 1.0), ("2", 1.0, 2.0), ("three", 2.0, 3.0)], 1: [], 2: [("one", 0.0, 1.0), ("three", 2.0, 3.0)], 3: [*old, ("four", 3.0, 4.0)], 4: [], 5: []}


def test_realigning_in_a_frame(spark):
    kind = "recording_id string, turn long, words array<struct<word:string,start:double,end:double>>, text string, start double, end double"
    df = spark.createDataFrame([("r", 0, [("one", 0.0, 1.0), ("two", None, None)], "one more", 0.0, 2.0), ("r", 1, None, "x", None, None)], kind)
    got = {r.turn: [tuple(x) for x in r.words] for r in edits.realign(df).collect()}
    assert got == {0: [("one", 0.0, 1.0), ("more", 1.0, 2.0)], 1: []}


def test_an_edit_of_a_turn_that_is_not_there_raises(spark):
    t = turns.group_turns(seg(spark, [(0, 1, "a", "A")]))
    wanted = spark.createDataFrame([("r", 5, "x")], "recording_id string, turn long, new_text string")
    with pytest.raises(Exception, match="no such turn"):
        edits.turn_ranges(t, wanted).collect()


def test_splice_and_undo(spark):
    before = seg(spark, [(0, 1, "a", "A"), (1, 2, "b", "A"), (2, 3, "c", "B")])
    for text, n in (("new", 1), (" ", 0)):
        change = spark.createDataFrame([("r", 0, 1, text)], "recording_id string, lo long, hi long, new_text string")
        after = edits.splice(before, change)
        assert [r.text for r in after.orderBy("seg_idx").collect()] == (["new", "c"] if n else ["c"])
        old = before.where("seg_idx <= 1").groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "speaker", "start_ms", "end_ms", "text"))).alias("old_segments"))
        log = old.select("recording_id", F.lit(1).alias("seq"), F.lit(0).cast("long").alias("lo"), F.lit(n).alias("new_len"), "old_segments")
        back = edits.undo_last(after, log).orderBy("seg_idx").select("seg_idx", "text", "speaker").collect()
        assert [tuple(r) for r in back] == [(0, "a", "A"), (1, "b", "A"), (2, "c", "B")]


def test_reassigning_words_too(spark):
    df = seg(spark, [(0, 1, "a", "A"), (1, 2, "b", "B")]).withColumn("words", F.array(F.struct(F.col("text").alias("word"), F.col("speaker").alias("speaker"))))
    change = spark.createDataFrame([("r", 0, 0, "B")], "recording_id string, lo long, hi long, new_speaker string")
    got = [(r.speaker, r.words[0].speaker, r.changed) for r in edits.reassign(df, change).orderBy("seg_idx").collect()]
    assert got == [("B", "B", True), ("B", "B", False)]


def test_standing_edits_equal_a_stack(spark):
    rng = random.Random(4)
    kinds = [rng.choice(["edit", "edit", "undo"]) for _ in range(60)]
    stack = []
    for i, k in enumerate(kinds):
        if k == "edit":
            stack.append(i)
        elif stack:
            stack.pop()
    df = spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)], "recording_id string, seq long, kind string")
    assert [r.seq for r in edits.standing(df).orderBy("seq").collect()] == stack
