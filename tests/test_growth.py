"""Steps whose work, or whose largest task, once grew faster than their input."""

import difflib
import random

from pyspark.sql import functions as F

from turnweave.operators import align, edits, metrics, sentence_bounds, subtitles
from turnweave.streaming import channels


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentences_of_a_language_do_not_meet_in_one_task(spark):
    texts = spark.createDataFrame([(1, "en", "One etc. two. Three"), (2, None, "Four. Five")], "id int, lang string, text string")
    learned = spark.createDataFrame([("en", ["etc"], ["three"])], "lang string, abbreviations array<string>, starters array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sentence_bounds.spans(texts, learned)
        assert "SortMergeJoin" not in plan(found) and "BroadcastHashJoin" in plan(found)
        assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 0, 13), (1, 1, 14, 19), (2, 0, 0, 5), (2, 1, 6, 10)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sentence_bounds_read_texts_twice_and_shuffle_none(spark):
    """What is learned takes one pass for types and one for pairs, whoever reads it; parts of texts meet as numbers, and types are looked up by hash."""
    rows = [(k, "en", f"Word{k} etc. and so on. The next! A? {'x' * k}") for k in range(200)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    texts = spark.createDataFrame(rows, "id long, lang string, text string").mapInArrow(counted, "id long, lang string, text string")
    learned = sentence_bounds.learn(texts)
    found = sentence_bounds.spans(spark.createDataFrame(rows, "id long, lang string, text string"), learned)
    shown = plan(found)
    assert "lead(" not in shown and "array_contains" not in shown
    assert found.count() and read.value == 2 * len(rows)


def test_tokens_of_marks_and_periods_stay_places(spark):
    """A token that is all marks stands between its neighbours; one of periods ends a sentence."""
    rows = [(k, "en", " !!!  a \u2014 Bb etc. The\n... The x. ??? The") for k in range(40)]
    (r,) = sentence_bounds.learn(spark.createDataFrame(rows, "id long, lang string, text string")).collect()
    assert (r.abbreviations, r.starters) == (["etc", "x"], ["the"])


def test_far_texts_are_not_compared_in_a_growing_band(monkeypatch):
    rng = random.Random(3)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(200):
        a, b = text("ab", rng.randint(1, 40)), text("ab", rng.randint(1, 40))
        x, y = metrics._codes(a, b)
        assert metrics._least_distance(x, y) <= metrics.far_distance(a, b) == metrics.far_distance(b, a)
        assert metrics.edit_distance(a, b) == metrics.far_distance(a, b)
    monkeypatch.setattr(metrics, "_near_distance", lambda *given: 1 / 0)
    a, b = text("abcdefghijklmnop", 2000), text("abcdefghijklmnop", 3000)
    assert metrics.edit_distance(a, b) == metrics.far_distance(b, a)
    a, b = ([text("abcdefgh", 3) for _ in range(400)] for _ in range(2))
    assert metrics.edit_distance(a, b) == metrics.far_distance(a, b)


def test_karaoke_sorts_words_once(spark):
    kind = "recording_id string, seg_idx long, word_idx long, word string, start_ms long, end_ms long, speaker string, seg_start long, seg_end long"
    rows = [("r", 0, 0, "a", 0, 10, "S", 0, 50), ("r", 0, 1, None, None, None, "S", 0, 50), ("r", 0, 2, " b", 20, 30, "S", 0, 50), ("r", 1, 0, "c", None, None, None, 50, 60)]
    cues = subtitles.karaoke(spark.createDataFrame(rows, kind))
    assert plan(cues).count("Sort [") == 1
    assert sorted((r.place, r.part, r.start_ms, r.end_ms, r.text) for r in cues.collect()) == [(0, 1, 0, 10, "[S]: <u>a</u>  b"), (2, 0, 10, 20, "[S]: a  b"), (2, 1, 20, 30, "[S]: a  <u>b</u>")]


def test_kept_words_are_those_of_difflib():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        wanted = [-1] * len(b)
        for i, j, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
            wanted[j : j + n] = range(i, i + n)
        assert edits.kept_places(a, b) == wanted


def test_a_channel_hands_on_no_more_than_its_buffer_holds(spark):
    events = spark.createDataFrame([(k % 2, k) for k in range(20)], "id int, seq long")
    found = channels.buffered(events, "id", "seq", size=3)
    assert "WindowGroupLimit" in plan(found) and plan(found).count("Exchange hash") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]


def test_word_runs_of_odd_rows(spark):
    """Lists too short or null, characters of several bytes, blanks at the ends; by batches, not value by value."""
    rows = [
        (1, "  ab é 日本  x ", [1, 2, None, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13], [2, 3, 4, 5, 6], [0.5, None, None, None, 0.25]), (2, None, [1], [1], [1.0]), (3, "", [], [], []),
        (4, "a b", None, [5, 6, 7], None), (5, " ", [1], [1], [0.1]), (6, "one two", [None] * 7, [9] * 7, [0.1] * 7), (7, "😀 z", [3, 4, 5], [6, 7, 8], [0.1, 0.2, 0.3]),
    ]
    found = spark.createDataFrame(rows, "id int, text string, a array<bigint>, b array<bigint>, c array<double>").coalesce(1)
    found = found.select("id", align.word_runs(F.col("text"), F.col("a"), F.col("b"), F.col("c")).alias("w"))
    assert "ArrowEvalPython" in plan(found)
    assert {r.id: None if r.w is None else [tuple(w) for w in r.w] for r in found.collect()} == {
        1: [(1, "ab", 4, 5, None), (2, "é", 6, None, None), (3, "日本", 8, None, None), (5, "x", 12, None, None)], 2: None, 3: [], 4: [(0, "a", None, 5, None), (1, "b", None, 7, None)], 5: [],
        6: [(0, "one", None, 9, 0.1), (1, "two", None, 9, 0.1)], 7: [(0, "😀", 3, 6, 0.1), (1, "z", 5, 8, 0.3)],
    }
