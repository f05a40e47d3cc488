"""Scans over bins, and what rests on them, against plain windows and loops."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnweave.operators import folds, intervals
from turnweave.operators.scans import Run, scan


@pytest.mark.parametrize("width", [1, 7])
def test_scans_equal_windows(spark, width):
    rng = random.Random(1)
    rows = [(rng.choice(("a", "b", None)), None if rng.random() < 0.05 else rng.randint(-50, 200), k, rng.choice((None, rng.randint(0, 9)))) for k in range(300)]
    df = spark.createDataFrame([*rows, ("far", 10**9, 1000, 3), ("far", 0, 1001, None), ("far", 2 * 10**9, 1002, None)], "k string, at long, tie long, v long").repartition(5)
    runs = {f"{kind}_{own}": Run(kind, F.col("v"), own) for kind in ("last", "next", "sum", "max") for own in (True, False)}
    found = scan(df, ["k"], ["at", "tie"], width, **runs)
    order = W.partitionBy("k").orderBy(F.col("at").asc_nulls_first(), "tie")
    want = {}
    for name, run in runs.items():
        skip = 0 if run.own else 1
        frame = order.rowsBetween(skip, W.unboundedFollowing) if run.kind == "next" else order.rowsBetween(W.unboundedPreceding, -skip)
        want[name] = {"last": F.last("v", ignorenulls=True), "next": F.first("v", ignorenulls=True), "sum": F.sum("v"), "max": F.max("v")}[run.kind].over(frame)
    plain = df.withColumns(want)
    assert found.columns == plain.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert scan(df.limit(0), ["k"], ["at", "tie"], width, **runs).count() == 0


def test_a_hot_recording_is_spread_over_tasks(spark):
    rows = spark.range(40_000).selectExpr("'hot' AS k", "id AS at", "id % 10 AS v")
    found = scan(rows, ["k"], ["at"], 500, s=Run("sum", F.col("v")))
    per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) < 20_000 and found.agg(F.max("s")).first()[0] == 180_000


@pytest.mark.parametrize("bin_ms", [90, 60_000])
def test_nearest_and_as_of_equal_brute_force(spark, bin_ms):
    rng = random.Random(2)
    spans = [(rng.choice("ab"), k, f"S{k % 4}", s := rng.randint(0, 3000), s + rng.choice((0, 10, 500))) for k in range(80)] + [("a", 99, "never", None, 3)]
    probes = [(rng.choice("abc"), k, s := rng.randint(-500, 5000), s + rng.choice((0, 40, 900))) for k in range(80)]
    df = intervals.nearest_span(spark.createDataFrame(probes, "recording_id string, probe_id long, p_start long, p_end long"), spark.createDataFrame(spans, "recording_id string, ord long, speaker string, s_start long, s_end long"), bin_ms)
    want = {}
    for rec, k, a, b in probes:
        near = sorted((abs(s + e - a - b), s, o, sp) for r, o, sp, s, e in spans if r == rec and s is not None)
        if near:
            want[k] = (near[0][3], near[0][0])
    assert {r.probe_id: (r.speaker, r.gap2_ms) for r in df.collect()} == want
    words = [(rng.choice("ab"), s := rng.randint(0, 3000), k, f"w{k}") for k in range(60)] + [("a", None, 99, "untimed")]
    asks = [(rng.choice("abc"), k, rng.randint(-10, 4000)) for k in range(60)]
    found = intervals.as_of(spark.createDataFrame(asks, "recording_id string, ask_id long, at_ms long"), spark.createDataFrame(words, "recording_id string, start_ms long, word_idx long, word string"), bin_ms)
    last = lambda rec, at: max(((s, k, w) for r, s, k, w in words if r == rec and s is not None and s <= at), default=(None, None, None))
    assert {r.ask_id: (r.word_idx, r.word) for r in found.collect()} == {k: last(rec, at)[1:] for rec, k, at in asks}
    islands = intervals.support(spark.createDataFrame([s for s in spans if s[3] is not None], "recording_id string, ord long, speaker string, s_start long, s_end long"), 30, bin_ms)
    merged = {}
    for rec, *_, s, e in sorted((s for s in spans if s[3] is not None), key=lambda s: (s[0], s[3], s[4])):
        own = merged.setdefault(rec, [])
        if own and s - own[-1][1] <= 30:
            own[-1] = [own[-1][0], max(own[-1][1], e), own[-1][2] + 1]
        else:
            own.append([s, e, 1])
    assert sorted((r.recording_id, r.s_start, r.s_end, r.n) for r in islands.collect()) == sorted((rec, *x) for rec, own in merged.items() for x in own)


def loop(frames, onset, offset, longest):
    """Regions of one recording, frame by frame: (t, score) in order."""
    out, on, start = [], frames[0][1] > onset, frames[0][0]
    held = [frames[0]]
    for at, score in frames[1:]:
        if not on:
            if score > onset:
                on, start = True, at
            continue
        if longest is not None and at - start > longest:
            half = len(held) // 2
            cut = min(range(half, len(held)), key=lambda k: (held[k][1], held[k][0])) if len(held) > half else 0
            out.append((start, held[cut][0]))
            start, held = held[cut][0], held[cut + 1 :]
            held.append((at, score))
        elif score < offset:
            out.append((start, at))
            on, held = False, [(at, score)]
        else:
            held.append((at, score))
    return out + [(start, frames[-1][0])] * on


@pytest.mark.parametrize(("width", "longest"), [(1, 900), (13, None), (13, 2500), (4096, 900)])
def test_regions_with_cuts_equal_a_loop_at_any_width(spark, width, longest):
    rng = random.Random(width + (longest or 0))
    data, rows = {}, []
    for rec, step in (("even", (20, 20)), ("nearly", (20, 30)), ("uneven", (5, 300)), ("other", (20, 20))):
        at, level, frames = 0, 0.0, []
        for k in range(900):
            if rng.random() < 0.04:
                level = rng.choice((0.05, 0.2, 0.45, 0.8, 0.95))
            frames.append((at, min(1.0, max(0.0, round(level + rng.uniform(-0.15, 0.15), 3)))))
            rows.append((rec, k, at, frames[-1][1]))
            at += rng.randint(*step)
        data[rec] = frames
    df = spark.createDataFrame(rows, "recording_id string, frame long, t_ms long, score double")
    found = [tuple(r) for r in folds.binarize(df, max_ms=longest, width=width).select("recording_id", "region", "start_ms", "end_ms").collect()]
    want = [(rec, k, *span) for rec, frames in data.items() for k, span in enumerate(sorted(loop(frames, 0.5, 0.363, longest)))]
    assert sorted(found) == sorted(want)
    if longest:
        pieces = folds._pieces(df, 0.5, 0.363, longest, width).groupBy("recording_id").agg(F.countDistinct("piece").alias("n"))
        n = {r.recording_id: r.n for r in pieces.collect()}
        assert n["even"] > 5 and n["nearly"] > 5 and n["uneven"] == 0


@pytest.mark.parametrize("width", [1, 5])
def test_pieces_of_turns_equal_a_loop_at_any_width(spark, width):
    from turnweave.operators import turns

    rng = random.Random(6)
    rows, want = [], []
    for rec in "abc":
        held, made, at = [], [], 0
        speaker, last = None, "none"
        for k in range(150):
            if rng.random() < (0.3 if rec != "c" else 0.02):
                speaker = rng.choice(("A", "B", "", None))
            n = rng.choice((None, 0, 40, 90, 150, 199, 200, 900))
            seg = (rec, k, at, None if n is None else at + n, speaker, rng.choice((f" t{k} ", "", None)))
            rows.append(seg)
            at += (n or 0) + 5
            if (speaker or None) != last:
                made += [held] if held else []
                held, last = [], speaker or None
            held.append(seg)
        for turn in [*made, held]:
            pieces, ms = [[]], 0
            for seg in turn:
                if ms >= 200:
                    pieces.append([])
                    ms = 0
                pieces[-1].append(seg)
                ms += seg[3] - seg[2] if seg[3] is not None else 0
            if ms < 200 and len(pieces) > 1:
                pieces[-2:] = [pieces[-2] + pieces[-1]]
            for p in pieces:
                want.append((rec, p[0][4] or None, p[0][2], next((s[3] for s in reversed(p) if s[3] is not None), None), " ".join(s[5].strip() for s in p if s[5] and s[5].strip()), p[0][1], p[-1][1]))
    df = spark.createDataFrame(rows, "recording_id string, seg_idx long, start_ms long, end_ms long, speaker string, text string")
    found = turns.coalesce_segments(df, width=width).orderBy("recording_id", "seg_idx").collect()
    assert [(r.recording_id, r.speaker, r.start_ms, r.end_ms, r.text, r.from_idx, r.to_idx) for r in found] == want
    assert [r.seg_idx for r in found] == [k for rec in "abc" for k in range(sum(w[0] == rec for w in want))]


@pytest.mark.parametrize("bounds", [(20, 2), (12, 1)])
def test_layouts_are_the_same_at_any_width_of_bins(spark, bounds):
    from turnweave.operators import subtitles

    rng = random.Random(7)
    rows = []
    for rec in "ab":
        at = 0
        for seg in range(40):
            begin = at
            for word in range(rng.randint(1, 8)):
                timed = rng.random() < 0.8
                rows.append((rec, seg, word, "w" * rng.randint(1, 9), at if timed else None, at + 100 if timed else None, "S", begin, begin + 3000))
                at += rng.choice((100, 400, 2900, 3300))
    df = spark.createDataFrame(rows, "recording_id string, seg_idx long, word_idx long, word string, start_ms long, end_ms long, speaker string, seg_start long, seg_end long")
    options = subtitles.Layout(*bounds)

    def cues(rec):
        """Word by word, over all of a recording."""
        own = [r for r in rows if r[0] == rec]
        out, line, lines, last = [], 0, 0, own[0][7]
        for k, (_, _, _, word, start, end, *_rest) in enumerate(own):
            pause = start is not None and start - last > 3000
            if line > 0 and line + len(word) <= bounds[0] and not pause:
                line += len(word)
                out[-1].append((word, start, end, " "))
            else:
                cue = k == 0 or pause or lines >= bounds[1]
                lines = 1 if cue else lines + (line > 0)
                line = len(word)
                if cue:
                    out.append([])
                out[-1].append((word, start, end, "" if cue else " \n"))
            last = start if start is not None else last
        return [("".join(mark + w for w, *_, mark in c), [s for _, s, _, _ in c if s is not None], [e for _, _, e, _ in c if e is not None]) for c in out]

    for width in (3, 1024):
        for rec in "ab":
            found = subtitles.layout(df.where(F.col("recording_id") == rec), options, width_of_bin=width).orderBy("cue").collect()
            want = cues(rec)
            assert [r.text for r in found] == ["[S]: " + t for t, _, _ in want]
            assert [(r.start_ms, r.end_ms) for r, w in zip(found, want, strict=True) if w[1]] == [(min(s), max(e)) for _, s, e in want if s]
