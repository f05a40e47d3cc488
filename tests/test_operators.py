"""Folds, intervals, paths, writers, metrics, sources and streams against models."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave import plugins
from turnweave.operators import align, arrays, ctc, folds, interpolate, intervals, manifest, metrics, overlay, sessions, subtitles, writers
from turnweave.sources import files, objects
from turnweave.streaming import status


def test_binned_overlaps_equal_plain_ones(spark):
    rng = random.Random(1)
    span = lambda k: (rng.choice("ab"), k, (s := rng.randint(0, 400_000)), s + rng.choice([0, 10, 60_000, 200_000]))
    probes = spark.createDataFrame([span(k) for k in range(120)], "recording_id string, probe_id long, p_start long, p_end long")
    spans = spark.createDataFrame([(*span(k), f"S{k % 3}") for k in range(120)], "recording_id string, ord long, s_start long, s_end long, speaker string")
    for bin_ms in (1_000, 60_000):
        a, b = (sorted(map(tuple, x.select("recording_id", "probe_id", "ord", "overlap_ms").collect())) for x in (intervals.overlaps(probes, spans), intervals.binned_overlaps(probes, spans, bin_ms)))
        assert a == b and a


def test_dominant_speaker_ties_and_zero_lengths(spark):
    probes = spark.createDataFrame([("r", 0, 0, 100), ("r", 1, 50, 50), ("r", 2, 500, 600), ("q", 3, 0, 1)], "recording_id string, probe_id long, p_start long, p_end long")
    spans = spark.createDataFrame([("r", 0, "B", 0, 50), ("r", 1, "A", 50, 100), ("r", 2, "A", 900, 1000)], "recording_id string, ord long, speaker string, s_start long, s_end long")
    got = {r.probe_id: r.speaker for r in intervals.dominant_speaker(probes, spans).collect()}
    assert got == {0: "B", 1: None, 2: None, 3: None}
    near = {r.probe_id: r.speaker for r in intervals.dominant_speaker(probes, spans, nearest=True).collect()}
    assert near == {0: "B", 1: "B", 2: "A", 3: None}


def test_chunks_equal_a_loop(spark):
    rng = random.Random(2)
    rows, t = [], 0
    for k in range(60):
        n = rng.choice([0, 500, 4000, 12_000, 45_000])
        rows.append(("r", k, t, t + n))
        t += n + rng.choice([0, 300])
    want, begin, end, part = [], rows[0][2], 0, []
    for _, _, a, b in rows:
        if b - begin > 30_000 and end - begin > 0:
            want.append((begin, end, part))
            begin, part = a, []
        end = b
        part.append((a, b))
    want.append((begin, end, part))
    got = folds.merge_chunks(spark.createDataFrame(rows, "recording_id string, seg_idx long, start_ms long, end_ms long")).orderBy("chunk").collect()
    assert [(r.start_ms, r.end_ms, [tuple(s) for s in r.segments]) for r in got] == want


def test_batches(spark):
    df = spark.createDataFrame([("a", k, "x") for k in range(250)] + [("b", k, "y" * 20_000) for k in range(2)] + [("c", 0, "z" * 30_000), ("c", 1, "z")], "doc string, pos long, text string")
    sizes = {}
    for r in folds.batches(df).collect():
        sizes.setdefault((r.doc, r.batch), []).append(r.pos)
    assert [len(v) for _, v in sorted(sizes.items())] == [100, 100, 50, 1, 1, 1, 1]


def test_binarize_cuts_where_scores_are_least(spark):
    scores = [0.1, 0.9, 0.9, 0.9, 0.6, 0.9, 0.9, 0.9, 0.1, 0.1]
    df = spark.createDataFrame([("r", k, k * 100, s) for k, s in enumerate(scores)], "recording_id string, frame long, t_ms long, score double")
    plain = [(r.start_ms, r.end_ms) for r in folds.binarize(df).orderBy("region").collect()]
    assert plain == [(100, 800)] == [(r.start_ms, r.end_ms) for r in folds.regions(df).collect()]
    cut = [(r.start_ms, r.end_ms) for r in folds.binarize(df, max_ms=450).orderBy("region").collect()]
    assert cut == [(100, 400), (400, 800)]
    padded = [(r.start_ms, r.end_ms) for r in folds.binarize(df, max_ms=450, pad_onset_ms=50, pad_offset_ms=30).orderBy("region").collect()]
    assert padded == [(50, 830)]
    two = spark.createDataFrame([("r", k, k * 100, s) for k, s in enumerate([0.9, 0.1, 0.1, 0.9, 0.1])], "recording_id string, frame long, t_ms long, score double")
    spans = lambda **o: [(r.start_ms, r.end_ms) for r in folds.binarize(two, **o).orderBy("region").collect()]
    assert spans() == [(0, 100), (300, 400)] and spans(min_off_ms=201) == [(0, 400)] and spans(min_off_ms=200) == [(0, 100), (300, 400)] and spans(min_on_ms=101) == []


@pytest.mark.parametrize("method,want", [("nearest", [1, 1, 3, 3, 5]), ("linear", [1, 2, 3, 4, 5]), ("ignore", [1, None, 3, None, 5])])
def test_interpolation(spark, method, want):
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate([1.0, None, 3.0, None, 5.0])], "g string, k long, v double")
    assert [r.v for r in interpolate.fill_gaps(df, ["g"], "k", ["v"], method).orderBy("k").collect()] == want


def test_a_path_through_emissions(spark):
    rng = np.random.default_rng(3)
    emission = np.log(np.full((12, 4), 0.05))
    for t, k in enumerate([0, 1, 1, 0, 2, 0, 0, 3, 3, 0, 1, 0]):
        emission[t, k] = np.log(0.85)
    df = spark.createDataFrame([("a", emission.tolist(), [1, 2, 3, 1]), ("b", emission[:2].tolist(), [1, 2, 3, 1]), ("c", rng.normal(size=(9, 4)).tolist(), [-1, 2])], "id string, emission array<array<double>>, tokens array<int>")
    path = ctc.paths(df)
    runs = ctc.merge_repeats(path.where("id = 'a'")).orderBy("run").collect()
    assert [r.token for r in runs] == [0, 1, 2, 3] and all(x.to <= y["from"] + 1 for x, y in zip(runs, runs[1:]))
    assert path.where("id = 'b'").count() == 0
    steps = [r.frame for r in path.where("id = 'c'").orderBy("step").collect()]
    assert steps == sorted(steps)


def test_words_of_runs(spark):
    df = spark.createDataFrame([("a", 0, "h", 0, 2, 0.5), ("a", 1, "i", 2, 3, 0.8), ("a", 2, "|", 3, 4, 1.0), ("a", 3, "x", 4, 5, 0.1)], "id string, run long, label string, from long, to long, score double")
    got = [(r.text, r["from"], r["to"], round(r.score, 6)) for r in ctc.merge_words(df).orderBy("word").collect()]
    assert got == [("hi", 0, 3, 0.6), ("x", 4, 5, 0.1)]


def test_words_and_sentences_of_characters(spark):
    df = spark.createDataFrame([("d", "Hi you. Bye")], "id string, text string")
    chars = align.characters(df).withColumns({"start_ms": F.col("char_idx") * 10, "end_ms": F.col("char_idx") * 10 + 5, "score": F.lit(0.5)})
    assert [(r.word, r.start_ms, r.end_ms) for r in align.words(chars).orderBy("word_idx").collect()] == [("Hi", 0, 15), ("you.", 30, 65), ("Bye", 80, 105)]
    spans = align.sentence_spans(df)
    assert [(r["from"], r["to"]) for r in spans.orderBy("sentence").collect()] == [(0, 7), (8, 11)]
    assert [(r.text, r.start_ms, r.end_ms) for r in align.sentences(chars, spans).orderBy("sentence").collect()] == [("Hi you.", 0, 65), ("Bye", 80, 105)]
    clean = align.clean_characters(spark.createDataFrame([("d", " A b\n")], "id string, text string"))
    assert [(r.char_idx, r.char) for r in clean.orderBy("char_idx").collect()] == [(1, "a"), (2, "|"), (3, "b")]


def test_overlay_fresh_and_stale(spark):
    segs = spark.createDataFrame([("r", 0, 0, "a", "S"), ("r", 1, 10, "b", "S"), ("r", 2, 20, "c", "S"), ("r", 3, None, "d", None), ("r", 4, 30, "e", "S")], "recording_id string, seg_idx long, start_ms long, text string, speaker string")
    over = spark.createDataFrame([("r", 0, "a", "A"), ("r", 10, "old", "B"), ("r", 20, "c", ""), ("r", 30, None, "E")], "recording_id string, start_ms long, src string, tr string")
    assert [(r.text, r.stale) for r in overlay.translated(segs, over).orderBy("seg_idx").collect()] == [("A", False), ("b", True), ("", False), ("d", True), ("E", False)]
    twice = spark.createDataFrame([("r", 5, "x", 0), ("r", 5, "y", 1), ("r", None, "z", 2)], "recording_id string, start_ms long, text string, place long")
    assert [(r.start_ms, r.src, r.tr) for r in overlay.legacy_entries(twice).collect()] == [(5, None, "y")]


def test_writers_to_the_byte(spark, tmp_path):
    df = spark.createDataFrame([("r", 0, 0, 1500, " Hello --> you ", "SPEAKER_00"), ("r", 1, 3_600_000, 3_601_250, "Bye\tnow", None)], "recording_id string, seg_idx long, start_ms long, end_ms long, text string, speaker string")
    text = lambda form: "\n".join(r.text for r in writers.WRITERS[form](df).orderBy("line").collect())
    assert text("srt") == "1\n00:00:00,000 --> 00:00:01,500\n[SPEAKER_00]: Hello -> you\n\n2\n01:00:00,000 --> 01:00:01,250\nBye\tnow\n"
    assert text("vtt") == "WEBVTT\n\n00:00.000 --> 00:01.500\n[SPEAKER_00]: Hello -> you\n\n01:00:00.000 --> 01:00:01.250\nBye\tnow\n"
    assert text("txt") == "[SPEAKER_00]: Hello --> you\nBye\tnow"
    assert text("tsv") == "start\tend\ttext\n0\t1500\tHello --> you\n3600000\t3601250\tBye now"
    assert text("aud") == "0.0\t1.5\t[[SPEAKER_00]]Hello --> you\n3600.0\t3601.25\tBye now"
    assert json.loads(text("json"))["segments"][1]["text"] == "Bye\tnow"
    assert set(writers.writers("all")) == {"txt", "vtt", "srt", "tsv", "json"} and set(writers.writers("aud")) == {"aud"}
    with pytest.raises(ValueError):
        writers.writers("doc")
    writers.save(writers.txt(df), str(tmp_path / "out"))
    part = next((tmp_path / "out" / "recording_id=r").glob("part-*"))
    assert part.read_text() == "[SPEAKER_00]: Hello --> you\nBye\tnow\n"


def test_empty_transcripts_say_so(spark):
    t = spark.createDataFrame([("r", 0, "SPEAKER_00", 0, 1, " ")], "recording_id string, turn long, speaker string, start_ms long, end_ms long, text string")
    assert writers.markdown(t).first().text == "# Transcript\n\n_No speech detected._\n"


def _words(spark, rows):
    return spark.createDataFrame([("r", s, k, w, a, b, sp, s * 1000, s * 1000 + 900) for s, k, w, a, b, sp in rows], "recording_id string, seg_idx long, word_idx long, word string, start_ms long, end_ms long, speaker string, seg_start long, seg_end long")


def test_layout_breaks_lines_and_cues(spark):
    rows = [(0, 0, "aaaa", 0, 100, "A"), (0, 1, "bbbb", 100, 200, "A"), (0, 2, "cccc", 200, 300, "A"), (1, 0, "dddd", 1000, 1100, "B"), (1, 1, "eeee", 9000, 9100, "B")]
    df = _words(spark, rows)
    got = lambda o: [(r.start_ms, r.end_ms, r.text) for r in subtitles.layout(df, o).orderBy("cue").collect()]
    assert got(subtitles.Layout()) == [(0, 300, "[A]: aaaa bbbb cccc"), (1000, 9100, "[B]: dddd eeee")]
    assert got(subtitles.Layout(8, 2)) == [(0, 1100, "[A]: aaaa bbbb \ncccc dddd"), (9000, 9100, "[B]: eeee")]
    assert got(subtitles.Layout(8, None)) == [(0, 300, "[A]: aaaa bbbb \ncccc"), (1000, 9100, "[B]: dddd eeee")]
    plain = [(r.start_ms, r.end_ms, r.text) for r in subtitles.default_cues(df).orderBy("seg_idx").collect()]
    assert plain == got(subtitles.Layout())


def test_split_points_and_cues(spark):
    s = subtitles.Splitter("en", frozenset({"and"}))
    words = "one two three four five six, and then seven eight nine ten eleven twelve thirteen fourteen".split()
    cuts = spark.createDataFrame([(words,)], "w array<string>").select(s.points(F.col("w"), F.lit(False)).alias("c")).first().c
    assert cuts and all(0 <= c < len(words) for c in cuts)
    df = spark.createDataFrame([("r", 0, 0.0, 16.0, " ".join(words), None), ("r", 1, 16.5, 18.0, "a b", [("a", 16.5, 17.0), ("b", None, None)])], "recording_id string, seg_idx long, start double, end double, text string, words array<struct<word:string,start:double,end:double>>")
    cues = subtitles.split_cues(df, s).orderBy("seg_idx", "part").collect()
    first = [c for c in cues if c.seg_idx == 0]
    assert " ".join(c.text for c in first) == " ".join(words) and first[-1].end == 16.5
    assert [(c.start, c.end, c.text) for c in cues if c.seg_idx == 1] == [(16.5, 17.25, "a b")]


def test_word_error_rates_equal_a_table(spark):
    rng = random.Random(5)
    pairs = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for k in range(60)] + [(99, "Привет, мир!", "привет мир")]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    got = {r.id: r.wer for r in metrics.error_rates(spark.createDataFrame(pairs, "id long, reference string, hypothesis string")).collect()}
    assert got[99] == 0
    for k, a, b in pairs[:-1]:
        assert got[k] == pytest.approx(distance(a.split(), b.split()) / max(len(a.split()), 1), abs=1e-4)


def test_compare_and_push(spark):
    m = lambda rows: spark.createDataFrame(rows, "group string, path string, hash string, size long")
    local, remote = m([("s", "a", "1", 5), ("s", "b", "2", 5)]), m([("s", "old", "1", 5)])
    assert [r.path for r in manifest.changed(local, remote).collect()] == ["b"]
    assert manifest.changed(local, local).count() == 0
    plan = {r.hash: r.action for r in manifest.push_plan(local, spark.createDataFrame([("1",), ("9",)], "hash string"), remote).collect()}
    assert plan == {"2": "upload", "1": "skip", "9": "collect"}
    assert manifest.compare(manifest.root(local), manifest.root(local)).first().state == "in sync"


def test_settings_and_names(spark):
    s = spark.createDataFrame([("a", "1")], "key string, value string")
    assert sessions.setting(s, "a", "x").first().value == "1" and sessions.setting(s, "b", "x").first().value == "x"
    rows = spark.createDataFrame([("1", None, "{bad", '{"en": {"status": "done"}}')], "id string, x string, options string, translations string")
    r = sessions.decoded(rows).first()
    assert r.translations["en"]["status"] == "done" and (r.options is None or r.options.language is None)


def test_reading_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"language": "en", "segments": [{"start": 0.5, "end": 1.0, "text": " hi", "speaker": "", "words": [{"word": "hi", "start": 0.5}]}]}))
    r = files.transcripts(spark, str(tmp_path / "one.json")).first()
    assert (r.recording_id, r.seg_idx, r.start_ms, r.end_ms, r.speaker, r.words[0].start_ms, r.words[0].end_ms) == ("one", 0, 500, 1000, None, 500, None)
    (tmp_path / "x.rttm").write_text("SPEAKER clip 1 0.500 1.250 <NA> <NA> A <NA> <NA>\n\n")
    r = files.rttm(spark, str(tmp_path / "x.rttm")).first()
    assert (r.recording_id, r.s_start, r.s_end, r.speaker) == ("clip", 500, 1750, "A")
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "generation": 3, "entries": {"a": {"hash": "1", "size": 2, "mtime": 1.5}}}))
    assert tuple(files.manifests(spark, str(tmp_path / "m.json")).first()) == ("a", "1", 2, 1.5, 3)
    (tmp_path / "ov.json").write_text(json.dumps({"version": 2, "target_language": "de", "entries": {"1.500": {"src": "a", "tr": "b"}}}))
    assert tuple(files.overlays(spark, str(tmp_path / "ov.json")).first()) == ("ov", "de", 1500, "a", "b")
    (tmp_path / "app.env").write_text("A=1 # one\nB=\"x # y\"\n# no\n")
    assert {r.key: r.value for r in files.env(spark, str(tmp_path / "app.env")).collect()} == {"A": "1", "B": '"x # y"'}
    (tmp_path / "c.tsv").write_text("sentence\tduration_ms\n[x] \t500\nhello\t900\nlong\t99999\n")
    assert [r.sentence for r in files.usable_clips(files.corpus(spark, str(tmp_path / "c.tsv"), "sentence string, duration_ms long"), 100, 5000).collect()] == ["hello"]


def test_object_store(spark, tmp_path):
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/a").write_bytes(b"one")
    (tmp_path / "tree/sub/b").write_bytes(b"two")
    tree = files.tree(spark, str(tmp_path / "tree"))
    assert {r.path for r in tree.collect()} == {"a", "sub/b"}
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "tree")).select(F.sha2("content", 256).alias("hash"), "content")
    for _ in range(2):
        objects.put(content, str(tmp_path / "store"))
    (tmp_path / "store/half.tmp").write_bytes(b"")
    spark.dataSource.register(objects.Listing)
    listed = spark.read.format("objects").option("path", str(tmp_path / "store")).option("page", 1).load()
    assert {(r.hash, r.size) for r in listed.collect()} == {(r.hash, r.size) for r in tree.collect()}


def test_plugins(spark):
    def upper(parts):
        for p in parts:
            yield p.assign(tr=p["text"].str.upper())[["doc", "pos", "tr"]]

    def one_less(parts):
        for p in parts:
            yield p.assign(tr="x")[["doc", "pos", "tr"]].iloc[:-1]

    plugins.TRANSLATORS.register("upper", upper)
    plugins.TRANSLATORS.register("short", one_less)
    df = spark.createDataFrame([("a", 0, "hi", 0), ("a", 1, "you", 0)], "doc string, pos long, text string, batch long").coalesce(1)
    assert [r.tr for r in plugins.translated(df, "upper").orderBy("pos").collect()] == ["HI", "YOU"]
    with pytest.raises(Exception, match="another number"):
        plugins.translated(df, "short").collect()
    with pytest.raises(ValueError):
        plugins.TRANSLATORS.apply(df, "none")


def _stream(spark, tmp_path, df, f, mode="append", name="out"):
    df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i % 3, i, "done" if i in (7, 11) else "running") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, seq long, status string")
    assert _stream(spark, tmp_path, df, status.until_final, name="finals") == sorted(map(tuple, sessions.until_final(df).collect()))
    langs = df.withColumn("lang", F.lit("en"))
    assert _stream(spark, tmp_path, langs, status.latest_status, "complete", "latest") == [(0, "en", "running", 18), (1, "en", "running", 19), (2, "en", "running", 17)]
    events = spark.createDataFrame([("c", i, "drain" if i == 80 else "event", str(i)) for i in range(100)] + [("d", 0, "event", "x")], "channel string, seq long, kind string, payload string")
    got = _stream(spark, tmp_path, events, status.bounded_channel, name="channel")
    assert [s for c, s, _ in got if c == "c"] == [*range(64), *range(81, 100)] and ("d", 0, "x") in got


def test_session_windows_stream(spark, tmp_path, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    got = _stream(spark, tmp_path, df, lambda s: status.session_windows(s, "2 hours"), "complete", "bursts")
    want = df.groupBy(F.session_window("ts", "2 hours"), "user_id").count().count()
    assert len(got) == want and sum(r[3] for r in got) == df.count()


def test_dirty_batches_are_pushed(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x long")
    df.write.parquet(str(tmp_path / "in"))
    pushed = []
    writer = status.push_when_dirty(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda b, e: pushed.append(b.count()), lambda b: not b.isEmpty(), "1 second")
    q = writer.option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert pushed == [1]


def test_words_in_live_turns(spark, tmp_path):
    ts = lambda s: f"2024-01-01 00:00:{s:02d}"
    words = spark.createDataFrame([("r", ts(1), "a"), ("r", ts(7), "b"), ("q", ts(1), "c")], "recording_id string, t string, word string").select("recording_id", F.to_timestamp("t").alias("w_ts"), "word")
    spans = spark.createDataFrame([("r", ts(0), ts(5), "A"), ("r", ts(5), ts(9), "B")], "recording_id string, s string, e string, speaker string").select("recording_id", F.to_timestamp("s").alias("s_ts"), F.to_timestamp("e").alias("e_ts"), "speaker")
    spans.coalesce(1).write.parquet(str(tmp_path / "spans"))
    right = spark.readStream.schema(spans.schema).parquet(str(tmp_path / "spans"))
    got = _stream(spark, tmp_path, words, lambda left: status.live_turns(left, right).select("word", "speaker"), name="live")
    assert got == [("a", "A"), ("b", "B")]


def test_a_job_with_fake_models(spark):
    from turnweave.operators import jobs

    scores = spark.createDataFrame([("r", k, k * 100, 0.9 if 2 <= k < 8 else 0.1) for k in range(12)], "recording_id string, frame long, t_ms long, score double")

    def speech(parts):
        for p in parts:
            yield p.assign(text="hi yo", language="en")[["recording_id", "chunk", "start_ms", "end_ms", "text", "language"]]

    def sharp(parts):
        for p in parts:
            rows = []
            for r in p.itertuples():
                frames = []
                for t in r.tokens:  # two frames a character, then a blank one
                    for k in (t if t > 0 else 5, t if t > 0 else 5, 0):
                        f = np.full(6, -9.0)
                        f[k] = -0.01
                        frames.append(f.tolist())
                rows.append((r.id, frames, list(r.tokens)))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["id", "emission", "tokens"])

    plugins.TRANSCRIBERS.register("speech", speech)
    plugins.ALIGNERS.register("sharp", sharp)
    segs = jobs.transcribe(scores, "speech")
    assert [(r.start_ms, r.end_ms, r.text) for r in segs.collect()] == [(200, 800, "hi yo")]
    asked = segs.select(F.col("recording_id").alias("id"), "text", "start_ms", "end_ms").unionByName(spark.createDataFrame([("s", "  ", 0, 10)], "id string, text string, start_ms long, end_ms long"))
    words = jobs.align_words(asked, {"h": 1, "i": 2, "|": 3, "y": 4}, "sharp").orderBy("word_idx").collect()
    assert [r.word for r in words] == ["hi", "yo"]
    assert all(200 <= r.start_ms < r.end_ms <= 800 for r in words) and words[0].end_ms <= words[1].start_ms


def test_best_paths_equal_all_paths_tried():
    """Every choice of frames at which a path moves on, by its sum of log probabilities."""
    rng = random.Random(3)

    def plain(emission, tokens):
        sums = []
        for at in itertools.combinations(range(len(emission)), len(tokens)):
            chosen = dict(zip(at, tokens))
            value = lambda t: emission[t][0] if t not in chosen else max(emission[t][1:]) if chosen[t] < 0 else emission[t][chosen[t]]  # noqa: B023, E731
            sums.append(sum(value(t) for t in range(at[-1] + 1)))
        return max(sums, default=None)

    for _ in range(80):
        frames, n = rng.randint(1, 7), rng.randint(1, 3)
        emission = np.array([[-rng.random() * 3 for _ in range(4)] for _ in range(frames)])
        tokens = [rng.choice([1, 2, 3, -1]) for _ in range(n)]
        path, want = ctc.best_path(emission, tokens), plain(emission, tokens)
        assert (path is None) == (want is None)
        if path:
            assert [p[1] for p in path] == list(range(path[0][1], path[-1][1] + 1)) and sorted({p[0] for p in path}) == list(range(n))
            assert sum(math.log(p[2]) for p in path) + sum(emission[t][0] for t in range(path[0][1])) == pytest.approx(want)


@pytest.mark.parametrize("cells", [1, 50, 1000])
def test_best_paths_are_the_same_from_kept_columns(monkeypatch, cells):
    rng = np.random.default_rng(cells)
    for frames, n in ((1, 1), (3, 5), (40, 7), (200, 30), (333, 100), (64, 64)):
        emission = np.log(rng.dirichlet(np.ones(6), frames)).round(1)
        tokens = rng.choice([1, 2, 3, 4, 5, -1], n).tolist()
        want = ctc.best_path(emission, tokens)
        with monkeypatch.context() as m:
            m.setattr(ctc, "CELLS", cells)
            m.setattr(ctc, "WAYS", 3)
            assert ctc.best_path(emission, tokens) == want


def test_long_alignments_need_little_memory():
    """Frames times tokens are 48 million steps, with their scores 400 MB in one array."""
    import tracemalloc

    rng = np.random.default_rng(1)
    frames, n = 12_000, 4_000
    emission = np.log(rng.dirichlet(np.ones(8), frames))
    tracemalloc.start()
    path = ctc.best_path(emission, rng.integers(1, 8, n).tolist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert path[0][0] == 0 and path[-1][0] == n - 1 and peak < 40 << 20


def test_edit_distances_in_a_growing_band_equal_a_table():
    rng = random.Random(8)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [prev := i + 1] + [prev := min(prev + 1, row[j + 1] + 1, row[j] + (x != y)) for j, y in enumerate(b)]
        return row[-1]

    for _ in range(400):
        a = [rng.choice("abcé") for _ in range(rng.randint(0, 40))]
        b = list(a) if rng.random() < 0.6 else [rng.choice("abcé") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choices("abz", k=rng.randint(0, 2))
        want = table(a, b)
        assert metrics.edit_distance("".join(a), "".join(b)) == metrics.edit_distance(a, b) == want
        if a and b:
            x, y = metrics._codes(a, b)
            assert metrics._near_distance(x, y, 100) == want and (want == 0 or metrics._near_distance(x, y, want - 1) is None) and metrics.far_distance(a, b) == want


def test_long_near_texts_are_compared_fast():
    import time
    import tracemalloc

    rng = random.Random(9)
    a = [f"w{rng.randrange(5000)}" for _ in range(300_000)]
    b = list(a)
    for at in range(5, len(b), 6000):
        b[at] = "changed"
    del b[100_000:100_003]
    began = time.perf_counter()
    tracemalloc.start()
    assert metrics.edit_distance(a, b) == 53
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.perf_counter() - began < 10 and peak < 100 << 20


def test_segments_of_many_languages_split_by_their_own_rules(spark):
    from turnweave.operators import cue_rules

    said = "one two three four five six seven eight et neuf ten eleven twelve thirteen fourteen"
    rows = [("r", k, lang, 0.0, 9.0, said, None) for k, lang in enumerate(("en", "fr", "xx", "zh"))]
    df = spark.createDataFrame(rows, "recording_id string, seg_idx long, lang string, start double, end double, text string, words array<struct<word:string,start:double,end:double>>")
    own = cue_rules.conjunctions(spark).unionByName(spark.createDataFrame([("xx", "Eight")], "lang string, word string"))
    rules = cue_rules.rules(df, own)
    got = {}
    for r in subtitles.split_by_language(df, rules).orderBy("seg_idx", "part").collect():
        got.setdefault(r.seg_idx, []).append(r.text)
    for k, (lang, *_) in enumerate([(r[2],) for r in rows]):
        words = frozenset(cue_rules.CONJUNCTIONS.get(lang, "").split()) | (frozenset({"eight"}) if lang == "xx" else frozenset())
        alone = subtitles.split_cues(df.where(F.col("seg_idx") == k).drop("lang"), subtitles.Splitter(lang, words)).orderBy("part").collect()
        assert got[k] == [r.text for r in alone]
    assert len({tuple(v) for v in got.values()}) == 4 and any(p.startswith("et ") for p in got[1]) and any(p.startswith("eight") for p in got[2])


def test_numbered_files_are_written_only_if_split(spark):
    cues = spark.createDataFrame([("r", 1, 0, 1.0, 2.5, " late "), ("r", 0, 1, 0.5, 1.0, "b"), ("r", 0, 0, 0.0, 0.5, "a")], "recording_id string, seg_idx long, part long, start double, end double, text string")
    two = spark.createDataFrame([("r",), ("r",), ("none",)], "recording_id string")
    lines, counts = writers.numbered(cues, two)
    assert [r.text for r in lines.orderBy("line").collect()] == ["1\n00:00:00,000 --> 00:00:00,500\na\n", "2\n00:00:00,500 --> 00:00:01,000\nb\n", "3\n00:00:01,000 --> 00:00:02,500\nlate\n"]
    assert {r.recording_id: r.n for r in counts.collect()} == {"r": 3, "none": 0}
    lines, counts = writers.numbered(cues, two, split=False, vtt=True)
    assert {(r.recording_id, r.text) for r in lines.collect()} == {("r", "WEBVTT\n"), ("none", "WEBVTT\n")} and {r.n for r in counts.collect()} == {0, 3}


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        row = spark.createDataFrame([(list(range(n)),)], "v array<int>").select(arrays.running_sums(F.col("v")).alias("s")).first()
        assert row.s == [k * (k - 1) // 2 for k in range(n + 1)]
