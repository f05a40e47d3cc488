"""Whole records of sessions against plain assembly."""

from turnweave.operators import details, overlay


def test_record_of_many_sessions(spark):
    sessions = spark.createDataFrame([("a", "done"), ("b", "queued"), ("c", "done")], "id string, status string")
    segments = spark.createDataFrame(
        [("a", 0, 0, 900, "SPEAKER_00", "hello"), ("a", 1, 1000, 1900, "SPEAKER_00", "again, edited"), ("a", 2, None, None, None, "untimed"), ("a", 3, 3000, 3100, "SPEAKER_01", "bye"), ("c", 0, 0, 10, "SPEAKER_00", "alone"), ("x", 0, 0, 1, None, "no session")],
        "recording_id string, seg_idx long, start_ms long, end_ms long, speaker string, text string",
    )
    entries = spark.createDataFrame(
        [("a", "de", 0, "hello", "hallo"), ("a", "de", 1000, "again", "wieder"), ("a", "fr", 3000, None, ""), ("a", "fr", 3000, None, ""), ("a", "es", None, "x", "y"), ("gone", "de", 0, "x", "y")],
        "recording_id string, lang string, start_ms long, src string, tr string",
    )
    names = spark.createDataFrame([("a", "SPEAKER_00", "Ann"), ("a", "SPEAKER_09", "Unused"), ("a", None, "nobody"), ("b", "SPEAKER_00", "")], "recording_id string, speaker string, name string")
    edits = spark.createDataFrame([("a",), ("a",)], "recording_id string")
    found = {r.id: r for r in details.details(sessions, segments, entries, names, edits).collect()}
    assert set(found) == {"a", "b", "c"}
    a = found["a"]
    assert (a.status, a.can_undo, a.names) == ("done", True, {"SPEAKER_00": "Ann", "SPEAKER_09": "Unused"})
    assert [(s.seg_idx, s.label, s.text) for s in a.segments] == [(0, "Ann", "hello"), (1, "Ann", "again, edited"), (2, "Speaker", "untimed"), (3, "Speaker 2", "bye")]
    said = [{t.lang: (t.text, t.stale) for t in s.translations} for s in a.segments]
    assert [x["de"] for x in said] == [("hallo", False), ("again, edited", True), ("untimed", True), ("bye", True)]
    assert [x["fr"] for x in said] == [("hello", True), ("again, edited", True), ("untimed", True), ("", False)] and all(x["es"][1] for x in said)
    assert [(t.lang, t.n, t.stale) for t in a.translations] == [("de", 4, 3), ("es", 4, 4), ("fr", 4, 3)]
    assert [(t.turn, t.label, t.start_ms, t.end_ms, t.text) for t in a.turns] == [(0, "Ann", 0, 1900, "hello again, edited"), (1, "Speaker", None, None, "untimed"), (2, "Speaker 2", 3000, 3100, "bye")]
    b, c = found["b"], found["c"]
    assert (b.segments, b.turns, b.translations, b.can_undo, b.names) == ([], [], [], False, {"SPEAKER_00": ""})
    assert c.segments[0].translations == [] and c.segments[0].label == "Speaker 1" and c.names == {}
    assert details.details(sessions.limit(0), segments, entries, names, edits).count() == 0


def test_exported_translations(spark):
    segments = spark.createDataFrame([("a", 0, 0, 900, None, "hello"), ("a", 1, 1000, 1900, "S", "new"), ("b", 0, 0, 900, None, "none")], "recording_id string, seg_idx long, start_ms long, end_ms long, speaker string, text string")
    entries = spark.createDataFrame([("a", "de", 0, "hello", "hallo"), ("b", "fr", 0, "none", "aucun")], "recording_id string, lang string, start_ms long, src string, tr string")
    assert [(r.recording_id, r.text) for r in overlay.exported(segments, entries, "de", "txt").orderBy("line").collect()] == [("a", "hallo"), ("a", "[S]: new")]
    assert [r.text for r in overlay.exported(segments, entries, "fr", "srt").collect()] == ["1\n00:00:00,000 --> 00:00:00,900\naucun\n"]
