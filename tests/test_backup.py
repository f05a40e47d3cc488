"""Versions, backup and restore, speakers' enrolment."""

import pytest
from pyspark.sql import functions as F

from turnweave.functions import texts
from turnweave.operators import edits
from turnweave.sources import backup, versions


def test_versions_are_whole_or_absent(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.read(spark, root) is None
    assert versions.publish(spark.range(3), root) == 1
    spark.range(9).write.parquet(f"{root}/data-2")  # written, never committed
    assert versions.read(spark, root).count() == 3
    assert versions.publish(spark.range(5), root) == 2
    assert versions.read(spark, root).count() == 5 and versions.read(spark, root, 1).count() == 3
    with pytest.raises(ValueError):
        versions.read(spark, root, 7)


def test_push_and_restore(spark, tmp_path):
    src, store, out = tmp_path / "src", tmp_path / "store", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    (src / "a").write_text("one")
    (src / "sub/b").write_text("two")
    assert backup.push(spark, str(src), str(store)) == {"upload": 2, "skip": 0, "collect": 0}
    assert backup.push(spark, str(src), str(store)) == {"upload": 0, "skip": 2, "collect": 0}
    (src / "a").rename(src / "renamed")
    (src / "sub/b").write_text("three")
    assert backup.push(spark, str(src), str(store)) == {"upload": 1, "skip": 1, "collect": 1}
    assert len(list((store / "objects").iterdir())) == 2
    out.mkdir()
    (out / "stray").write_text("x")
    with pytest.raises(RuntimeError):
        backup.restore(spark, str(store), str(out), busy=True)
    assert backup.restore(spark, str(store), str(out)) == 2
    assert {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file() and not p.name.startswith(".")} == {"renamed": "one", "sub/b": "three"}
    with pytest.raises(ValueError):
        backup.restore(spark, str(tmp_path / "none"), str(out))


def test_enrolment(spark):
    keys = spark.createDataFrame([("r", "SPEAKER_00"), ("r", "SPEAKER_03")], "recording_id string, speaker string")
    names = spark.createDataFrame([("r", "SPEAKER_00", "Ann")], "recording_id string, speaker string, name string")
    wanted = lambda n: spark.createDataFrame([("r", n)], "recording_id string, name string")
    assert tuple(edits.enrol(keys, names, wanted("Bob")).first()) == ("r", "SPEAKER_04", "Bob")
    for taken in ("ANN", "speaker 4"):
        with pytest.raises(Exception, match="taken"):
            edits.enrol(keys, names, wanted(taken)).collect()


def test_coerced_values(spark):
    df = spark.createDataFrame([("small",), ("x",), (None,)], "m string")
    assert [r[0] for r in df.select(texts.coerced(F.col("m"), ["small", "large"], "base")).collect()] == ["small", "base", "base"]


def test_roots_and_signatures_of_groups_hash_sorted_lines(spark):
    import hashlib
    import random

    from turnweave.operators import manifest

    rng = random.Random(1)
    rows = [(rng.choice(("a", "b", None, "one")) if k else "single", f"p{rng.randrange(10**6)}/é", f"h{k}", k, k * 7) for k in range(3000)]
    df = spark.createDataFrame(rows, "group string, path string, hash string, size long, mtime_ns long").repartition(7)
    roots = {r.group: (r.root, r.files) for r in manifest.root(df).collect()}
    signatures = {r.group: r.signature for r in manifest.signature(df).collect()}
    for group in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == group)
        own.sort(key=lambda r: r[1].encode())
        assert roots[group] == (hashlib.sha256("".join(f"{p}\0{h}\0" for _, p, h, *_ in own).encode()).hexdigest(), len(own))
        assert signatures[group] == hashlib.sha256("\0".join(f"{p}\0{s}\0{m}" for _, p, _, s, m in own).encode()).hexdigest()
    assert manifest.root(df.limit(0)).count() == 0


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        got = dict(zip(pool.map(lambda n: versions.publish(spark.range(n), root), range(1, 7)), range(1, 7), strict=True))
    assert sorted(got) == [1, 2, 3, 4, 5, 6] == versions.committed(spark, root)
    assert all(versions.read(spark, root, version).count() == n for version, n in got.items())


def test_a_file_that_changes_during_a_push_is_not_committed(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "src", tmp_path / "store"
    src.mkdir()
    (src / "a").write_text("one")
    assert backup.push(spark, str(src), str(store))["upload"] == 1
    (src / "a").write_text("two")
    put = backup.objects.put

    def late(files, folder):
        (src / "a").write_text("three")
        put(files, folder)

    monkeypatch.setattr(backup.objects, "put", late)
    with pytest.raises(RuntimeError, match="changed"):
        backup.push(spark, str(src), str(store))
    monkeypatch.undo()
    assert versions.committed(spark, str(store / "manifest")) == [1]
    assert backup.push(spark, str(src), str(store)) == {"upload": 1, "skip": 0, "collect": 1}
