import collections
import itertools
import random

import numpy as np
import pytest

from turnweave.llm import bag_minhash, edit_match, itq
from turnweave.llm.components import components
from turnweave.llm.scratch import Scratch


def classes(rows, size=5, similarity=0.8):
    bags = {}
    for i, t in rows:
        w = [x for x in t.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).split()]
        bags[i] = collections.Counter([tuple(w[k : k + size]) for k in range(len(w) - size + 1)] or ([tuple(w)] if w else []))
    of = {i: i for i in bags}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        both, all_ = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
        if all_ and both >= similarity * all_ - 1e-9:
            x, y = top(a), top(b)
            of[max(x, y)] = min(x, y)
    return {i: top(i) for i in bags}


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w + w[: rng.choice((0, 0, len(w)))])))
            i += 1
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_classes_match_brute_force(copies):
    rows, df = copies
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(df).collect()}
    assert got == classes(rows)


def test_sample_classes_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(docs).collect()}
    assert got == classes([(r.doc_id, r.text) for r in docs.collect()])


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    n, places = 400, 4096
    shingle = rng.integers(0, 2**63, n).astype(np.uint64)
    a, b = rng.integers(1, 9, n), rng.integers(1, 9, n)
    text = np.repeat([0, 1], n)
    s = bag_minhash.signatures(text, np.concatenate([shingle, shingle]), np.concatenate([a, b]), 2, places)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / places) ** 0.5


def test_tiles_of_any_size_find_the_same(copies, monkeypatch):
    rows, df = copies
    monkeypatch.setattr(bag_minhash, "TILE", 2)
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(df).collect()}
    assert got == classes(rows)


def test_one_stranger_makes_few_rows(spark):
    """A bucket of 10,000 texts of one component and one text of another: each is in one tile with it."""
    buckets = spark.range(10_001).selectExpr("1L as key", "id as doc")
    labels = spark.range(10_000).selectExpr("id as node", "0L as component")
    rows = bag_minhash._tiles(buckets, labels, 256).collect()
    assert len(rows) <= 10_000 + 2 * 41
    mine = {(r.i, r.j) for r in rows if r.doc == 10_000}
    assert all((r.i, r.j) in mine for r in rows)
    three = bag_minhash._tiles(spark.range(30).selectExpr("1L as key", "id as doc"), spark.range(30).selectExpr("id as node", "id % 3 as component"), 4).collect()
    met = {(a.doc, b.doc) for a in three for b in three if (a.i, a.j) == (b.i, b.j) and a.doc < b.doc}
    assert {(a, b) for a in range(30) for b in range(a + 1, 30) if a % 3 != b % 3} <= met


def test_odd_rows(odd, none):
    got = collections.defaultdict(list)
    for r in bag_minhash.near_duplicates(odd).collect():
        got[r.doc_id].append((r.class_id, r.kept))
    assert got[1] == [(1, True)] and got[2] == [(1, False)] * 2 and got[3] == [(3, True)] and got[None] == [(None, True)]
    assert got[4] == [(4, True)] and got[7] == [(7, True)] and got[5] == [(5, True)]
    assert bag_minhash.near_duplicates(none).count() == 0


def test_one_of_repeated_rows_is_kept(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, "x")] * 2, "doc_id long, text string")
    assert [r.doc_id for r in bag_minhash.near_duplicates(df).where("kept").collect()].count(1) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for _ in range(150):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 8)):
            v = base / np.linalg.norm(base) + rng.standard_normal(32) * rng.choice([0.0, 0.02, 0.06]) 
            rows.append((int(i), [float(x) for x in v], 0))
            i += 1
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [1.0] * 5, [float("inf")] * 32]
    rows += [(1000 + k, v, 1) for k, v in enumerate(bad)] + [(None, rows[0][1], 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id int")


@pytest.mark.parametrize("tile", [512, 2])
def test_vectors_against_brute_force(vectors, tile):
    rows, df = vectors
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq.near_vectors(df, tile=tile).collect()}
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and i < 1000]
    m = np.stack([v / np.linalg.norm(v) for _, v in good])
    close = m @ m.T >= 0.9
    np.fill_diagonal(close, False)
    found = sum(got[i][0] for i, _ in good)
    assert all(got[i][0] <= n for (i, _), n in zip(good, close.sum(axis=1)))
    assert found >= 0.9 * close.sum()
    assert all(got[1000 + k] == (0, 1000 + k, True) for k in range(7))
    assert got[None] == (0, None, True)


@pytest.mark.parametrize("tile", [512, 16])
def test_components_of_chains_of_vectors(spark, tile):
    rng = np.random.default_rng(9)
    m = []
    for _ in range(8):
        v = rng.standard_normal(64)
        for _ in range(60):
            v = v / np.linalg.norm(v)
            m.append(v)
            step = rng.standard_normal(64)
            step -= v * (step @ v)
            v = 0.93 * v + (1 - 0.93**2) ** 0.5 * step / np.linalg.norm(step)
    ids = rng.permutation(len(m))
    close = np.stack(m) @ np.stack(m).T >= 0.9
    np.fill_diagonal(close, False)
    want = {}
    for k in range(len(m)):
        seen, todo = {k}, [k]
        while todo:
            new = set(np.flatnonzero(close[todo.pop()])) - seen
            seen |= new
            todo += new
        want[int(ids[k])] = (int(close[k].sum()), min(int(ids[x]) for x in seen))
    assert len({c for _, c in want.values()}) == 8
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m)], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in itq.near_vectors(df, recall=0.999999, tile=tile).collect()} == want


def test_equal_vectors_and_empty_tables(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, [-1.0, 2.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_vectors(df).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 9: (0, 9)}
    assert itq.near_vectors(df.limit(0)).count() == 0


def test_pattern_distance_matches_a_table():
    rng = random.Random(7)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(2))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
            row = new
            best = min(best, row[-1])
        hit = edit_match.Pattern(p).best(t, len(p))
        assert min(hit[0] if hit else len(p), len(p)) == min(best, len(p))


def test_leaks_with_edits_are_found(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij   ") for _ in range(n))
    items = [(k, text(200)) for k in range(6)]
    edited = list(items[1][1])
    for k in range(20, 180, 20):
        edited[k] = "z"
    rows = [(0, text(500) + " " + items[0][1].upper() + "\n" + text(300)), (1, text(100) + " " + "".join(edited) + " " + text(50)), (2, text(2000)), (3, None), (4, ""), (0, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(50, None), (51, " !! ")], "item_id long, text string")
    found = edit_match.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 0), (0, 0), (1, 1)]
    hit = next(r for r in found if r.doc_id == 0 and r.start > 0)
    assert edit_match.normal(rows[0][1][hit.start : hit.end]) == edit_match.normal(items[0][1])
    assert [r.doc_id for r in edit_match.without_leaks(docs, bench).orderBy("doc_id").collect()] == [2, 3, 4]
    assert edit_match.find_leaks(docs, bench, block=250).count() == 3
    assert edit_match.find_leaks(docs.limit(0), bench).count() == 0 and edit_match.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_of_the_sample(spark, sf_dir, odd):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in edit_match.find_leaks(docs, bench).collect()}
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if edit_match.normal(b.text) in edit_match.normal(d.text)}
    assert want and want <= found
    assert edit_match.find_leaks(odd, bench).count() == 0
    assert edit_match.without_leaks(odd, bench).count() == odd.count()


def test_leaks_match_brute_force(spark):
    """All stretches of whole words against all items, with words changed, joined, split and cut off."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(14)] + [(14, "cat"), (15, None), (16, " ,. ")]

    def bent(text):
        t = list(text)
        for _ in range(rng.randint(0, max(1, len(t) // 9))):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = rng.choice(["x", " ", "", "a"])
        return "".join(t)

    docs = [(d, " ".join(bent(rng.choice(items[:14])[1]) if rng.random() < 0.5 else word() for _ in range(8))) for d in range(25)] + [(25, "concatenate cats"), (26, "a Cat, sat"), (27, None), (28, "xcat cat")]
    want = set()
    for d, text in docs:
        w = edit_match.normal(text).split()
        for i, item in items:
            x = edit_match.normal(item)
            errors = int(edit_match.RATE * len(x))
            stretches = {" ".join(w[a:b]) for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
            if x and any(abs(len(y) - len(x)) <= errors and edit_match.edit_distance(x, y) <= errors for y in stretches):
                want.add((d, i))
    found = edit_match.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and (25, 14) not in want and {(26, 14), (28, 14)} <= want
    for r in rows:
        part = edit_match.normal(docs[r.doc_id][1][r.start : r.end])
        assert edit_match.edit_distance(edit_match.normal(items[r.item_id][1]), part) == r.distance


def test_leaks_of_very_long_texts_and_other_kinds_of_ids(spark):
    import datetime

    item = "the quick brown fox jumps over the lazy dog while it rains"
    long = " ".join(f"w{k}" for k in range(60_000)) + " " + item.replace("quick", "quack") + " end"
    day = datetime.date(2024, 1, 1)
    docs = spark.createDataFrame([(day, long, 1), (None, item, 2)], "doc_id date, text string, item_id int")
    items = spark.createDataFrame([(1.5, item)], "item_id double, text string")
    got = sorted((str(r.doc_id), r.item_id, r.distance) for r in edit_match.find_leaks(docs, items).collect())
    assert got == [("2024-01-01", 1.5, 1), ("None", 1.5, 0)]
    assert edit_match.without_leaks(docs, items).count() == 0


@pytest.mark.parametrize("mean", [0.0, 0.8, 0.999])
def test_vectors_about_a_common_direction(spark, mean):
    """Recall against brute force however close all vectors lie, with few tables."""
    rng = np.random.default_rng(3)
    width, n = 64, 600
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = np.eye(width)[0] * mean**0.5 + unit(rng.standard_normal((n, width))) * (1 - mean) ** 0.5
    near = unit(base[: n // 2]) + 0.42 * unit(rng.standard_normal((n // 2, width)))
    v = np.concatenate([base, near])
    cos = unit(v) @ unit(v).T >= 0.9
    np.fill_diagonal(cos, False)
    assert itq.learn(v, 10**6).tables <= itq.TABLES
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in itq.near_vectors(rows).collect()}
    assert all(found[i] <= cos[i].sum() for i in found)
    assert sum(found.values()) >= 0.9 * cos.sum()


def test_equal_close_and_single_vectors_are_one_component(spark):
    rng = np.random.default_rng(4)
    for v in ([[1.0, 2.0]] * 5, [[3.0] * 8], (1 + 0.01 * rng.standard_normal((40, 16))).tolist()):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        found = itq.near_vectors(rows).collect()
        assert [(r.n_links, r.component_id) for r in found] == [(len(v) - 1, 0)] * len(v)
