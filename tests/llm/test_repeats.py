import hashlib
import random
import re

import pytest

from turnweave.llm import chaining, suffix_levels


def brute(rows, width=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, x in texts:
        for s in range(len(x) - width + 1):
            k = x[s : s + width]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, x in texts:
        gone = bytearray(len(x))
        for s in range(len(x) - width + 1):
            if first[x[s : s + width]] < i:
                gone[s : s + width] = b"\1" * width
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 90))) for _ in range(25)] + ["a" * 200, "é" * 40]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in range(120)] + [(200, None), (201, ""), (5, parts[0] * 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("batches,hot", [(1, 4096), (2, 4096), (5, 4096), (2, 1)])
def test_removed_bytes_match_brute_force(made, batches, hot):
    rows, df = made
    assert result(suffix_levels.remove_repeats(df, batches=batches, hot=hot)) == brute(rows)


def test_sample_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(suffix_levels.remove_repeats(docs)) == brute(rows)


def test_levels_merge_like_a_binary_counter(spark):
    index = suffix_levels.SuffixLevels(spark)
    ranks = []
    for b in range(5):
        batch = spark.createDataFrame([(b, f"{b} " * 60)], "doc_id long, text string")
        index.append(batch, "doc_id", "text")
        ranks.append([r for r, _, _ in index.levels])
    assert ranks == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0]]


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_levels.remove_repeats(odd).collect()}
    assert {(3, 0, 0), (4, 0, 0), (None, 10, 0)} <= got
    assert (1, 309, 0) in got and (2, 309, 309) in got
    assert suffix_levels.remove_repeats(odd).count() == odd.count()
    assert suffix_levels.remove_repeats(none).count() == 0


def test_word_distance_and_chains():
    rng = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert chaining.edit_distance(a, b) == plain(a, b)
    segments = [(10, 110, 4, 4), (20, 121, 4, 4), (30, 130, 4, 4), (15, 500, 4, 4), (40, 90, 4, 4), (50, 151, 4, 4), (52, 156, 4, 4)]
    assert chaining.chains(segments)[0] == [0, 1, 2, 5]


def changed(passage, every, word, rng, kind):
    """A passage with each ``every``-th word changed, or as many at random places, or with as many words put in, left out or changed."""
    n = len(passage) // every
    at = {k for k in range(len(passage)) if (k + 1) % every == 0} if kind == "even" else set(rng.sample(range(1, len(passage) - 1), n))
    out = []
    for k, w in enumerate(passage):
        draw = rng.random() if k in at else 1.0
        if kind != "mixed":
            out.append(word() if k in at else w)
        elif draw < 0.67 or k not in at:
            out += [word(), w] if draw < 0.33 else [word() if k in at else w]
    return out


@pytest.mark.parametrize("kind", ["even", "random", "mixed"])
def test_recall_of_planted_passages(spark, kind):
    """At least 0.9 of passages of 60 to 120 words at identities from 0.8 to 1; 0.85 of those at 0.8 whose changes crowd."""
    rng = random.Random(kind)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    rows, planted = [], {}
    for every in (5, 6, 8, 10, 15, 20, 1000):
        for _ in range(20):
            passage = words(rng.choice((60, 80, 120)))
            for mine in (passage, changed(passage, every, word, rng, kind)):
                rows.append((len(rows), " ".join(words(rng.randint(5, 60)) + mine + words(rng.randint(5, 60)))))
            planted[(len(rows) - 1, len(rows) - 2)] = every
    found = {(r.doc_id, r.source_id) for r in chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= set(planted)
    for every in set(planted.values()):
        hits = [p in found for p, e in planted.items() if e == every]
        assert sum(hits) >= (0.9 if kind == "even" or every > 5 else 0.65) * len(hits), (kind, every, sum(hits))


def test_links_do_not_scatter_and_classes_join(spark):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p, q = words(30), words(30)
    bodies = [words(60) + x + words(60) for x in [p] * 20 + [q] * 20 + [p + q, words(70), p + q, p + q]]
    found = chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bodies)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {42, 43} and (42, 40) in {(r.doc_id, r.source_id) for r in found}
    assert {r.class_id for r in found} == {40}


def test_changed_copies_of_a_frequent_passage_are_all_linked(spark, monkeypatch):
    """However many copies there are, each is linked with each other that is alike enough, also where seeds are compared in tiles."""
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    template = words(80)
    copies = [[w if rng.random() < 0.9 else words(1)[0] for w in template] for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words(30) + c + words(30))) for i, c in enumerate(copies)], "doc_id long, text string")
    wanted = {(i, j) for i in range(60) for j in range(i) if sum(x != y for x, y in zip(copies[i], copies[j])) <= 15}
    found = {(r.doc_id, r.source_id) for r in chaining.fuzzy_passages(docs).collect()}
    assert len(wanted) > 500 and len(wanted & found) >= 0.95 * len(wanted)
    monkeypatch.setattr(chaining, "MANY", 17)
    monkeypatch.setattr(chaining, "TILE", 7)
    assert {(r.doc_id, r.source_id) for r in chaining.fuzzy_passages(docs).collect()} == found


def test_frequent_seeds_link_only_what_can_be_a_passage(spark):
    """A line that 40 documents share makes no candidates of them, whatever else repeats in them; copies of a passage after it are linked."""
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    line, passage = words(12), words(60)
    bodies = [words(40) + line + (words(1) * 50 if i % 2 else words(50)) for i in range(38)] + [words(40) + line + passage for _ in range(2)]
    docs = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bodies)], "doc long, text string")
    every = chaining._sampled(chaining.MIN_WORDS)
    seeds = docs.mapInArrow(chaining._seeds(every, chaining.MIN_WORDS), "seed long, around long, doc long, place int")
    assert seeds.groupBy("seed").count().where(f"count > {chaining.FEW}").count()
    links = chaining._links(seeds, docs, chaining.Scratch(spark, "test"), chaining._common(chaining.MIN_WORDS, chaining.IDENTITY))
    assert {(r.doc, r.source) for r in links.collect()} == {(39, 38)}


def test_runs_of_one_word_are_linked_with_the_longest_earlier_one(spark):
    """As many links as runs, not as pairs of them, whatever the word's hash; a longer run is covered by a shorter one again and again."""
    rng = random.Random(7)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    found = {}
    for word in ("and", "of"):
        sizes = [60, 55, 70, 64, 70, 45, 200] + [rng.randint(52, 66) for _ in range(30)]
        # 45 words alone are no passage. The last has its word in pieces with another word between them.
        runs = [[word] * n for n in sizes] + [([word] * 9 + words(1)) * 8]
        docs = spark.createDataFrame([(i, " ".join(words(40) + r + words(40))) for i, r in enumerate(runs)], "doc_id long, text string")
        links = chaining._run_links(docs.toDF("doc", "text"), chaining.MIN_WORDS, chaining._common(chaining.MIN_WORDS, chaining.IDENTITY)).collect()
        assert len(links) <= 4 * len(runs)
        rows = chaining.fuzzy_passages(docs).collect()
        found[word] = {(r.doc_id, r.source_id) for r in rows}
        assert {(i, 0 if i < 3 else 2 if i < 7 else 6) for i in range(1, len(runs)) if i != 5} <= found[word]
        assert len(found[word]) <= 2 * len(runs) and {r.class_id for r in rows} == {0}
        covered = {k for r in rows if r.doc_id == 6 for k in range(r.start_word, r.end_word)}
        assert set(range(40, 240)) <= covered


def test_words_beside_runs_link_different_texts(spark):
    """Documents that share more than a run of one word are linked with each other, not by way of the longest run alone."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    near, far = words(1), words(30)
    bodies = [words(40) + ["and"] * 99 + words(40)] + [words(40) + near + ["and"] * 60 + words(40) for _ in range(2)] + [words(40) + ["and"] * 60 + far + words(40) for _ in range(2)]
    found = {(r.doc_id, r.source_id) for r in chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bodies)], "doc_id long, text string")).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 0), (2, 1), (4, 3)} <= found


def test_starts_of_one_run_are_grown_once(monkeypatch):
    """The same passages, and two growths for a start instead of six, none for another word of its run."""
    calls = []
    grow = chaining._grow
    monkeypatch.setattr(chaining, "_grow", lambda *a: calls.append(1) or grow(*a))
    a, b = chaining.np.arange(100, dtype="u4"), chaining.np.arange(100, dtype="u4")
    b[:45] += 1000
    b[60:] += 1000
    assert chaining.align(a, b, [(45, 45), (50, 50), (56, 56)], 50, 0.8) == [] and len(calls) == 2
    b[30:] = a[30:]
    b[60] += 1000
    assert chaining.align(a, b, [(45, 45), (50, 50)], 50, 0.8) == [(30, 100, 30, 100, round(1 - 1 / 70, 6))]


def test_smaller_least_lengths(spark):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p = words(22)
    rows = [(i, " ".join(words(30) + p + words(30))) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert chaining.fuzzy_passages(df).count() == 0
    assert {(r.doc_id, r.source_id) for r in chaining.fuzzy_passages(df, min_words=20).collect()} == {(1, 0)}


def test_fuzzy_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(90)]
    changed = [w if k % 15 else word() for k, w in enumerate(passage)]
    text = lambda mid: " ".join([word() for _ in range(70)] + mid + [word() for _ in range(70)])
    rows = [(0, text(passage)), (1, text([])), (2, text(passage)), (3, text(changed)), (4, text(passage[:30])), (5, text([]))]
    found = chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {2, 3}
    for r in found:
        assert abs(r.start_word - 70) <= 3 and abs(r.end_word - 160) <= 3 and r.identity >= 0.8
    assert {r.identity for r in found if r.doc_id == 2} == {1.0}


def test_passages_are_found_at_every_place(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    passage, other = words(80), words(80)
    strays = [w for k in range(0, 72, 12) for w in passage[k : k + 8] + words(9)]
    twenty = [w for _ in range(20) for w in other + words(30)]
    bodies = [
        words(40) + strays + words(60) + passage + words(40),
        words(40) + passage + words(300) + passage + words(20),
        words(10) + strays + words(700) + passage + words(30),
        words(20) + twenty, words(50) + twenty,
    ]
    rows = [(i, " ".join(b)) for i, b in enumerate(bodies)]
    found = chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for doc, source, part in ((1, 0, passage), (2, 0, passage), (2, 1, passage), (4, 3, other)):
        for k in (k for k in range(len(bodies[doc])) if bodies[doc][k : k + 80] == part):
            hits = [r for r in found if (r.doc_id, r.source_id) == (doc, source) and r.start_word <= k + 3 and r.end_word >= k + 77]
            assert hits, (doc, source, k)


def test_all_long_exact_passages_of_the_sample_are_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id for r in chaining.fuzzy_passages(docs).collect()}
    seen, want = {}, set()
    for i, t in sorted((r.doc_id, r.text) for r in docs.collect()):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        if any(r in seen for r in runs):
            want.add(i)
        for r in runs:
            seen.setdefault(r, i)
    assert want <= found


def test_odd_rows_of_chaining(odd, none):
    pairs = {(r.doc_id, r.source_id) for r in chaining.fuzzy_passages(odd).collect()}
    assert pairs == {(2, 1), (6, 5)}
    assert chaining.fuzzy_passages(none).count() == 0
