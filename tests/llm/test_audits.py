"""Audits of filters and sources against plain counting."""

import itertools
import random
import re
from collections import Counter

import pytest
from turnweave.llm import divergence as dv
from turnweave.llm.filter_audit import LETTERS, filter_audit, plain_changes


@pytest.mark.parametrize("k", range(1, 7))
def test_plain_changes_visit_every_order_once(k):
    order = list(range(k))
    seen = [tuple(order)]
    for at in plain_changes(k):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert sorted(seen) == list(itertools.permutations(range(k)))


def audit(docs, labels):
    """Every order applied to every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), copy)
        parts.setdefault(source or "", []).append((i, dict(zip(LETTERS, fails, strict=True))))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys(LETTERS, 0)
        for order in itertools.permutations(LETTERS):
            left = rows
            for step, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                all_fail, alone = sum(r[1][f] for _, r in enumerate(rows)), sum(r[1][f] and sum(r[1].values()) == 1 for r in rows)
                out[part, "".join(order), step + 1] = [len(left), len(gone), all_fail - len(gone), alone, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def rows(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_filter_audit_equals_plain_counting(spark):
    many, same = " ".join(f"w{i}" for i in range(250)), " ".join(["again"] * 300)
    docs = [
        (5, many, "a"), (1, many, "b"), (5, many, "a"), (7, many, None), (None, many, "a"), (None, many + " #", "a"), (2, same, "a"), (3, same + " X" * 400, "b"), (3, same + " X" * 400, "b"),
        (4, None, ""), (6, "", "a"), (8, many.upper() + " $", "b"), (9, "é" * 100, None), (10, "short", "c"), (11, "w " * 100_000 + "|", "c"),
    ]
    labels = [(5, 1, 0), (5, 0, 1), (1, 1, None), (3, None, 1), (None, 1, 1), (99, 1, 1), (4, 1, 0), (11, 0, 1)]
    left = spark.createDataFrame([(*d, "x", 1, True) for d in docs], "doc_id long, text string, source string, doc string, part int, first boolean")
    right = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, hash string")
    found = filter_audit(left, right)
    assert found.count() == 4 * 600
    assert rows(found) == audit(docs, labels)
    assert rows(filter_audit(left, right.limit(0))) == audit(docs, [])
    assert filter_audit(left.limit(0), right).count() == 0


def test_filter_audit_of_one_text_in_all_rows(spark):
    docs = spark.range(0, 3000, 1, 8).selectExpr("id AS doc_id", "'the same text' AS text", "CAST(id % 3 AS STRING) AS source")
    found = rows(filter_audit(docs, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")))
    assert found["0", "EABCD", 1] == [1, 999, 0, 0, 0, 0, found["0", "EABCD", 1][-1]]
    assert found["1", "EABCD", 1][:2] == [0, 1000]
    assert found["0", "ABCDE", 1][:2] == [0, 1000] and found["0", "ABCDE", 1][4] == 1


def differences(docs, documents, top):
    """Every pair of sources term by term, in whole numbers."""
    tokens = [(lang or "", source or "", Counter(re.findall(rb"[a-z\x80-\xff]+", bytes((text or "").encode()).lower()))) for text, lang, source in docs]
    out = set()
    for lang in {x[0] for x in tokens}:
        own = [x for x in tokens if x[0] == lang]
        total, docs_of = Counter(), Counter()
        for *_, c in own:
            total.update(c)
            docs_of.update(c.keys())
        kept = [t for t in total if docs_of[t] >= documents]
        count = {s: Counter() for s in {x[1] for x in own}}
        for _, s, c in own:
            count[s].update(c)
        v, n = len(kept), sum(total[t] for t in kept)
        whole = {s: sum(c[t] for t in kept) + 5 * v for s, c in count.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // whole[s] for t in kept} for s, c in count.items()}
        q = {t: 1 + 10**9 * (total[t] + 5) // (n + 5 * v) for t in kept}
        for s in count:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in count if o != s)
            terms = sorted((q[t] - p[s][t], t) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, item.decode(), -value, rank + 1) for part, rows in (("pair", pairs), ("term", terms)) for rank, (value, item) in enumerate(rows)}
    return out


@pytest.mark.parametrize(("block", "chunk", "slab", "piece"), [(32, 1024, 16, 1 << 22), (2, 3, 2, 64), (1, 1, 1, 7)])
def test_divergence_equals_plain_counting(spark, monkeypatch, block, chunk, slab, piece):
    monkeypatch.setattr(dv, "SLAB", slab)
    monkeypatch.setattr(dv, "PIECE", piece)
    monkeypatch.setattr(dv, "GATHERED", 20)
    rng = random.Random(5)
    terms = [f"t{'abcdefghij'[k % 10] * (k // 10 + 1)}" for k in range(25)] + ["é", "ÉA", "Ab", "aB", "日本"]
    docs = [(rng.choice((" ", "1", "-\n")).join(rng.choices(terms[: rng.randint(3, 30)], k=rng.randint(0, 40))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "c", "ä", "", None, "f"))) for _ in range(150)]
    docs += [(None, "en", "only null"), ("rare words alone", "fr", "x"), ("more rare words", "fr", "y"), ("", "fr", None), ("one", "it", "one")] + [docs[0]] * 3 + [("long" * 50_000 + " tail", "en", "a")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, n int, term string")
    found = [tuple(r) for r in dv.divergence(frame, documents=4, top=6, block=block, chunk=chunk).collect()]
    assert len(found) == len(set(found)) and set(found) == differences(docs, 4, 6)
    assert dv.divergence(frame.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(6)
    rows = [(c := rng.randrange(10**15), c + rng.randrange(1, 10**15)) for _ in range(200)] + [(1, 1), (7, 10**12)]
    want = [1 + 10**9 * c // w for c, w in rows]
    counts, wholes = zip(*rows, strict=True)
    assert dv.shares(dv.np.array(counts), dv.np.array(wholes)).tolist() == want
    assert [r.p for r in spark.createDataFrame(rows, "c long, w long").select(dv._share("c", "w").alias("p")).collect()] == want
