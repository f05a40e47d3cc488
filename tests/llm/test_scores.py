"""Context-tree weighting against a plain one that keeps every node, and base scores against counting."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnweave.llm import context_tree as ct


class Plain:
    """Nodes by (context, decision); weights and predictions by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.kids, self.memo = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for text in texts:
            for context, node, bit in self.steps(text):
                for d in range(depth + 1):
                    self.n[context[depth - d :], node][bit] += 1
                    if d < depth:
                        self.kids[context[depth - d :], node].add(context[depth - d - 1 :])

    def steps(self, text):
        data = b"\xff" * self.depth + text + b"\xff"
        for at in range(self.depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[at] >> k & 1
                yield data[at - self.depth : at], node, bit
                node = node << 1 | bit

    def estimate(self, context, node):
        a, b = self.n[context, node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def whole(self, context, node):
        key = context, node
        if key not in self.memo:
            own = self.estimate(context, node)
            self.memo[key] = own if len(context) == self.depth else math.log(0.5) + np.logaddexp(own, self.below(context, node))
        return self.memo[key]

    def below(self, context, node):
        return sum(self.whole(c, node) for c in self.kids[context, node])

    def one(self, context, node):
        p = 0.5
        for d in range(self.depth, -1, -1):
            c = context[self.depth - d :]
            if (c, node) in self.n and sum(self.n[c, node]):
                a, b = self.n[c, node]
                own = (b + 0.5) / (a + b + 1)
                if d == self.depth or not (context[self.depth - d - 1 :], node) in self.n:
                    p = own
                else:
                    share = 1 / (1 + math.exp(min(700, self.below(c, node) - self.estimate(c, node))))
                    p = share * own + (1 - share) * p
        return p

    def score(self, text):
        return sum(math.log10(p if bit else 1 - p) for context, node, bit in self.steps(text) for p in [self.one(context, node)])


def base(rows):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tokens = [[w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())] + [None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(rows, tokens, strict=True)]


def check(spark, rows, repeats=1):
    frame = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "doc_id long, text string, bucket string, train boolean, n int")
    found = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, round(r.score, 9)), r) for r in ct.tree_scores(frame).collect())
    plain = Plain([(t or "").encode() for (i, t), b in zip(rows, base(rows), strict=True) if not b[0]], ct.DEPTH)
    want = sorted(((i is not None, i or 0, len((t or "").encode()), round(plain.score((t or "").encode()), 9)), b) for (i, t), b in zip(rows, base(rows), strict=True))
    assert len(found) == len(want)
    for (key, r), (other, b) in zip(found, want, strict=True):
        assert key[:3] == other[:3] and key[3] == pytest.approx(other[3], rel=1e-8, abs=1e-8)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == b[:4] and r.base_score == pytest.approx(b[4], rel=1e-9, abs=1e-9)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (r.n_bytes + 1))


def sentences(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "river", "Runs", "slowly", "été", "日本", "to", "sea", "and", "BACK", "x"]
    return [(i, rng.choice((" ", "\n", "  ")).join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize(("buckets", "piece", "gathered"), [(1, 1 << 22, 1 << 22), (5, 37, 50)])
def test_scores_equal_plain_weighting(spark, monkeypatch, buckets, piece, gathered):
    for k, v in (("BUCKET_BYTES", 1 << 20 if buckets == 1 else 900), ("MOST", buckets), ("PIECE", piece), ("GATHERED", gathered)):
        monkeypatch.setattr(ct, k, v)
    rows = sentences(40) + [(None, "no id"), (None, None), (3, None), (7, "")] + [(5, "same row")] * 3 + [(100 + k, "ab" * 60) for k in range(5)] + [(9, " a" * 300), (11, "ÿþ unseen ß")]
    check(spark, rows)


def test_scores_without_training_rows_and_of_empty_tables(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    frame = spark.createDataFrame([(held, "two words")], "doc_id long, text string")
    r = ct.tree_scores(frame).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0) and r.bits_per_byte == pytest.approx(8)
    assert ct.tree_scores(frame.limit(0)).count() == 0


def test_log_gamma_and_lookup():
    x = np.array([0.5, 1, 1.5, 7.25, 1e3, 1e7, 1e12])
    assert ct.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000).astype(np.uint64))
    table = ct.Lookup(keys, np.arange(len(keys)))
    assert (table(np.tile(keys[::-1], 3)) == np.tile(np.arange(len(keys))[::-1], 3)).all()


def test_held_out_texts_take_fewer_bits_than_their_bytes_alone(spark, sf_dir):
    """The trees learn: held-out texts cost little more than half the entropy of their bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = ct.tree_scores(docs).where("held_out").collect()
    size = sum(r.n_bytes + 1 for r in rows)
    counts = Counter(b for r in docs.where(ct.is_held_out(docs.doc_id)).collect() for b in (r.text or "").encode())
    whole = sum(counts.values())
    entropy = -sum(c / whole * math.log2(c / whole) for c in counts.values())
    assert -sum(r.score for r in rows) / math.log10(2) / size < 0.6 * entropy
