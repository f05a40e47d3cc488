"""Quality classifier: a document's own evidence, combined with its host's and path's.

A classifier over word and format features is fitted on a bounded sample of
labelled documents; good means of quality 1 and not toxic. Its calibrated
probabilities are summed by host and by path over all documents. Hosts shrink
toward the global share and paths toward their host, each by as many pseudo-
documents as the spread of the shares above them suggests (method of moments), so
sparse sites stay near their prior. A document's posterior is its own evidence
times the odds that its path has, by its other documents, over the global odds.

Words are counted where the sample is; the driver gets counts by word, of which
there are 2 ** ``BITS`` at most, and a few numbers of each sampled document.

Defined results: null text is empty; null host or path is a site of its own;
repeated rows count each; of repeated labels the worst holds; labels of one kind
only, or none, fit no classifier and keep all; from the first label of each kind on
there is one, which a prior keeps near "good" while labels are few; columns named like those added are
replaced, and ones named ``_host``, ``_path``, ``_logit``, ``_p``, ``_text`` or with ``_s_`` before a name of ``sites`` dropped; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import Texts, texts, words
from .scratch import Scratch

#: Labelled documents that the classifier sees, on average; a hash of their ids chooses them.
SAMPLE = 20_000
#: Words are known by a hash of so many bits.
BITS = 18
#: Up to so many sites their table is broadcast, else joined as it is.
FEW_SITES = 20_000
THRESHOLD = 0.5
#: Prior: good documents without features that the classifier sees besides the sampled ones, weight of small weights, spread of features.
GOOD, SMALL, SPREAD = 10.0, 20.0, 0.05
_TOP = 3


def _count(t: Texts, mask: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[t.offsets[1:]] - total[t.offsets[:-1]]).astype(np.float64)


def _features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Format features of each text; text and hash of each of its different words."""
    w = words(t)
    n = len(t.offsets) - 1
    d = t.data
    upper, lower = (d >= 65) & (d <= 90), ((d >= 97) & (d <= 122)) | (d >= 128)
    mark = (d > 32) & (d < 127) & ~upper & ~((d >= 97) & (d <= 122)) & ~((d >= 48) & (d <= 57))
    size = np.maximum(t.offsets[1:] - t.offsets[:-1], 1).astype(np.float64)
    count = np.bincount(w.text, minlength=n).astype(np.float64)
    order = np.lexsort((w.hash, w.text))
    text, hashes = w.text[order], w.hash[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    repeat = np.zeros(len(w.text), dtype=bool)
    repeat[1:] = (w.text[1:] == w.text[:-1]) & (w.hash[1:] == w.hash[:-1])
    some = np.maximum(count, 1)
    format_ = np.stack([
        _count(t, upper) / np.maximum(_count(t, upper | lower), 1), _count(t, mark) / size, _count(t, (d >= 48) & (d <= 57)) / size, np.minimum(size / some, 40) / 10,
        np.bincount(text, minlength=n) / some, np.bincount(w.text[repeat], minlength=n) / some, np.log1p(count) / 5, _count(t, d == 10) / some, (count == 0).astype(np.float64),
    ], axis=1)
    return format_, text, (hashes >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Classifier:
    """Log-odds of words, and weights over format features and the words' evidence."""

    odds: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    scale: np.ndarray

    def logit(self, format_: np.ndarray, text: np.ndarray, word: np.ndarray) -> np.ndarray:
        x = (np.concatenate([format_, _evidence(self.odds, len(format_), text, word)], axis=1) - self.middle) / self.scale
        return np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)


def _evidence(odds: np.ndarray, n: int, text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The strongest words against each text, and the mean of all."""
    value = odds[word]
    order = np.lexsort((-value, text))
    begin = np.searchsorted(text[order], np.arange(n))
    top = np.arange(len(text)) - begin[text[order]] < _TOP
    strong = np.bincount(text[order][top], np.maximum(value[order][top], 0), n)
    mean = np.bincount(text, value, n) / np.maximum(np.bincount(text, minlength=n), 1)
    return np.stack([strong, mean], axis=1)


def _odds(in_bad: np.ndarray, in_good: np.ndarray, bad: int, good: int) -> np.ndarray:
    """Log-odds of each word in bad texts, by how many bad and good ones have it; 0 for rare words."""
    odds = np.log((in_bad + 0.5) / (bad + 1)) - np.log((in_good + 0.5) / (good + 1))
    return np.where(in_bad + in_good >= 3, odds, 0.0).astype(np.float32)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in texts(b.column(0)):
            format_, text, word = _features(t)
            ends = np.searchsorted(text, np.arange(len(format_) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word.astype(np.int32)))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, format_.size + 1, format_.shape[1]), pa.int32()), pa.array(format_.ravel()))
            yield pa.record_batch([rows, lists, *(b.column(c).slice(t.rows.start, len(format_)) for c in (1, 2))], names=["format", "words", "bad", "half"])


def _weighed(odds: list[np.ndarray]):
    """Each sampled text's features; the evidence of its words by the odds that the other half gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            word = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy())
            half = b.column(3).to_numpy()
            both = [_evidence(odds[1 - h], len(b), owner, word) for h in (0, 1)]
            x = np.concatenate([b.column(0).flatten().to_numpy().reshape(len(b), -1), np.where(half[:, None] == 0, *both)], axis=1)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())), b.column(2)], names=["x", "bad"])

    return run


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Classifier | None:
    known = labels.where("quality is not null or toxic is not null").groupBy(F.col(doc).alias("doc")).agg(F.greatest(F.max(F.col("toxic") == 1), F.max(F.col("quality") == 0)).alias("bad")).where("doc is not null and bad is not null")
    share = min(1.0, sample / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("quality"), "doc"), F.lit(1 << 20)) < int(share * (1 << 20)))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc"), F.lit(2)).cast("int").alias("half")
    joined = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "doc").select("text", "bad", half)
    rows = Scratch(docs.sparkSession, "quality-fit").keep(joined.mapInArrow(_sampled, "format array<double>, words array<int>, bad boolean, half int"), "sample")
    sizes = np.zeros((2, 2), dtype=np.int64)
    for r in rows.groupBy("half", "bad").count().collect():
        sizes[r["half"], int(r["bad"])] = r["count"]
    if not sizes[:, 1].sum() or not sizes[:, 0].sum():
        return None
    has = lambda h, bad: F.sum(((F.col("half") == h) & (F.col("bad") == F.lit(bool(bad)))).cast("long"))
    counts = rows.select("half", "bad", F.explode("words").alias("word")).groupBy("word").agg(*(has(h, bad).alias(f"n{h}{bad}") for h in (0, 1) for bad in (0, 1))).toArrow()
    table = np.zeros((2, 2, 1 << BITS), dtype=np.int64)
    for h in (0, 1):
        for bad in (0, 1):
            table[h, bad][counts.column("word").to_numpy()] = counts.column(f"n{h}{bad}").to_numpy()
    halves = [_odds(table[h, 1], table[h, 0], *sizes[h, ::-1]) for h in (0, 1)]
    odds = _odds(*table.sum(axis=0)[::-1], *sizes.sum(axis=0)[::-1])
    found = rows.mapInArrow(_weighed(halves), "x array<double>, bad boolean").toArrow()
    bad = np.asarray(found.column("bad").to_numpy(), dtype=bool)
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(len(bad), -1)
    # In an order of their own content, so that reruns add up alike.
    order = np.lexsort((bad, *x.T))
    x, bad = x[order], bad[order]
    n = len(x)
    middle, scale = x.mean(axis=0), np.sqrt((n * x.var(axis=0) + GOOD * SPREAD**2) / (n + GOOD))
    z = np.concatenate([np.ones((n, 1)), (x - middle) / scale], axis=1)
    y = (~bad).astype(np.float64)
    weights = np.zeros(z.shape[1])
    ridge = np.eye(len(weights)) * (0.05 + SMALL / n)
    ridge[0, 0] = 1e-6
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope, curve = z.T @ (y - p) - ridge @ weights, (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge
        prior = 1 / (1 + np.exp(-np.clip(weights[0], -30, 30)))
        slope[0] += GOOD * (1 - prior)
        curve[0, 0] += GOOD * prior * (1 - prior)
        weights = weights + np.linalg.solve(curve, slope)
    return Classifier(odds, weights, middle, scale)


def _logits(docs: DataFrame, model: Classifier, text: str) -> DataFrame:
    """``docs`` with ``_logit``, the document's own evidence."""
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast((model.odds, model.weights, model.middle, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classifier(*sent.value)
        for b in batches:
            parts = [known.logit(*_features(t)) for t in texts(b.column(at))]
            values = pa.array(np.concatenate(parts) if parts else np.empty(0))
            yield pa.RecordBatch.from_arrays([*b.columns, values], names=[*b.schema.names, "_logit"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_logit", T.DoubleType())]))


def sites(scored: DataFrame) -> DataFrame:
    """Rows (host, path, p_site, p_all, good, n, host_good, host_n, k_host, k_path) from rows (host, path, p): a site's share, and what it was made of."""
    paths = scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").alias("n"), F.sum(F.col("p") * (1 - F.col("p"))).alias("noise"))
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(f"host_{c}") for c in ("good", "n", "noise")))
    total = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    share = float(np.clip(total["good"] / total["n"], 1e-4, 1 - 1e-4)) if total["n"] else 0.5

    def strength(rows: DataFrame, good: Column, n: Column, prior: Column) -> float:
        """Pseudo-documents of a prior: what the shares vary beyond what chance explains."""
        r = rows.agg(F.sum(n * (good / n - prior) ** 2).alias("spread"), F.sum(prior * (1 - prior)).alias("chance"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), F.count("*").alias("k")).first()
        if not r["k"] or r["n"] == r["k"]:
            return 100.0
        between = max((r["spread"] - r["chance"]) / max(r["n"] - r["k"], 1), 1e-6)
        return float(np.clip(share * (1 - share) / between - 1, 1.0, 10_000.0))

    k_host = strength(hosts, F.col("host_good"), F.col("host_n"), F.lit(share))
    hosts = hosts.select(F.col("host").alias("of_host"), "host_good", "host_n", ((F.col("host_good") + k_host * share) / (F.col("host_n") + k_host)).alias("p_host"))
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["of_host"]))
    k_path = strength(both, F.col("good"), F.col("n"), F.col("p_host"))
    return both.select("host", "path", ((F.col("good") + k_path * F.col("p_host")) / (F.col("n") + k_path)).alias("p_site"), F.lit(share).alias("p_all"), "good", "n", "host_good", "host_n", F.lit(k_host).alias("k_host"), F.lit(k_path).alias("k_path"))


def keep_good(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = THRESHOLD, sample: int = SAMPLE, carry: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose posterior is at least ``threshold``, with p_doc, p_site and posterior added.

    ``carry``: columns of ``docs`` to return, all unless given.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("p_doc", "p_site", "posterior", "_host", "_path", "_logit", "_p", "_text") and not c.startswith("_s_")]
    model = fit(docs, labels, doc, text, sample)
    if model is None:
        return docs.select(*carry, *(F.lit(1.0).alias(c) for c in ("p_doc", "p_site", "posterior")))
    scratch = Scratch(docs.sparkSession, "site-bayes")
    read = text if text in carry else "_text"
    own = docs.select(F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path"), *([] if text in carry else [F.col(text).alias(read)]), *carry)
    # Texts are read once: what they say is kept with the columns that are returned.
    scored = scratch.keep(_logits(own, model, read).drop("_text").withColumn("_p", 1 / (1 + F.exp(-F.col("_logit")))), "scored")
    site = scratch.keep(sites(scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_p").alias("p"))), "sites")
    site = site.drop("p_site").withColumnsRenamed({c: f"_s_{c}" for c in site.columns if c != "p_site"})
    near = F.broadcast(site) if site.count() <= FEW_SITES else site
    joined = scored.join(near, F.col("_host").eqNullSafe(F.col("_s_host")) & F.col("_path").eqNullSafe(F.col("_s_path")))
    # The site's share by its other documents: the document's own evidence counts once.
    at = lambda c: F.col(f"_s_{c}")
    p_host = (at("host_good") - F.col("_p") + at("k_host") * at("p_all")) / (at("host_n") - 1 + at("k_host"))
    p_site = (at("good") - F.col("_p") + at("k_path") * p_host) / (at("n") - 1 + at("k_path"))
    odds = lambda p: F.log(p / (1 - p))
    bound = lambda p: F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    out = joined.withColumns({"p_doc": F.col("_p"), "p_site": p_site})
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(F.col("_logit") + odds(bound(F.col("p_site"))) - odds(bound(at("p_all")))))))
    return out.where(F.col("posterior") >= threshold).select(*carry, "p_doc", "p_site", "posterior")
