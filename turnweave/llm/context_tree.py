"""Log probabilities of texts by context-tree weighting over bytes, and by word frequencies.

A byte is eight binary decisions, each with a tree of contexts of its own: the last 0 to ``DEPTH`` bytes. A
context holds how often the decision went either way in the training texts, and its Krichevsky-Trofimov estimate.
Weighting mixes all depths: a node's weighted probability is half its own estimate and half the product of
its children's, so the share that a prediction takes from a depth is the one the training texts earn it.
A prediction starts at the deepest context seen in training; a text's log10 probability is the sum over its
bytes and one end, and gives the code length per byte.

Everything that the trees need is in the counts of runs of ``DEPTH + 1`` bytes (grams), and a byte's probability
depends on its gram alone. So texts are dealt out to buckets by a hash of their rows; a bucket counts
its distinct grams and words; counts of all buckets meet by a hash of the gram, never by a frequent context; trees
are folded up from the leaves and down from the root level by level, in groups of one context's children (at most
256 contexts of 255 decisions); and each bucket gets back the values of its own grams, with which its texts
are scored. What moves are the texts, twice, and each bucket's distinct grams. Texts stream through a task; what a
task holds are the distinct grams of a bucket, or a share of all.

Words are compared by 64-bit hashes. The base score adds one to each count: ``log10((c + 1) / (N + V + 1))``.

Defined results: null text is empty: one end, no word; a null id counts as the empty string where rows are
split into training and held-out; rows that repeat count each; very long texts are read piece by piece; other
columns aren't read, whatever their names; without training rows each decision has probability one half; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .scratch import Scratch

#: Bytes of the longest context, and of the contexts up to which trees are folded within one task.
DEPTH, SHARED = 5, 3
#: Stands before and after each text; no UTF-8 text holds it.
END = b"\xff"
#: Text of a bucket; more at more than ``MOST`` buckets, less where there would be fewer than ``LEAST``.
BUCKET_BYTES, LEAST, MOST = 32 << 20, 12, 100_000
#: Most shares that grams and words are dealt out to.
SHARES = 4096
#: Bytes that are handled at once, and counts that are gathered before equal ones are added up.
PIECE, GATHERED = 1 << 20, 1 << 21
#: What is counted.
GRAM, WORD = 0, 1
#: Texts and lists are long: fewer of them in a batch between Spark and Python than Spark's own limits have.
BATCHES = {"spark__sql__execution__arrow__maxBytesPerBatch": str(8 << 20)}


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """In pieces: the gram that ends at each byte and at each text's end, where those of each text begin, which of them are none, and the first text."""
    data = np.frombuffer(END * DEPTH + (END * (DEPTH + 1)).join(texts) + END, dtype=np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 + DEPTH for t in texts)])[:-1]
    n = len(data) - DEPTH
    for low in range(0, n, PIECE):
        high = min(n, low + PIECE)
        key = np.zeros(high - low, dtype=np.uint64)
        for j in range(DEPTH + 1):
            key = key << np.uint64(8) | data[low + j : high + j]
        first = int(np.searchsorted(starts, low, side="right")) - 1
        own = starts[(starts > low) & (starts < high)] - low
        pads = (starts[(starts > low) & (starts < high + DEPTH)][:, None] - low - DEPTH + np.arange(DEPTH)).ravel()
        yield key, np.append(0, own), pads[(pads >= 0) & (pads < high - low)], first


def words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In pieces: the hash of each word and its text's index."""
    def pieces() -> Iterator[tuple[int, bytes]]:
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = at + PIECE
                while cut < len(text) and text[cut] not in b" \t\n\v\f\r":
                    cut += 1
                yield i, text[at:cut]
                at = cut

    held, size = [], 0
    for piece in [*pieces(), None]:
        if piece is not None:
            held.append(piece)
            size += len(piece[1])
        if held and (piece is None or size >= PIECE):
            ends = np.cumsum([0, *(len(p) for _, p in held)])
            w = hashing.words(hashing.Texts(slice(0, len(held)), np.frombuffer(b"".join(p for _, p in held), dtype=np.uint8), ends))
            yield w.hash, np.array([i for i, _ in held])[w.text]
            held, size = [], 0


class Tally:
    """Counts by key; equal keys are added up whenever ``GATHERED`` have come together."""

    def __init__(self):
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []
        self._new = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._parts.append((keys, counts))
        self._new += len(keys)
        if self._new >= GATHERED:
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and their counts."""
        if len(self._parts) != 1 or self._new:
            keys = np.concatenate([np.empty(0, np.uint64), *(k for k, _ in self._parts)])
            counts = np.concatenate([np.empty(0, np.int64), *(c for _, c in self._parts)])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
            self._parts = [(keys[new], np.add.reduceat(counts, new) if len(new) else counts)]
            self._new = 0
        return self._parts[0]


class Lookup:
    """Values of keys that are all known, by a table of slots."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, int(2 * len(keys)).bit_length())
        self._shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self._keys, self._values = keys[order], values[order]
        self._start = np.searchsorted(slot[order], np.arange(1 << bits, dtype=np.uint64)).astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * hashing.BASE >> self._shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._start[self._slot(keys)]
        apart = np.flatnonzero(self._keys[at] != keys)
        while len(apart):
            at[apart] += 1
            apart = apart[self._keys[at[apart]] != keys[apart]]
        return self._values[at]


def _lists(x: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, kind))


def _split(by: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Columns in order of ``by``: its values, the ends of each, and the columns."""
    order = np.argsort(by, kind="stable")
    by = by[order]
    new = np.flatnonzero(np.append(True, by[1:] != by[:-1]))[: len(by)]
    return by[new], np.append(new, len(by)), [c[order] for c in columns]


def _flat(column: pa.ChunkedArray | pa.Array, kind=np.uint64) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False)
    return x.view(np.uint64) if kind is np.uint64 else x


def _share(keys: np.ndarray, shares: int) -> np.ndarray:
    return (hashing.mix(keys) % np.uint64(shares)).astype(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch's rows with their texts, about ``PIECE`` bytes at a time."""
    group = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)) // PIECE
    cuts = [*np.flatnonzero(np.append(True, group[1:] != group[:-1]))[: len(batch)].tolist(), len(batch)]
    for low, high in zip(cuts, cuts[1:]):
        part = batch.slice(low, high - low)
        yield part, part["text"].cast(pa.binary()).to_pylist()


def _counted(shares: int):
    """A bucket's distinct grams and words with their counts in training, by share: rows (id, bucket, keys, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Tally(), Tally()
        bucket = None
        for batch in batches:
            if not len(batch):
                continue
            bucket = batch["bucket"][0].as_py()
            for train in (True, False):
                for _, texts in _parts(batch.filter(pc.equal(batch["train"], train))):
                    for tally, found in zip(tallies, (_gram_keys(texts), (w for w, _ in words(texts))), strict=True):
                        for keys in found:
                            distinct, counts = np.unique(keys, return_counts=True)
                            tally.add(distinct, counts if train else np.zeros_like(counts))
        for kind, tally in zip((GRAM, WORD), tallies, strict=True):
            keys, counts = tally.result() if bucket is not None else (np.empty(0, np.uint64),) * 2
            if len(keys):
                by, ends, (keys, counts) = _split(_share(keys, shares), keys, counts)
                yield pa.record_batch([pa.array(by + kind * shares, pa.int32()), pa.array([bucket] * len(by), pa.int32()), _lists(keys, ends, pa.int64()), _lists(counts, ends, pa.int64())], names=["id", "bucket", "keys", "n"])

    return run


def _gram_keys(texts: list[bytes]) -> Iterator[np.ndarray]:
    for keys, _, pads, _ in grams(texts) if texts else ():
        yield np.delete(keys, pads)


def _summed(shares: int, folds: int):
    """All counts of a share's keys: rows (id, fold, keys, n); a gram's fold goes by its shared context, a word has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, own = Tally(), None
        for batch in batches:
            if len(batch):
                own = batch["id"][0].as_py()
                tally.add(_flat(batch["keys"]), _flat(batch["n"], np.int64))
        if own is None:
            return
        keys, n = tally.result()
        folded = _share(keys >> np.uint64(8) & _mask(SHARED), folds) if own < shares else np.full(len(keys), -1)
        by, ends, (keys, n) = _split(folded, keys, n)
        yield pa.record_batch([pa.array([own] * len(by), pa.int32()), pa.array(by, pa.int32()), _lists(keys, ends, pa.int64()), _lists(n, ends, pa.int64())], names=["id", "fold", "keys", "n"])

    return run


def _mask(depth: int) -> np.uint64:
    return np.uint64((1 << 8 * depth) - 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series eight further on."""
    y = x + 8
    far = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return far - sum(np.log(x + k) for k in range(8))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    return np.where(a + b > 0, log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi), 0.0)


def weighted(a: np.ndarray, b: np.ndarray, kids: np.ndarray) -> np.ndarray:
    return np.logaddexp(estimate(a, b), kids) - math.log(2)


class Folded:
    """The trees above some grams, from the leaves up to the shared context; a node's key is its context and its decision."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        k = np.arange(8)
        symbol = (keys & np.uint64(255)).astype(np.int64)[:, None]
        self.bit = symbol >> 7 - k & 1
        node = 1 << k | symbol >> 8 - k
        self.levels = []
        key, self.leaf = np.unique((keys >> np.uint64(8) << np.uint64(8))[:, None] | node.astype(np.uint64), return_inverse=True)
        self.leaf = self.leaf.reshape(-1, 8)
        ones = n[:, None] * self.bit
        a, b = (np.bincount(self.leaf.ravel(), x.ravel(), len(key)) for x in (n[:, None] - ones, ones))
        kids = np.zeros(len(key))
        up = None
        for depth in range(DEPTH, SHARED - 1, -1):
            if depth < DEPTH:
                whole = estimate(a, b) if depth == DEPTH - 1 else weighted(a, b, kids)
                key, up = np.unique((key >> np.uint64(8) & _mask(depth)) << np.uint64(8) | key & np.uint64(255), return_inverse=True)
                a, b, kids = (np.bincount(up, x, len(key)) for x in (a, b, whole))
            self.levels.append((key, a, b, kids, up))


def _down(a, b, kids, mixed, rest, stop, leaf: bool = False):
    """From a parent's (mixed, rest, stop) to a node's: what depths so far give to a one, the share of further ones, the probability if training goes no deeper."""
    one = (b + 0.5) / (a + b + 1)
    stop = np.where(a + b > 0, mixed + rest * one, stop)
    if leaf:
        return None, None, stop
    with np.errstate(over="ignore"):
        share = 1 / (1 + np.exp(kids - estimate(a, b)))
    return mixed + rest * share * one, rest * (1 - share), stop


LEVEL = "ctx long, nodes array<int>, a array<long>, b array<long>, kids array<double>"
PATHS = "fold int, ctx long, nodes array<int>, mixed array<double>, rest array<double>, stop array<double>"


def _rows(key: np.ndarray, a: np.ndarray, b: np.ndarray, kids: np.ndarray) -> pa.Table:
    by, ends, (key, a, b, kids) = _split((key >> np.uint64(8)).astype(np.int64), key, a, b, kids)
    return pa.table({
        "ctx": pa.array(by, pa.int64()), "nodes": _lists((key & np.uint64(255)).astype(np.int32), ends, pa.int32()), "a": _lists(a.astype(np.int64), ends, pa.int64()), "b": _lists(b.astype(np.int64), ends, pa.int64()), "kids": _lists(kids, ends, pa.float64()),
    })


def _fold(table: pa.Table) -> pa.Table:
    """The shared contexts above a fold's grams."""
    key, a, b, kids, _ = Folded(_flat(table["keys"]), _flat(table["n"], np.int64)).levels[-1]
    return _rows(key, a, b, kids)


def _up(depth: int):
    """One context from its children."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ctx")
        parent = np.uint64(table["ctx"][0].as_py()) & _mask(depth)
        a, b, kids = _flat(table["a"], np.int64), _flat(table["b"], np.int64), _flat(table["kids"], float)
        node, at = np.unique(_flat(table["nodes"], int), return_inverse=True)
        sums = [np.bincount(at, x, len(node)) for x in (a, b, weighted(a, b, kids))]
        return _rows(parent << np.uint64(8) | node.astype(np.uint64), *sums)

    return run


def _paths(folds: int):
    """Rows of a level, each with its parent's row (none at the root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own, above = batch["nodes"], batch["p_nodes"]
            n = own.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(batch)), n) * 256 + _flat(own, int)
            mixed, rest, stop = np.zeros(len(of)), np.ones(len(of)), np.full(len(of), 0.5)
            if above.null_count < len(above):
                keys = np.repeat(np.arange(len(batch)), above.value_lengths().to_numpy()) * 256 + _flat(above, int)
                at = np.searchsorted(keys, of)
                mixed, rest, stop = (_flat(batch[c], float)[at] for c in ("p_mixed", "p_rest", "p_stop"))
            found = _down(_flat(batch["a"], np.int64), _flat(batch["b"], np.int64), _flat(batch["kids"], float), mixed, rest, stop)
            ends = np.append(0, np.cumsum(n))
            fold = _share(batch["ctx"].to_numpy().view(np.uint64), folds)
            yield pa.record_batch([pa.array(fold, pa.int32()), batch["ctx"], _lists(_flat(own, int), ends, pa.int32()), *(_lists(x, ends, pa.float64()) for x in found)], names=["fold", "ctx", "nodes", "mixed", "rest", "stop"])

    return run


def _valued(shares: int):
    """A fold's grams with the log10 probability of their last byte: rows (id, keys, v)."""

    def run(table: pa.Table) -> pa.Table:
        above = table.filter(pc.is_valid(table["ctx"])).sort_by("ctx")
        keys = _flat(table["keys"])
        tree = Folded(keys, _flat(table["n"], np.int64))
        known = np.repeat(above["ctx"].to_numpy().view(np.uint64), above["nodes"].combine_chunks().value_lengths().to_numpy()) << np.uint64(8) | _flat(above["nodes"], int).astype(np.uint64)
        mixed, rest, stop = (_flat(above[c], float) for c in ("mixed", "rest", "stop"))
        at = np.searchsorted(known, tree.levels[-1][0])
        state = mixed[at], rest[at], stop[at]
        for depth in range(SHARED + 1, DEPTH + 1):
            _, a, b, kids, _ = tree.levels[DEPTH - depth]
            up = tree.levels[DEPTH - depth + 1][4]
            state = _down(a, b, kids, *(x[up] for x in state), leaf=depth == DEPTH)
        one = state[2][tree.leaf]
        value = np.log10(np.where(tree.bit == 1, one, 1 - one)).sum(axis=1)
        by, ends, (keys, value) = _split(_share(keys, shares), keys, value)
        return pa.table({"id": pa.array(by, pa.int32()), "keys": _lists(keys, ends, pa.int64()), "v": _lists(value, ends, pa.float64())})

    return run


def _answered(shares: int):
    """Values of each bucket's keys; a share's values come before the buckets that ask for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, lookup = [], [], None
        for batch in batches:
            side = batch["side"].to_numpy()
            known = batch.filter(pa.array(side == 0))
            if len(known):
                keys.append(_flat(known["keys"]))
                values.append(_flat(known["v"], float))
            asked = batch.filter(pa.array(side == 1))
            if not len(asked):
                continue
            lookup = lookup or Lookup(np.concatenate(keys), np.concatenate(values))
            own = _flat(asked["keys"])
            ends = np.append(0, np.cumsum(asked["keys"].value_lengths().to_numpy()))
            kind = pa.array(asked["id"].to_numpy() // shares, pa.int32())
            yield pa.record_batch([asked["bucket"], kind, _lists(own, ends, pa.int64()), _lists(lookup(own), ends, pa.float64())], names=["bucket", "kind", "keys", "v"])

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, train, n_bytes, n_words, known, base, score); a bucket's values come before its texts."""
    held: dict[int, list] = {GRAM: [], WORD: []}
    lookups = None
    for batch in batches:
        side = batch["side"].to_numpy()
        values = batch.filter(pa.array(side == 0))
        for kind in held:
            if len(own := values.filter(pc.equal(values["kind"], kind))):
                held[kind].append((_flat(own["keys"]), _flat(own["v"], float)))
        rows = batch.filter(pa.array(side == 1))
        if not len(rows):
            continue
        if lookups is None:
            lookups = {kind: Lookup(*map(np.concatenate, zip(*parts, strict=True))) if parts else None for kind, parts in held.items()}
            held = {}
        for part, texts in _parts(rows):
            yield _scores(part, texts, lookups)


def _scores(rows: pa.RecordBatch, texts: list[bytes], lookups: dict[int, Lookup]) -> pa.RecordBatch:
    score, base = np.zeros(len(texts)), np.zeros(len(texts))
    n_words, known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for keys, starts, pads, first in grams(texts):
        pad = np.zeros(len(keys), dtype=bool)
        pad[pads] = True
        value = np.zeros(len(keys))
        value[~pad] = lookups[GRAM](keys[~pad])
        sums = np.add.reduceat(value, starts)
        score[first : first + len(sums)] += sums
    for keys, of in words(texts):
        value = lookups[WORD](keys)
        n_words += np.bincount(of, minlength=len(texts))
        known += np.bincount(of, value > 0, len(texts)).astype(np.int64)
        base += np.bincount(of, value, len(texts))
    n_bytes = np.array([len(t) for t in texts], dtype=np.int64)
    return pa.record_batch([rows["doc"], rows["train"], *map(pa.array, (n_bytes, n_words, known, base, score))], names=["doc", "train", "n_bytes", "n_words", "known", "base", "score"])


def is_held_out(doc: Column) -> Column:
    """One row in seven, by a checksum of its id."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tree_scores(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)."""
    scratch = Scratch(docs.sparkSession, "context-tree")
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (~is_held_out(F.col(doc))).alias("train"))
    size, trained = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    buckets = int(min(MOST, max(1, size // BUCKET_BYTES, min(LEAST, size // (1 << 20)))))
    shares = min(SHARES, buckets)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc", "text"), F.lit(buckets)).cast("int"))

    counts = rows.select("bucket", "train", "text").repartitionById(buckets, F.col("bucket"))
    counts = scratch.keep(counts.mapInArrow(_counted(shares), "id int, bucket int, keys array<long>, n array<long>"), "counts", **BATCHES)
    sums = scratch.keep(counts.repartitionById(2 * shares, F.col("id")).mapInArrow(_summed(shares, shares), "id int, fold int, keys array<long>, n array<long>"), "sums", **BATCHES)
    words_n, words_v = sums.where("fold < 0").select(F.explode("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    values = _gram_values(sums.where("fold >= 0").select("fold", "keys", "n"), shares, scratch)
    values = values.unionByName(sums.where("fold < 0").select("id", "keys", F.transform("n", lambda n: F.log10(n + 1)).alias("v")))

    nothing = lambda kind: F.lit(None).cast(kind)
    asked = values.select("id", F.lit(0).alias("side"), nothing("int").alias("bucket"), "keys", "v").unionByName(counts.select("id", F.lit(1).alias("side"), "bucket", "keys", nothing("array<double>").alias("v")))
    answers = asked.repartitionById(2 * shares, F.col("id")).sortWithinPartitions("side").mapInArrow(_answered(shares), "bucket int, kind int, keys array<long>, v array<double>")
    given = scratch.keep(answers, "answers", **BATCHES).select("bucket", F.lit(0).alias("side"), "kind", "keys", "v", nothing(docs.schema[doc].dataType).alias("doc"), nothing("boolean").alias("train"), nothing("string").alias("text"))
    scratch.drop("counts", "sums")
    asking = rows.select("bucket", F.lit(1).alias("side"), nothing("int").alias("kind"), nothing("array<long>").alias("keys"), nothing("array<double>").alias("v"), "doc", "train", "text")
    fields = [T.StructField("doc", docs.schema[doc].dataType), T.StructField("train", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_words", "known")), *(T.StructField(c, T.DoubleType()) for c in ("base", "score"))]
    scored = given.unionByName(asking).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("side").mapInArrow(_scored, T.StructType(fields))
    scored = scratch.keep(scored, "scored", **BATCHES)
    scratch.drop("answers")
    # One end a text: a token that each training text has.
    whole = words_n + trained
    vocabulary = words_v + (1 if trained else 0)
    return scored.select(
        F.col("doc").alias(doc), (~F.col("train")).alias("held_out"), (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + (1 if trained else 0)).alias("n_known"), F.lit(whole).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(trained + 1) - (F.col("n_words") + 1) * math.log10(whole + vocabulary + 1)).alias("base_score"), "score", "n_bytes", (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def _gram_values(counts: DataFrame, shares: int, scratch: Scratch) -> DataFrame:
    """Rows (id, keys, v) for all grams, from rows (fold, keys, n)."""
    levels = {SHARED: scratch.keep(counts.groupBy("fold").applyInArrow(_fold, LEVEL), "level-shared")}
    context = lambda depth: F.col("ctx").bitwiseAND(F.lit((1 << 8 * depth) - 1))
    for depth in range(SHARED - 1, -1, -1):
        levels[depth] = scratch.keep(levels[depth + 1].groupBy(context(depth).alias("parent")).applyInArrow(_up(depth), LEVEL), f"level-{depth}")
    paths = None
    for depth in range(SHARED + 1):
        if paths is None:
            rows = levels[0].withColumns({f"p_{c}": F.lit(None).cast(f"array<{'int' if c == 'nodes' else 'double'}>") for c in ("nodes", "mixed", "rest", "stop")})
        else:
            above = paths.select(F.col("ctx").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in ("nodes", "mixed", "rest", "stop")))
            rows = levels[depth].withColumn("parent", context(depth - 1)).join(above, "parent").drop("parent")
        paths = scratch.keep(rows.mapInArrow(_paths(shares), PATHS), f"paths-{depth}")
    given = paths.select("fold", F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("array<long>").alias("n"), "ctx", "nodes", "mixed", "rest", "stop")
    rows = counts.unionByName(given, allowMissingColumns=True)
    return rows.groupBy("fold").applyInArrow(_valued(shares), "id int, keys array<long>, v array<double>")
