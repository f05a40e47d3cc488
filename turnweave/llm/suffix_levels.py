"""Exact removal of repeated byte strings by a logarithmic family of suffix arrays.

A document is read as UTF-8 bytes. In every window of ``width`` bytes the
``gram``-byte string of least hash is its anchor, so equal windows have equal
anchors at the same place. The suffix array of a batch lists the suffixes that
start at anchors, about one in sixteen bytes, ordered by the gram they begin
with and by the fingerprint of the text that all windows of the anchor cover.

A new batch is sorted together with the levels that exist (a merge scan): equal
neighbours are long matches, and neighbours that share only the gram are
compared window by window over their bytes. What the batch adds becomes a level
of rank 0; two levels of one rank merge into one of the next, so a suffix is
rewritten a logarithmic number of times.

Defined results: null text is empty; a null id is left as it is and never
counts as earlier; rows that share an id do not count as earlier than each
other; texts shorter than ``width`` lose nothing; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import BASE, RangeHash, Texts, mix, signed, sliding_min, texts
from .scratch import Scratch

WIDTH = 50
GRAM = 18
#: Above so many different contexts of one gram, its windows are grouped by Spark, not within one task.
HOT_CONTEXTS = 4096
_LOW = np.uint64(0xFFFFFFFF)


class Anchors:
    """Anchors of some texts: window starts ``first`` to ``last`` belong to the one at ``at``."""

    def __init__(self, t: Texts, width: int, gram: int):
        self.hashes = RangeHash(t.data)
        grams = self.hashes.fixed(gram)
        least = sliding_min((grams * BASE & ~_LOW) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
        at = (least & _LOW).astype(np.int64)
        start = np.arange(len(at))
        text = t.of(start)
        inside = t.offsets[text + 1] - start >= width
        start, at, text = start[inside], at[inside], text[inside]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        i = np.flatnonzero(new)
        self.text, self.at, self.first = text[i], at[i], start[i]
        self.last = start[np.append(i[1:], len(start)) - 1] if len(i) else start
        self.gram = mix(grams[self.at])
        span = self.hashes.raw(self.first, self.last + width)
        self.context = mix(span + (self.at - self.first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _own(text: np.ndarray, gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One key for a suffix of one text of a chunk."""
    return mix(mix(gram + text.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) ^ context)


def _suffixes(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for t in texts(b.column(1)):
                a = Anchors(t, width, gram)
                _, keep = np.unique(_own(a.text, a.gram, a.context), return_index=True)
                yield pa.record_batch(
                    [signed(a.gram[keep]), signed(a.context[keep]), pa.array(ids[t.rows][a.text[keep]])],
                    names=["gram", "context", "doc"],
                )

    return run


def _lookup(b: pa.RecordBatch, t: Texts, a: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor whose suffix the row's list ``hits`` names: its index, and the list's entry."""
    hits = b.column(2).slice(t.rows.start, t.rows.stop - t.rows.start)
    flat = hits.flatten()
    row = np.repeat(np.arange(len(hits)), hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    column = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
    keys = _own(row, column["gram"].view(np.uint64), column["context"].view(np.uint64))
    order = np.argsort(keys)
    keys = keys[order]
    own = _own(a.text, a.gram, a.context)
    place = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
    found = np.flatnonzero(keys[place] == own) if len(keys) else np.empty(0, dtype=np.int64)
    return found, column["mask"][order][place[found]] if len(keys) else found


def _contexts(width: int, gram: int):
    """The bytes of the contexts that ``hits`` names, once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for t in texts(b.column(1)):
                a = Anchors(t, width, gram)
                found, hot = _lookup(b, t, a)
                own = _own(a.text[found], a.gram[found], a.context[found])
                _, once = np.unique(own, return_index=True)
                found, hot = found[once], hot[once]
                data = t.data.tobytes()
                yield pa.record_batch(
                    [
                        signed(a.gram[found]), signed(a.context[found]), pa.array(ids[t.rows][a.text[found]]), pa.array(hot != 0),
                        pa.array([data[i:j] for i, j in zip(a.first[found], a.last[found] + width)], pa.binary()),
                    ],
                    names=["gram", "context", "doc", "hot", "bytes"],
                )

    return run


def _windows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context's windows: index of the context, place in it, hash."""
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    n = np.array([len(x) for x in column.to_pylist()], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    count = n - width + 1
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + place
    return row, place, mix(RangeHash(data).raw(start, start + width))


def _compare(width: int):
    """Masks of repeated windows, for contexts sorted by gram. A gram's contexts are few: others go another way."""

    def masks(b: pa.Table) -> pa.RecordBatch:
        row, place, hashes = _windows(b.column("bytes").combine_chunks(), width)
        gram = b.column("gram").to_numpy()
        doc = b.column("doc").to_numpy()
        hashes = mix(hashes ^ gram.view(np.uint64)[row])
        order = np.lexsort((doc[row], hashes))
        h, d = hashes[order], doc[row][order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else d
        again = order[d > least]
        mask = np.zeros(len(gram), dtype=np.int64)
        np.bitwise_or.at(mask, row[again], np.int64(1) << place[again])
        keep = np.flatnonzero(mask)
        return pa.record_batch([b.column("doc").take(keep).combine_chunks(), b.column("gram").take(keep).combine_chunks(), b.column("context").take(keep).combine_chunks(), pa.array(mask[keep])], names=["doc", "gram", "context", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            gram = t.column("gram").to_numpy()
            whole = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0  # the last gram may go on
            rest = t.slice(whole)
            yield from _by_gram(t.slice(0, whole), masks)
        if rest is not None:
            yield from _by_gram(rest, masks)

    return run


def _by_gram(t: pa.Table, masks, rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    gram = t.column("gram").to_numpy()
    i = 0
    while i < len(gram):
        j = min(i + rows, len(gram))
        j = int(np.searchsorted(gram, gram[j - 1], side="right"))
        yield masks(t.slice(i, j - i))
        i = j


def _exploded(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, place, hashes = _windows(b.column("bytes"), width)
            take = pa.array(row)
            yield pa.record_batch([b.column("doc").take(take), b.column("gram").take(take), b.column("context").take(take), pa.array(np.int64(1) << place), signed(hashes)], names=["doc", "gram", "context", "mask", "window"])

    return run


def _cut(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column(1)):
                a = Anchors(t, width, gram)
                found, mask = _lookup(b, t, a)
                gone = np.zeros(len(t.data) + 1, dtype=np.int32)
                for bit in range(width - gram + 1):
                    at = a.first[found] + bit
                    at = at[((mask >> bit) & 1 == 1) & (at <= a.last[found])]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + width, -1)
                gone = np.cumsum(gone[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = t.offsets[(t.offsets > 0) & (t.offsets < len(gone))]
                begins[inner] |= gone[inner]
                out = [[], [], [], []]
                for i, j in zip(t.offsets[:-1], t.offsets[1:]):
                    out[0].append(j - i)
                    out[1].append(int(gone[i:j].sum()))
                    out[2].append(int(begins[i:j].sum()))
                    out[3].append(t.data[i:j][~gone[i:j]].tobytes())
                yield pa.record_batch(
                    [b.column(0).slice(t.rows.start, t.rows.stop - t.rows.start), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array([hashlib.sha256(x).hexdigest() for x in out[3]]), pa.array(out[3], pa.binary())],
                    names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


class SuffixLevels:
    """The index: batches go in by ``append``, which returns their long matches.

    ``append`` gives rows (doc, gram, context, mask): mask -1 where the whole
    context of the suffix occurs in an earlier document, 0 or 1 where it shares
    only its gram with another (1: with very many others) and its bytes decide.
    """

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, scratch: Scratch | None = None):
        if not 0 < gram <= width or width - gram > 62:
            raise ValueError("a gram is at most as long as a window, and at most 62 bytes shorter")
        self.width, self.gram, self.scratch = width, gram, scratch or Scratch(spark, "suffix-levels")
        self.levels: list[tuple[int, str, DataFrame]] = []
        self._count = 0

    def append(self, batch: DataFrame, doc: str, text: str, last: bool = False) -> DataFrame:
        """Compare a batch, whose ids are larger than those of all batches before, and index it unless it is the last."""
        self._merge()
        suffixes = batch.select(F.col(doc).cast("long"), F.col(text)).where(F.col(doc).isNotNull())
        rows = suffixes.mapInArrow(_suffixes(self.width, self.gram), "gram long, context long, doc long").withColumn("new", F.lit(True))
        for _, _, level in self.levels:
            rows = rows.unionByName(level.withColumn("new", F.lit(False)))
        whole = W.partitionBy("gram").orderBy("context").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        rows = rows.withColumns({
            "shared": (F.min("doc").over(whole) < F.max("doc").over(whole)) & F.max("new").over(whole),
            "differ": F.min("context").over(whole) != F.max("context").over(whole),
        })
        if last:
            rows = rows.where("shared")
        peers = W.partitionBy("gram", "context")
        rows = rows.withColumns({"first": F.min("doc").over(peers), "old": F.max(~F.col("new")).over(peers)})
        again = F.col("new") & (F.col("doc") > F.col("first"))
        unsure = (F.col("doc") == F.col("first")) & F.col("shared") & F.col("differ")
        adds = F.lit(not last) & F.col("new") & ~F.col("old") & (F.col("doc") == F.col("first"))
        scan = rows.where(again | unsure | adds).select("gram", "context", "doc", again.alias("again"), unsure.alias("unsure"), adds.alias("adds"))
        label = f"batch-{self._count}"
        self._count += 1
        scan = self.scratch.keep(scan, label)
        hits = scan.where("again or unsure").select("doc", "gram", "context", F.when(F.col("again"), -1).otherwise(0).cast("long").alias("mask"))
        if last:
            return hits
        self.levels.append((0, label, scan.where("adds").select("gram", "context", "doc")))
        return self.scratch.keep(hits, f"hits-{label}")

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, one, a), (_, other, b) = self.levels[-2:]
            label = f"level-{self._count}"
            self._count += 1
            both = a.unionByName(b).repartition("gram").sortWithinPartitions("gram", "context")
            self.levels[-2:] = [(rank + 1, label, self.scratch.keep(both, label))]
            self.scratch.drop(one, other)


def _listed(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc").agg(F.collect_list(F.struct("gram", "context", "mask")).alias("hits"))


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = 3, hot: int = HOT_CONTEXTS) -> DataFrame:
    """Remove each byte that a ``width``-byte string covers which also starts in a document of smaller id.

    Returns doc, n_bytes, n_removed, n_spans, kept_sha256, and kept, the bytes left.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "remove-repeats")
    index = SuffixLevels(spark, width, gram, scratch)
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    cuts = rows.select(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    bounds: list[int] = sorted(set(cuts or []))
    hits = None
    for i in range(len(bounds) + 1):
        inside: Column = F.lit(True)
        if i:
            inside &= F.col("doc") > bounds[i - 1]
        if i < len(bounds):
            inside &= F.col("doc") <= bounds[i]
        found = index.append(rows.where(inside), "doc", "text", last=i == len(bounds))
        hits = found if hits is None else hits.unionByName(found)
    hits = scratch.keep(hits, "hits")
    scratch.drop(*(f"{kind}-{i}" for kind in ("batch", "level", "hits-batch") for i in range(index._count)))
    whole, unsure = hits.where("mask = -1"), hits.where("mask = 0").select("doc", "gram", "context").distinct()
    frequent = unsure.groupBy("gram").count().where(F.col("count") > hot).select("gram", F.lit(1).cast("long").alias("mask"))
    unsure = unsure.join(frequent, "gram", "left").fillna(0, ["mask"])
    known = rows.where("doc is not null")
    contexts = known.join(_listed(unsure), "doc").select("doc", "text", "hits").mapInArrow(_contexts(width, gram), "gram long, context long, doc long, hot boolean, bytes binary")
    contexts = scratch.keep(contexts, "contexts")
    cold = contexts.where("not hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare(width), "doc long, gram long, context long, mask long")
    windows = contexts.where("hot").mapInArrow(_exploded(width), "doc long, gram long, context long, mask long, window long")
    least = windows.groupBy("gram", "window").agg(F.min("doc").alias("least"))
    warm = windows.join(least, ["gram", "window"]).where("doc > least").groupBy("doc", "gram", "context").agg(F.bit_or("mask").alias("mask"))
    masks = scratch.keep(_listed(whole.unionByName(cold).unionByName(warm)), "masks")
    scratch.drop("hits", "contexts")
    out = known.join(masks, "doc", "left").unionByName(rows.where("doc is null").withColumn("hits", F.lit(None).cast(masks.schema["hits"].dataType)))
    out = out.select("doc", "text", "hits").mapInArrow(_cut(width, gram), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("doc", doc)
