"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its ``size``-word shingles (fewer words: one shingle
of all). Every shingle has a Poisson process over (weight, time). Weights are
discretised into shells [0, 1), [1, 2), [2, 4), ...; a shell is a process of its
own at the rate of its width, and a point in it counts when its weight lies
below the shingle's number of copies. A point falls on one of the signature's
places, which keeps its earliest; points come in order of time, so a shell is
left as soon as it is later than the latest place. Two texts agree in a place
with the probability of their weighted Jaccard similarity.

Bands of places propose links. In a band's bucket one text is the centre and
the others are compared with it, so a group of copies makes as many pairs as it
has members. The centre is the text whose buckets hold most texts: among copies
of one text that is the text itself, which all copies resemble. In buckets whose
members then still lie in different components, the texts outside the largest one
are compared with all of it and with each other, in tiles of bounded size; a tile
gives no more links than join its components.

Defined results: equal texts are one class; texts without words are classes of
their own unless equal; null text is left alone as a class of its own; null ids
keep a null class; of rows that share an id one is kept; columns
named like those added are replaced, and ones named ``_doc`` or ``_text`` dropped; an empty table gives none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, shingles, signed, texts, words
from .scratch import Scratch

SIZE = 5
SIMILARITY = 0.8
#: 25 bands of 6 places find a pair of similarity 0.8 with probability 0.9995.
BANDS, ROWS = 25, 6
#: Texts of one side of a tile.
TILE = 256
#: Shares of the documents of one text.
SHARES = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(column: pa.Array, size: int = SIZE) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For chunks of texts: rows, and text, shingle and copies of each different shingle; number of texts."""
    for t in texts(column):
        w = words(t)
        at, hashes = shingles(w, size)
        text = w.text[at]
        count = len(t.offsets) - 1
        short = np.setdiff1d(np.unique(w.text), text)
        if len(short):
            mine = np.isin(w.text, short)
            total = np.zeros(count, dtype=np.uint64)
            np.add.at(total, w.text[mine], mix(w.hash[mine] + w.place[mine].astype(np.uint64) * _STEP))
            text, hashes = np.concatenate([text, short]), np.concatenate([hashes, mix(total[short])])
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        i = np.flatnonzero(new)
        yield t.rows, text[i], hashes[i], np.diff(np.append(i, len(text))), count


def signatures(text: np.ndarray, shingle: np.ndarray, copies: np.ndarray, count: int, places: int) -> np.ndarray:
    """``count`` rows of ``places`` earliest times; infinite for texts without shingles."""
    shells = np.where(copies > 1, np.ceil(np.log2(np.maximum(copies, 2))).astype(np.int64), 0) + 1
    of = np.repeat(np.arange(len(text)), shells)
    shell = np.arange(len(of)) - np.repeat(np.cumsum(shells) - shells, shells)
    low = np.where(shell > 0, 2.0 ** (shell - 1), 0.0)
    width = np.where(shell > 0, low, 1.0)
    text, limit = text[of], copies[of].astype(np.float64)
    state = mix(shingle[of] ^ (shell.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    time = np.zeros(len(of))
    first = np.full(count * places, np.inf)
    latest = np.full(count, np.inf)
    while len(text):
        state = state + _STEP
        draw = mix(state)
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width
        early = time < latest[text]
        text, state, time, low, width, limit, draw = (x[early] for x in (text, state, time, low, width, limit, draw))
        more = mix(draw ^ np.uint64(0x8CB92BA72F3D8DD7))
        weight = low + width * ((more >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        inside = weight < limit
        np.minimum.at(first, text[inside] * places + (more[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) % places, time[inside])
        latest = first.reshape(count, places).max(axis=1)
    return first.reshape(count, places)


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, text, shingle, copies, count in bags(b.column(1), size):
                s = signatures(text, shingle, copies, count, bands * rows)
                full = np.isfinite(s[:, 0])
                bits = s.view(np.uint64).reshape(count, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, (count, bands)).copy()
                for r in range(rows):
                    key = mix(key ^ bits[:, :, r])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]), pa.int32()), signed(np.ascontiguousarray(key[full]).ravel()))
                yield pa.record_batch([b.column(0).slice(part.start, count), b.column(2).slice(part.start, count), lists], names=["doc", "same", "bands"])

    return run


def _bag(column: pa.Array, size: int) -> list[np.ndarray]:
    """Text, shingle and copies of each different shingle of all texts."""
    parts = [(rows.start + text, shingle, copies) for rows, text, shingle, copies, _ in bags(column, size)]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, dtype=k) for k in (np.int64, np.uint64, np.int64)]


def _overlap(size: int, similarity: float):
    """Of pairs (a, b, text_a, text_b) those whose weighted Jaccard similarity is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Pairs come sorted by a, whose text is then read once.
            a = b.column(0).to_numpy(zero_copy_only=False)
            new = np.ones(len(a), dtype=bool)
            new[1:] = a[1:] != a[:-1]
            head = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            ta, sa, ca = _bag(b.column(2).take(pa.array(head)), size)
            tb, sb, cb = _bag(b.column(3), size)
            total_a, total_b = np.bincount(ta, ca, len(head)), np.bincount(tb, cb, len(a))
            key_a = mix(sa + ta.astype(np.uint64) * _STEP)
            key_b = mix(sb + group[tb].astype(np.uint64) * _STEP)
            order = np.argsort(key_a)
            place = np.minimum(np.searchsorted(key_a[order], key_b), max(len(key_a) - 1, 0))
            hit = np.flatnonzero(key_a[order][place] == key_b) if len(key_a) else np.empty(0, dtype=np.int64)
            both = np.bincount(tb[hit], np.minimum(ca[order][place[hit]], cb[hit]), len(a))
            union = total_a[group] + total_b - both
            keep = np.flatnonzero((both >= similarity * union - 1e-9) & (union > 0))
            yield pa.record_batch([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array((both / np.maximum(union, 1))[keep])], names=["a", "b", "similarity"])

    return run


def _similar(row: np.ndarray, shingle: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of rows ``left`` with rows ``right``: a shingle's copies count as shingles of their own."""
    part = np.repeat(np.arange(len(row)), copies)
    copy = np.arange(len(part)) - np.repeat(np.cumsum(copies) - copies, copies)
    row, shingle = row[part], mix(shingle[part] + copy.astype(np.uint64) * _STEP)
    total = np.bincount(row, minlength=n).astype(np.float64)
    _, column, uses = np.unique(shingle, return_inverse=True, return_counts=True)
    common = uses > 1
    number = np.cumsum(common) - 1
    use = common[column]
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)))
    width = 4096
    for first in range(0, int(common.sum()), width):
        i, j = np.searchsorted(column, [first, first + width])
        block = np.zeros((n, width), dtype=np.float32)
        block[row[i:j], column[i:j] - first] = 1
        both += block[left] @ block[right].T
    return both / np.maximum(total[left][:, None] + total[right][None, :] - both, 1)


def _joins(size: int, similarity: float):
    """Links (a, b) that join the components of a tile, from tiles in a row.

    Rows (key, i, j, side, doc, component, text): tile i, j of bucket key holds block i on side 0 and block j on side 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in itertools.chain(batches, [None]):
            t = _joined(rest, b)
            if t is None or not len(t):
                continue
            tile = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            new = np.flatnonzero(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(axis=0)))
            ends = np.append(new[1:], len(t))
            whole = len(new) if b is None else len(new) - 1
            doc, of, side = (t.column(c).to_numpy() for c in ("doc", "component", "side"))
            last = int(ends[whole - 1]) if whole else 0
            text, shingle, copies = _bag(t.column("text").slice(0, last).combine_chunks(), size)
            at = np.searchsorted(text, np.arange(last + 1))
            found = []
            for start, end in zip(new[:whole], ends[:whole]):
                mine = of[start:end]
                if (mine == mine[0]).all():
                    continue
                i, j = at[start], at[end]
                same = tile[1, start] == tile[2, start]
                left = np.arange(end - start) if same else np.flatnonzero(side[start:end] == 0)
                right = left if same else np.flatnonzero(side[start:end] == 1)
                alike = _similar(text[i:j] - start, shingle[i:j], copies[i:j], left, right, end - start) >= similarity - 1e-9
                x, y = np.nonzero(alike & (mine[left][:, None] != mine[right][None, :]))
                if not len(x):
                    continue
                x, y = left[x], right[y]
                _, one = np.unique(np.stack([mine[x], mine[y]]), axis=1, return_index=True)
                head = {c: c for c in mine}

                def top(c):
                    while head[c] != c:  # noqa: B023
                        c = head[c]  # noqa: B023
                    return c

                for k in one:
                    p, q = top(mine[x[k]]), top(mine[y[k]])
                    if p != q:
                        head[max(p, q)] = min(p, q)
                        found.append((doc[start + x[k]], doc[start + y[k]]))
            rest = None if b is None else t.slice(int(new[whole]))
            if found:
                a, z = np.array(found, dtype=np.int64).T
                yield pa.record_batch([pa.array(a), pa.array(z)], names=["a", "b"])

    return run


def _joined(rest: pa.Table | None, b: pa.RecordBatch | None) -> pa.Table | None:
    parts = ([rest] if rest is not None else []) + ([pa.Table.from_batches([b])] if b is not None else [])
    return pa.concat_tables(parts) if parts else None


def _tiles(buckets: DataFrame, labels: DataFrame, tile: int) -> DataFrame:
    """Rows (key, i, j, side, doc, component) of buckets that hold several components, dealt out to tiles.

    The texts outside a bucket's largest component are dealt out to blocks 0, 1, ..., which all meet
    each other; the largest component's blocks are -1, -2, ..., which meet those alone.
    """
    rows = buckets.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", -F.col("component"))).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    blocks = lambda n: F.ceil(n / tile).cast("int")
    largest = largest.select("key", (-F.col("top.col2")).alias("main"), blocks(F.col("top.n")).alias("mains"), blocks(F.col("n") - F.col("top.n")).alias("rests"))
    rows = rows.join(largest, "key")
    main = F.col("component") == F.col("main")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.when(main, F.col("mains")).otherwise(F.col("rests"))).cast("int")).withColumn("block", F.when(main, -1 - F.col("block")).otherwise(F.col("block")))
    # Each block outside is a side of a tile with every block, and both sides of its own.
    other = F.when(main, F.sequence(F.lit(0), F.col("rests") - 1)).otherwise(F.sequence(-F.col("mains"), F.col("rests") - 1))
    rows = rows.withColumn("other", F.explode(other))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "doc", "component")


def _with_texts(tiles: DataFrame, texts_: DataFrame) -> DataFrame:
    return tiles.hint("merge").join(texts_, "doc").select("key", "i", "j", "side", "doc", "component", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _members(signed_: DataFrame) -> DataFrame:
    """Rows (doc, text_id): the smallest id of the documents of equal text. A text's documents are split into shares, so that no task has all of a frequent one's."""
    rows = signed_.select("doc", "same", F.pmod(F.xxhash64("doc"), F.lit(SHARES)).alias("share"))
    shares = rows.groupBy("same", "share").agg(F.min("doc").alias("low"))
    least = shares.groupBy("same").agg(F.min("low").alias("text_id"))
    return rows.join(shares.join(least, "same").select("same", "share", "text_id"), ["same", "share"]).select("doc", "text_id").distinct()


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows (doc, class_id, kept) for each row of ``docs``: the smallest id of its class, and whether it is that one."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    read = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    known = read.where("doc is not null and text is not null").withColumn("same", F.md5("text"))
    signed_ = scratch.keep(known.select("doc", "text", "same").mapInArrow(_sign(size, bands, rows), "doc long, same string, bands array<long>"), "signatures")
    member = scratch.keep(_members(signed_), "members")
    repeats = not signed_.groupBy("doc").count().where("count > 1").isEmpty()
    keys = signed_.join(member.where("doc = text_id").select("doc"), "doc", "left_semi").select("doc", F.explode("bands").alias("key")).distinct()
    buckets = scratch.keep(_shared(keys), "buckets")
    # Only texts that share a bucket are compared. They grow with the corpus, so joins with texts deal out both sides.
    shared = buckets.select("doc").distinct()
    texts_ = scratch.keep(known.select("doc", "text").join(shared.hint("merge"), "doc", "left_semi").dropDuplicates(["doc", "text"]), "texts")

    centre = buckets.groupBy("key").agg(F.max_by("doc", F.struct("degree", -F.col("doc"))).alias("a"))
    pairs = buckets.join(centre, "key").where("a != doc").select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")).distinct()
    first = pairs.hint("merge").join(texts_.withColumnsRenamed({"doc": "a", "text": "text_a"}), "a")
    whole = first.hint("merge").join(texts_.withColumnsRenamed({"doc": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
    star = scratch.keep(whole.mapInArrow(_overlap(size, similarity), "a long, b long, similarity double").select("a", "b").distinct(), "star-links")
    labels = components(star, scratch, "star")
    joins = scratch.keep(_with_texts(_tiles(buckets, labels, TILE), texts_).mapInArrow(_joins(size, similarity), "a long, b long").distinct(), "tile-links")
    labels = components(star.unionByName(joins), scratch)
    scratch.drop("signatures", "texts", "buckets")
    member = member.join(labels.withColumnsRenamed({"node": "text_id"}), "text_id", "left")
    classes = scratch.keep(member.groupBy("doc").agg(F.min(F.coalesce("component", "text_id")).alias("class_id")), "classes")
    out = docs.drop("class_id", "kept").withColumns({"_doc": F.col(doc).cast("long"), "_text": F.col(text).isNotNull()}).join(classes.withColumnRenamed("doc", "_doc"), "_doc", "left")
    out = out.withColumn("class_id", F.when(F.col("_text"), F.col("class_id")).otherwise(F.col("_doc")))
    kept = F.coalesce(F.col("class_id") == F.col("_doc"), F.lit(True))
    if repeats:
        copy = F.row_number().over(W.partitionBy("_doc", F.when(F.col("_doc").isNull(), F.rand(1))).orderBy("_text"))
        kept = kept & ((copy == 1) | F.col("_doc").isNull())
    return out.withColumn("kept", kept).drop("_doc", "_text")


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of buckets with more than one text, with the text's degree: how many texts its buckets hold."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = keys.join(sizes, "key")
    degree = rows.groupBy("doc").agg(F.sum("n").alias("degree"))
    return rows.select("key", "doc").join(degree, "doc")
