"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A bounded sample gives the mean and the principal axes of the unit vectors, and
several rotations of the centred and projected vectors, each learned to bring them
close to their signs. The signs are a binary code, cut into substrings; two vectors
meet in a table where a substring is equal. Substrings grow with the logarithm of
the number of vectors, and there are as many tables as the wanted recall at the
similarity asks for, by the angle that two such vectors have as seen from the mean.
The nearer all vectors lie to the mean, the less a bit tells of a pair; then
substrings are cut short so that ``TABLES`` tables still have the recall, down to
none: vectors that are all similar share one bucket, which is compared in tiles.

In a bucket the original vectors decide, by cosine in double precision. A pair
counts in the first table in which it meets, so each vector's links in all
tables add up, and buckets give counts and links to the smallest id of each
component within them, not pairs.
Large buckets are dealt out in tiles of bounded size. Equal vectors are one
vector with a multiplicity.

Defined results: vectors that are null, zero, of another length, or hold null or
non-finite components link with nothing; null ids keep a null component; rows
that share an id and a vector count each; columns named like those added are
replaced, and one named ``_id`` is dropped; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

COSINE = 0.9
#: Probability that a pair just at the similarity meets in some table.
RECALL = 0.97
#: Vectors that rotations are learned from.
SAMPLE = 5_000
#: Most tables; where the similarity asks for more, substrings get shorter and buckets larger instead.
TABLES = 96
#: Rows of one side of a tile.
TILE = 512


class Codes:
    """Rotations about the mean, and the tables over their signs."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray, bits: int, tables: int):
        self.bits, self.tables = bits, tables
        self.mean, self.rotation = mean, rotation[:, : bits * tables]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One key for each vector and table."""
        signs = ((vectors - self.mean) @ self.rotation > 0).reshape(len(vectors), self.tables, self.bits)
        return signs @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def _layout(same: float, bits: int, recall: float, most: int = TABLES) -> tuple[int, int]:
    """Bits of a substring, at most ``bits``, and tables, where a pair's bit is equal with probability ``same``."""
    while bits:
        missed = math.log1p(-min(same**bits, 1 - 1e-12))
        if missed < 0 and (tables := math.ceil(math.log(1 - recall) / missed)) <= most:
            return bits, tables
        bits -= 1
    return 0, 1


def learn(sample: np.ndarray, n: int, cosine: float = COSINE, recall: float = RECALL, rounds: int = 20, seed: int = 7) -> Codes:
    """ITQ from ``sample``, for ``n`` vectors; further rotations start from other random ones."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    bits = int(np.clip(math.ceil(math.log2(max(n, 2))) - 3, 4, 40))
    v = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = v.mean(axis=0)
    v = v - mean
    # Two vectors as far apart as the cosine allows, both as near to the mean as most vectors aren't.
    near = max(float(np.quantile((v * v).sum(axis=1), 0.1)), 1e-9)
    same = 1 - math.acos(max(-1.0, 1 - (1 - cosine) / near)) / math.pi
    bits, tables = _layout(same, bits, recall)
    axes = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    v = v @ axes
    rotations = []
    for _ in range(max(1, math.ceil(bits * tables / width))):
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = w.T @ u.T
        rotations.append(axes @ r)
    return Codes(mean, np.concatenate(rotations, axis=1), bits, tables)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finite non-zero vectors as bytes of doubles."""
    for b in batches:
        ids, out = [], []
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i is None or not x or None in x:
                continue
            v = np.array(x, dtype=np.float64) + 0.0  # one zero
            if np.isfinite(v).all() and v.any():
                ids.append(i)
                out.append(v.tobytes())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "vector"])


def _keyed(codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            keys = codes.keys(_unit(_matrix(b.column(1))))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, codes.tables), pa.int32()), pa.array(keys.ravel()))
            # What goes to each table: as many bytes a key as its bits need.
            packed = keys.astype("<i8").view(np.uint8).reshape(len(keys), codes.tables, 8)[:, :, : max(1, -(-codes.bits // 8))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists, pa.array([p.tobytes() for p in packed], pa.binary())], names=["id", "vector", "copies", "keys", "code"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes below ``n`` and links (a, b), the least node of each one's component."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _tiles(cosine: float, tables: int):
    """Links within tiles: rows (table, key, i, j, side, id, copies, vector, code), tiles in a row."""

    def tile(table: int, same: bool, left: tuple, right: tuple) -> list[np.ndarray]:
        (ia, ca, va, ka), (ib, cb, vb, kb) = left, right
        cos = va @ vb.T
        close = cos >= cosine
        if table:
            a, b = np.nonzero(close)
            close[a, b] = (ka[a, :table] != kb[b, :table]).any(axis=2).all(axis=1)
        if same:
            np.fill_diagonal(close, False)
        # Each vector's count, and the smallest id of its component in the tile, so that every link of the tile stays in; both ends of a link in a tile of two blocks.
        a, b = np.nonzero(close)
        nodes, at = np.unique(np.concatenate([ia[a], ib[b]]), return_inverse=True)
        root = nodes[_roots(len(nodes), *at.reshape(2, -1))]
        out = []
        for own, copies, m in ((ia, cb, close), (ib, ca, close.T))[: 1 if same else 2]:
            n = m @ copies
            k = np.flatnonzero(n)
            out.append(np.stack([own[k], n[k], root[np.searchsorted(nodes, own[k])]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        names = ["table", "key", "i", "j"]
        for b in _ended(batches):
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None or not len(t):
                continue
            k = np.stack([t.column(c).to_numpy() for c in names])
            new = np.flatnonzero(np.append(True, (k[:, 1:] != k[:, :-1]).any(axis=0)))
            ends = np.append(new[1:], len(t))
            whole = len(new) if b is None else len(new) - 1
            side = t.column("side").to_numpy()
            ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
            found = []
            for s, e in zip(new[:whole], ends[:whole]):
                if e - s < 2:
                    continue
                v = _unit(_matrix(t.column("vector").slice(s, e - s).combine_chunks()))
                k_ = np.frombuffer(b"".join(t.column("code").slice(s, e - s).to_pylist()), dtype=np.uint8).reshape(e - s, tables, -1)
                part = lambda x: (ids[s:e][x], copies[s:e][x], v[x], k_[x])  # noqa: B023, E731
                same = bool(k[2, s] == k[3, s])
                one = np.ones(e - s, dtype=bool)
                left, right = (one, one) if same else (side[s:e] == 0, side[s:e] == 1)
                found += tile(int(k[0, s]), same, part(left), part(right))
            rest = t.slice(int(new[whole])) if b is not None else None
            if found:
                x = np.concatenate(found, axis=1)
                yield pa.record_batch([pa.array(c) for c in x], names=["id", "n", "least"])

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_vectors(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """Rows (id, n_links, component_id, kept) for each row."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "near-vectors")
    read = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    valid = read.mapInArrow(_valid, "id long, vector binary")
    width = valid.groupBy(F.length("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    rows = rows.drop("n_links", "component_id", "kept")
    none = rows.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col(id).cast("long"), "kept": F.lit(True)})
    if width is None:
        return none
    valid = scratch.keep(valid.where(F.length("vector") == width["width"]).withColumn("same", F.md5("vector")), "valid")
    same = scratch.keep(valid.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "different")
    drawn = same.orderBy(F.xxhash64("same")).limit(sample).select("vector").collect()
    codes = learn(np.stack([np.frombuffer(r["vector"], dtype=np.float64) for r in drawn]), same.count(), cosine, recall)
    # Keys are computed once for each vector: in another batch a sign could round the other way.
    coded = scratch.keep(same.select("id", "vector", "copies").mapInArrow(_keyed(codes), "id long, vector binary, copies long, keys array<long>, code binary"), "keys")
    keyed = coded.select("id", F.posexplode("keys").alias("table", "key"))
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1")
    placed = keyed.join(sizes, ["table", "key"]).withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    # A block is the left or right side of a tile with each block, and both sides of its own.
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("table", "key", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    tiles = placed.join(coded.drop("keys"), "id").select("table", "key", "i", "j", "side", "id", "copies", "vector", "code")
    tiles = tiles.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j")
    links = scratch.keep(tiles.mapInArrow(_tiles(cosine, codes.tables), "id long, n long, least long").groupBy("id", "least").agg(F.sum("n").alias("n")), "links")
    labels = components(links.select(F.col("id").alias("a"), F.col("least").alias("b")), scratch)
    of_text = same.join(links.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    of_text = of_text.select("same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    of_row = scratch.keep(valid.join(of_text, "same").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "of-row")
    out = rows.withColumn("_id", F.col(id).cast("long")).join(of_row.withColumnRenamed("id", "_id"), "_id", "left")
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0).cast("long")), "component_id": F.coalesce("component_id", "_id")})
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("_id"), F.lit(True))).drop("_id")
