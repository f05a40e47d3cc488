"""What filters remove in every order, alone and on top of each other, by walking the orders one swap at a time.

A document is a mask of the filters that it fails, so each part (source) of a corpus becomes a table of
``2**k`` cells with counts. The walk visits all orders of the filters by swapping two neighbours at a time
(plain changes). A swap leaves what stands before and after the two as it was, so only these two steps are
counted again, from the cells. A filter's Shapley value is its removals added up along the walk.

The corpus is read once, into one narrow row a document. Copies are found by the SHA-256 of the text: the
smallest id of each text by a partial minimum, and the rows that have it by a join on (text, id), so a text that
a third of all documents share is no hot key. Cells are summed on the map side; the walk sees a fixed number of
cells a part, however many documents it has.

Defined results: null text counts as empty; null source as the empty string, in one part with it; a null id is
not larger than any id, so such a row never counts as a copy, and no row is a copy of it; rows that repeat count
each, and equal ids with equal texts are no copies of one another; labels that repeat count as good (toxic) if
one of them says so; labels of null or unknown ids are left out; other columns of the documents and labels are
not read, whatever their names; very long texts are read whole; an empty table gives no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"


def text_filters(text: Column) -> list[Column]:
    """Whether a text is too short, repeats itself, shouts, or holds symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def _bit(failed: Column, k: int) -> Column:
    return F.when(failed, 1 << k).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame, scratch: Scratch, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (part, mask, good, toxic, n): documents of a part by the filters that they fail and their labels."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(
        F.col(doc).alias("doc"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), whole.alias("text"),
    ).select("doc", "part", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("hash"), sum((_bit(f, k) for k, f in enumerate(text_filters(F.col("text")))), F.lit(0)).alias("mask"))
    rows = scratch.keep(read, "rows")
    first = rows.where("doc is not null").groupBy("hash").agg(F.min("doc").alias("doc"), F.lit(True).alias("first"))
    said = labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Null ids meet no label; a salt keeps them from being one hot key of the join.
    salt = F.when(F.col("doc").isNull(), F.pmod(F.xxhash64("hash"), F.lit(4096))).otherwise(0)
    rows = rows.join(first, ["doc", "hash"], "left").withColumn("salt", salt).join(said.withColumn("salt", F.lit(0).cast("long")), ["doc", "salt"], "left")
    copy = F.col("doc").isNotNull() & F.col("first").isNull()
    none = F.lit(False)
    return rows.groupBy(
        "part", (F.col("mask") + _bit(copy, 4)).alias("mask"), F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic")
    ).agg(F.count("*").alias("n"))


def plain_changes(k: int) -> Iterator[int]:
    """Places to swap with the next one, so that every order of ``k`` things comes up once, from the first on."""
    if k < 2:
        return
    down = list(range(k - 2, -1, -1))
    up = down[::-1]
    sweep, other = down, up
    for at in plain_changes(k - 1):
        yield from sweep
        # The largest stands at an end now, and shifts the others' places by one if that is the left end.
        yield at + 1 if sweep is down else at
        sweep, other = other, sweep
    yield from sweep


class Walk:
    """All orders of ``k`` filters over the cells of some parts at once: ``n[part, 0 all | 1 good | 2 toxic, mask]``."""

    def __init__(self, n: np.ndarray, k: int):
        self.n, self.k = n, k
        self.masks = np.arange(1 << k)
        self.order = list(range(k))
        self.fails = [n[:, 0, (self.masks >> f) & 1 == 1].sum(1) for f in range(k)]
        self.unique = [n[:, 0, 1 << f] for f in range(k)]
        self.shapley = np.zeros((len(n), k), dtype=np.int64)
        # Of each step: removed, good and toxic among them, kept.
        self.steps = np.zeros((len(n), k, 4), dtype=np.int64)
        for step in range(k):
            self._count(step)

    def _count(self, step: int) -> None:
        before = sum(1 << f for f in self.order[:step])
        f = self.order[step]
        here = (self.masks & before == 0) & ((self.masks >> f) & 1 == 1)
        self.steps[:, step, :3] = self.n[:, :, here].sum(2)
        self.steps[:, step, 3] = self.n[:, 0, self.masks & (before | 1 << f) == 0].sum(1)

    def _add(self) -> None:
        for step, f in enumerate(self.order):
            self.shapley[:, f] += self.steps[:, step, 0]

    def __iter__(self) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """Each order with a copy of its steps."""
        self._add()
        yield tuple(self.order), self.steps.copy()
        for at in plain_changes(self.k):
            self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]
            self._count(at)
            self._count(at + 1)
            self._add()
            yield tuple(self.order), self.steps.copy()


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(LETTERS)
    for batch in batches:
        # A part has one list of cells; 100 parts make 60,000 rows.
        for at in range(0, batch.num_rows, 100):
            parts = batch.slice(at, 100)
            p = parts.num_rows
            n = np.zeros((p, 3, 1 << k), dtype=np.int64)
            for i, own in enumerate(parts["cells"].to_pylist()):
                for c in own:
                    n[i, 0, c["mask"]] += c["n"]
                    n[i, 1, c["mask"]] += c["n"] * c["good"]
                    n[i, 2, c["mask"]] += c["n"] * c["toxic"]
            walk = Walk(n, k)
            orders, steps = zip(*walk, strict=True)
            steps = np.stack(steps)  # order, part, step, figure
            filters = np.array(orders)
            fails, unique = np.stack(walk.fails), np.stack(walk.unique)
            of = lambda x: x.T[:, filters].ravel()  # noqa: E731  by part, order and step, from by filter and part
            figures = steps.transpose(1, 0, 2, 3).reshape(-1, 4)
            names = np.array(["".join(LETTERS[f] for f in o) for o in orders])
            yield pa.RecordBatch.from_arrays(
                [
                    parts["part"].take(pa.array(np.repeat(np.arange(p), len(orders) * k))), pa.array(np.tile(np.repeat(names, k), p)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), p * len(orders))), pa.array(figures[:, 3]), pa.array(figures[:, 0]),
                    pa.array(of(fails) - figures[:, 0]), pa.array(of(unique)), pa.array(figures[:, 1]), pa.array(figures[:, 2]), pa.array(of(walk.shapley.T)),
                ],
                names=[c.split(" ")[0] for c in RESULT.split(", ")],
            )


def filter_audit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """For each part, order of the filters and step what the step keeps and removes (columns: ``RESULT``)."""
    found = cells(docs, labels, Scratch(docs.sparkSession, "filter-audit"), doc, text, source)
    return found.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells")).mapInArrow(_walked, RESULT)
