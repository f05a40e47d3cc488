"""How sources of a language differ in their words, by group blocks against group blocks.

Words are counted once, in the tasks that read the texts, so a shuffled row is a (language, source, term) of a
task and no frequent word is a hot key. A language's terms, hashed into chunks, and its sources, cut into blocks
of ``BLOCK``, make packed vectors: a block's counts in one chunk are one row. Each pair of blocks in each slab of
``SLAB`` chunks is a task of its own: the blocks' vectors are replicated to it, and it adds up the differences of
all pairs of its sources over the slab's chunks, one chunk at a time. Sums of slabs meet in a map-side
aggregation. So a source's vector goes to as many tasks as there are blocks of sources, not to as many as there
are sources, no task holds more than two blocks' counts of a chunk at once, and a language with most of the
terms has most of the tasks.

Shares are whole numbers: ``p = 1 + floor(SCALE * (count + 5) / (all + 5 * terms))``, by long division in
64 bits, exact while a language has fewer than ``9 * 10**15`` words.

Defined results: null text, language and source count as the empty string; rows that repeat count each; a term
counts once a row in the number of documents; ties of a value go by the item's bytes; very long texts are read
whole, piece by piece; other columns aren't read, whatever their names; a language without terms has pairs of
value 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: Documents of the language that a term must be in.
DOCUMENTS = 30
#: Added to each count.
ADDED = 5
SCALE = 1_000_000_000
#: Sources of a block.
BLOCK = 32
#: Terms of a chunk, on average, and chunks of a slab.
CHUNK, SLAB = 1024, 16
#: Terms of a source that are listed.
TOP = 50
#: Counts that a task gathers before it sends them on, and bytes of text that it takes apart at once.
GATHERED, PIECE = 500_000, 1 << 22

#: Bytes of a term as they count: A-Z lowered; what is in no term becomes a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(_TERM)
        cut = len(piece)
        if at + cut < len(text) and (space := piece.rfind(b" ")) >= 0:
            cut = space + 1
        elif at + cut < len(text):  # a term longer than a piece
            piece, cut = text[at:].translate(_TERM), len(text) - at
        yield piece[:cut].split()
        at += cut


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) of a task."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            of = docs[lang, source]
            yield pa.record_batch(
                [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([of[t] for t in own], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        n.clear()
        docs.clear()

    for batch in batches:
        for text, lang, source in zip(batch["text"].cast(pa.binary()), batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True):
            group = lang, source
            if group not in n:
                n[group], docs[group] = Counter(), Counter()
            held, seen = len(n[group]), set()
            for terms in _pieces(text.as_py()):
                n[group].update(terms)
                seen.update(terms)
            docs[group].update(seen)
            size += len(n[group]) - held
            if size >= GATHERED:
                yield from send()
                size = 0
    yield from send()


def _share(count: str, whole: str) -> Column:
    """``1 + floor(SCALE * count / whole)``, three digits of base 1000 at a time."""
    first = f"{count} * 1000"
    second = f"{first} % {whole} * 1000"
    third = f"{second} % {whole} * 1000"
    return F.expr(f"1 + (({first}) div {whole}) * 1000000 + (({second}) div {whole}) * 1000 + (({third}) div {whole})")


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _dense(row: dict, counts: pa.Array) -> np.ndarray:
    """A block's shares (source, term of the chunk)."""
    wholes = np.array(row["wholes"], dtype=np.int64)
    out = np.repeat(shares(np.full_like(wholes, ADDED), wholes)[:, None], row["terms"], axis=1)
    if len(counts):
        member, place, n = (counts.field(k).to_numpy() for k in ("member", "place", "n"))
        out[member, place] = shares(n + ADDED, wholes[member])
    return out


def _tile(table: pa.Table) -> pa.Table:
    """Rows (lang, a, b, value): the differences of a tile's pairs over its chunks."""
    rows = table.drop_columns(["counts"]).to_pylist()
    chunks: dict[int, list[int]] = {}
    for k, row in enumerate(rows):
        chunks.setdefault(row["chunk"], []).append(k)
    values, names = None, None
    for at in chunks.values():
        at.sort(key=lambda k: rows[k]["block"])
        ends = [rows[k]["members"] for k in (at[0], at[-1])]
        if values is None:
            names, values = ends, np.zeros((len(ends[0]), len(ends[1])), dtype=np.int64)
        if rows[at[0]]["terms"]:
            dense = [_dense(rows[k], table["counts"][k].values if table["counts"][k].is_valid else ()) for k in at]
            for i, own in enumerate(dense[0]):
                values[i] += np.abs(dense[-1] - own).sum(axis=1)
    same = rows[0]["i"] == rows[0]["j"]
    if not same and len({row["block"] for row in rows}) < 2:  # no source fell into the other block
        values = values[:0]
    a, b = np.triu_indices(len(values), 1) if same else (x.ravel() for x in np.indices(values.shape))
    return pa.table({"lang": pa.array([rows[0]["lang"]] * len(a), pa.string()), "a": pa.array([names[0][k] for k in a], pa.string()), "b": pa.array([names[1][k] for k in b], pa.string()), "value": values[a, b]})


#: Up to so many rows the tables of groups and languages are broadcast, else joined as they are.
FEW_GROUPS = 100_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW_GROUPS else df


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", documents: int = DOCUMENTS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): all pairs of sources of a language, and each source's most over-used terms."""
    scratch = Scratch(docs.sparkSession, "divergence")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(plain(text).alias("text"), plain(lang).alias("lang"), plain(source).alias("source"))
    counts = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = scratch.keep(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= documents)
    terms = scratch.keep(terms.select("lang", "term", "total"), "terms")
    groups = scratch.keep(read.select("lang", "source").distinct(), "groups")
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks")).join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")), "lang", "left")
    langs = langs.withColumn("v", F.coalesce("v", F.lit(0).cast("long"))).withColumn("lang_whole", F.coalesce("lang_n", F.lit(0)) + ADDED * F.col("v")).withColumn("chunks", F.greatest(F.ceil(F.col("v") / chunk), F.lit(1)))
    langs = scratch.keep(langs.drop("lang_n"), "langs")
    few = _few(langs)
    placed = terms.join(few, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    placed = placed.withColumn("place", (F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1).cast("int"))
    placed = scratch.keep(placed.select("lang", "term", "total", "lang_whole", "chunk", "place"), "placed")
    kept = scratch.keep(counts.drop("docs").join(placed, ["lang", "term"]), "kept")

    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(few, "lang")
    groups = groups.withColumn("whole", F.coalesce("own", F.lit(0)) + ADDED * F.col("v")).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    groups = groups.withColumn("member", (F.row_number().over(W.partitionBy("lang", "block").orderBy("source")) - 1).cast("int"))
    groups = scratch.keep(groups.select("lang", "source", "whole", "block", "member"), "blocks")
    of_group = _few(groups)
    return _pairs(kept, groups, of_group, few, scratch).unionByName(_terms(kept, of_group, top))


def _pairs(kept: DataFrame, groups: DataFrame, of_group: DataFrame, langs: DataFrame, scratch: Scratch) -> DataFrame:
    key = ["lang", "block", "chunk"]
    counts = kept.join(of_group, ["lang", "source"]).groupBy(*key).agg(F.collect_list(F.struct("member", "place", "n")).alias("counts"))
    blocks = groups.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("member", "source", "whole"))).alias("m"))
    blocks = blocks.select("lang", "block", F.col("m.source").alias("members"), F.col("m.whole").alias("wholes"))
    sizes = kept.select("lang", "chunk", "place").groupBy("lang", "chunk").agg((F.max("place") + 1).alias("terms"))
    chunks = langs.select("lang", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).join(sizes, ["lang", "chunk"], "left").fillna(0, ["terms"])
    vectors = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    vectors = vectors.join(blocks, ["lang", "block"]).join(counts, key, "left")
    tiles = vectors.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("lang", F.floor(F.col("chunk") / SLAB).alias("slab"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "chunk", "block", "terms", "members", "wholes", "counts")
    sums = tiles.groupBy("lang", "slab", "i", "j").applyInArrow(_tile, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("end"))
    return _ranked(both.select("lang", "end.source", F.lit("pair").alias("part"), "end.item", "value"))


def _terms(kept: DataFrame, of_group: DataFrame, top: int) -> DataFrame:
    p, q = _share(f"(n + {ADDED})", "whole"), _share(f"(total + {ADDED})", "lang_whole")
    rows = kept.where("n > 0").join(of_group, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))
    return _ranked(rows.where("value > 0")).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
