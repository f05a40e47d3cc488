"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words with one space between them. A test item
of m characters may differ from a passage by ``rate`` * m edits, rounded down;
cut into one piece more than that, at least one piece is unchanged. An automaton
over all pieces finds their exact places in each whole text, and Myers'
bit-parallel distance decides within the stretch around each place: an item is
found where a run of whole words is that close to it.

Test items are a small stated set; they go to the executors in blocks of at
most ``BLOCK`` characters, and each block scans the texts once.

Defined results: null or wordless texts and items match nothing; items of equal
text match each for itself; repeated rows match each; where both tables call their id alike, the item's is
called ``item``; empty tables give none.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.metrics import edit_distance

#: Edits allowed for each character of an item.
RATE = 0.08
#: Characters of items that one scan takes.
BLOCK = 4_000_000
_WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(i, item[i:j]) for i, j in zip(cuts, cuts[1:]) if j > i]


class Pattern:
    """An item for Myers' search: the least distance to any stretch of a text."""

    def __init__(self, item: str):
        self.size = len(item)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.masks[c] |= 1 << i

    def ends(self, text: str, errors: int, anchored: bool = False) -> Iterator[tuple[int, int]]:
        """(distance, end) of the closest stretch up to each end, if within ``errors``; ``anchored``: of the whole text up to it."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, distance = full, 0, self.size
        masks = self.masks
        for end, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                distance += 1
            elif mh & top:
                distance -= 1
            ph = ((ph << 1) | anchored) & full
            plus = ((mh << 1) & full) | (full & ~(xv | ph))
            minus = ph & xv
            if distance <= errors:
                yield distance, end

    def best(self, text: str, errors: int) -> tuple[int, int] | None:
        """(distance, end) of the closest stretch, the first of equals, if within ``errors``."""
        return min(self.ends(text, errors), default=None)


class Items:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items = [(key, x) for key, x in ((key, normal(text)) for key, text in items) if x]
        self.errors = [int(rate * len(x)) for _, x in self.items]
        self.forward: dict[int, Pattern] = {}
        self.backward: dict[int, Pattern] = {}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, x) in enumerate(self.items):
            for offset, piece in pieces(x, self.errors[n]):
                where[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()

    def stretches(self, text: str) -> dict[int, list[list[int]]]:
        """For each item with a piece in the text, the joined stretches that may hold it."""
        found: dict[int, list[list[int]]] = defaultdict(list)
        for last, (size, uses) in self.automaton.iter(text) if len(self.automaton) else ():
            for n, offset in uses:
                begin = last + 1 - size - offset
                found[n].append([begin - self.errors[n], begin + len(self.items[n][1]) + self.errors[n]])
        out = {}
        for n, spans in found.items():
            spans.sort()
            joined = [spans[0]]
            for s in spans[1:]:
                if s[0] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], s[1])
                else:
                    joined.append(s)
            out[n] = [[max(0, a), min(len(text), b)] for a, b in joined]
        return out

    def matches(self, text: str, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item's closest stretch of whole words."""
        out = []
        for n, spans in self.stretches(text).items():
            item, errors = self.items[n][1], self.errors[n]
            pattern = self.forward.setdefault(n, Pattern(item))
            ends = sorted((d, a + end) for a, b in spans for d, end in pattern.ends(text[a:b], errors) if a + end == len(text) or text[a + end] == " ")
            back = self.backward.setdefault(n, Pattern(item[::-1]))
            best = None
            for least, end in ends:
                if best and best[0] <= least:
                    break
                begin = max(0, end - len(item) - errors)
                starts = ((d, end - k) for d, k in back.ends(text[begin:end][::-1], errors, anchored=True) if end == k or text[end - k - 1] == " ")
                for distance, start in starts:
                    if best is None or distance < best[0]:
                        best = distance, start, end
            if best:
                out.append((n, *best))
            if out and first:
                break
        return out


def _places(raw: str, start: int, end: int) -> tuple[int, int]:
    """Where a stretch of the compared text stands in the text itself."""
    at, out = 0, []
    for m in _WORD.finditer(raw.lower()):
        size = m.end() - m.start()
        if at + size > start and not out:
            out.append(m.start() + max(0, start - at))
        if at + size >= end:
            return (out or [m.start()])[0], m.start() + end - at
        at += size + 1
    return (out or [0])[0], len(raw)


def _blocks(items: DataFrame, item: str, text: str, block: int) -> list[list[tuple[int | None, str]]]:
    rows = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = -(-size // block)
    part = F.pmod(F.xxhash64("item", "text"), F.lit(max(n, 1)))
    return [[(r["item"], r["text"]) for r in rows.where(part == i).orderBy("item", "text").collect()] for i in range(n)]


def find_leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """Rows (doc, item, distance, start, end) for each text and item found in it; places are in code points of the text."""
    kinds = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, distance int, start long, end long"
    kind = to_arrow_type(items.schema[item].dataType)
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))

    def over(block_items: list[tuple[int | None, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(block_items, rate)
            target = None
            for b in batches:
                target = target or pa.schema([("doc", b.schema.field(0).type), ("item", kind), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
                found = []
                for i, raw in enumerate(b.column(1)):
                    raw = raw.as_py()
                    for n, distance, start, end in known.matches(normal(raw)):
                        found.append((b.column(0)[i].as_py(), known.items[n][0], distance, *_places(raw, start, end)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 5, target)], schema=target)

        return rows.mapInArrow(run, schema)

    found = None
    for part in _blocks(items, item, passage, block):
        found = over(part) if found is None else found.unionByName(over(part))
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"doc": doc, "item": item if item != doc else "item"})


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", passage: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    schema = docs.schema
    at = docs.columns.index(text)

    def over(block_items: list[tuple[int | None, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(block_items, rate)
            for b in batches:
                clean = [not known.matches(normal(x.as_py()), first=True) for x in b.column(at)]
                yield b.filter(pa.array(clean, pa.bool_()))

        return run

    for part in _blocks(items, item, passage, block):
        docs = docs.mapInArrow(over(part), schema)
    return docs
