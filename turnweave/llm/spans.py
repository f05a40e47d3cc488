"""Regular expression matches with their places, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256
SPAN = "array<struct<start:int,end:int,text:string>>"


def find(text: Column, pattern: str, when: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, end, text) in code points; none for null text.

    Texts between matches and matches alternate, so running sums of their
    lengths are the places. ``when`` is a cheap test that holds for each text
    with a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = _once(found, lambda f: F.when(F.size(f) > 0, _placed(F.split(text, pattern, -1), f)))
    none = F.array().cast(SPAN)
    test = text.isNotNull() if when is None else text.isNotNull() & when
    return F.coalesce(F.when(test, spans), none)


def _once(value: Column, use) -> Column:
    """``use(value)`` where value is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _placed(between: Column, found: Column) -> Column:
    both = F.struct(between.alias("between"), found.alias("found"))
    lengths = lambda x: F.transform(x["found"], lambda m, i: F.length(F.get(x["between"], i)) + F.length(m))
    return _once(both, lambda x: _once(F.struct(x["between"].alias("between"), x["found"].alias("found"), lengths(x).alias("lengths")), _sums))


def _sums(x: Column) -> Column:
    n = F.size(x["found"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / _BLOCK).cast("int")), lambda k: _total(F.slice(x["lengths"], k * _BLOCK + 1, F.lit(_BLOCK))))
    return _once(F.struct(x["between"].alias("between"), x["found"].alias("found"), x["lengths"].alias("lengths"), blocks.alias("blocks")), _spans)


def _spans(x: Column) -> Column:
    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        before = _total(F.slice(x["blocks"], F.lit(1), block)) + _total(F.slice(x["lengths"], block * _BLOCK + 1, i - block * _BLOCK))
        start = before + F.length(F.get(x["between"], i))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"))

    return F.transform(x["found"], span)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.split(F.reverse(number), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.translate(d, "0123456789", "0246813579").cast("int"))
    return F.aggregate(F.transform(F.filter(figures, lambda d: d != ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def digest(kinds: list[tuple[str, Column]]) -> Column:
    """``kind:start:end`` of all spans by start, then kind as listed, comma-joined."""
    def listed(k: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    ordered = F.array_sort(F.concat(*(listed(k, kind, spans) for k, (kind, spans) in enumerate(kinds))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
