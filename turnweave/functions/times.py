"""Times as whole milliseconds, and the ways they are written.

Seconds come in as doubles once and stay integers from there; Spark and Python
round binary fractions differently, integers they don't.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(seconds: Column) -> Column:
    """Milliseconds of a double, halves to even."""
    return F.rint(seconds * 1000).cast("long")


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def _padded(value: Column, width: int) -> Column:
    """Zero-padded, and whole where it is wider."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def timestamp(ms: Column, mark: str = ".", hours: bool = False) -> Column:
    """``[HH:]MM:SS.mmm``; hours always, or only from one hour on. Negative times raise."""
    hour, rest = F.floor(ms / 3_600_000), ms % 3_600_000
    short = F.concat(_two(F.floor(rest / 60_000)), F.lit(":"), _two(F.floor(rest % 60_000 / 1000)), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))
    long = F.concat(_padded(hour, 2), F.lit(":"), short)
    text = long if hours else F.when(hour > 0, long).otherwise(short)
    return F.when(ms < 0, F.raise_error(F.lit("a timestamp can't be negative"))).otherwise(text)


def clock(ms: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``, cut to whole seconds; ``--:--`` without a time."""
    s = F.floor(ms / 1000)
    hour, minute = F.floor(s / 3600), F.floor(s % 3600 / 60)
    text = F.when(hour > 0, F.concat_ws(":", hour.cast("string"), _two(minute), _two(s % 60))).otherwise(F.concat_ws(":", minute.cast("string"), _two(s % 60)))
    return F.when(ms.isNull(), "--:--").otherwise(text)


def duration(ms: Column) -> Column:
    """``1h 05m`` or ``23m 45s``."""
    s = F.floor(ms / 1000)
    hour, minute = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(hour > 0, F.concat(hour.cast("string"), F.lit("h "), _two(minute), F.lit("m"))).otherwise(F.concat(minute.cast("string"), F.lit("m "), _two(s % 60), F.lit("s")))


def total(ms: Column) -> Column:
    """``1h 05m`` or ``5m``."""
    s = F.floor(ms / 1000)
    hour, minute = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(hour > 0, F.concat(hour.cast("string"), F.lit("h "), _two(minute), F.lit("m"))).otherwise(F.concat(minute.cast("string"), F.lit("m")))


def date(text: Column) -> Column:
    """``Jan 05, 2024 · 13:45`` of an ISO string; any other string as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "MMM dd, yyyy · HH:mm"), text)


def ago(text: Column, now: Column) -> Column:
    """How long before ``now``: just now, minutes, hours, or the date."""
    s = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(text))
    return (
        F.when(text.isNull(), F.lit(None))
        .when(s < 45, "just now")
        .when(s < 3600, F.concat(F.greatest(F.floor(s / 60), F.lit(1)).cast("string"), F.lit("m ago")))
        .when(s < 86_400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .otherwise(date(text))
    )


def size(count: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB of 1024; one decimal but for B."""
    out = None
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        tenths = F.rint(count.cast("double") * 10 / 1024**power).cast("long")
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        test = count < 1024 ** (power + 1)
        out = F.when(test, text) if out is None else out.when(test, text) if power < 4 else out.otherwise(text)
    return F.when(count < 1024, F.concat(count.cast("string"), F.lit(" B"))).otherwise(out)


def eta(stage: Column, ms: Column, factors: dict[str, float]) -> Column:
    """Seconds that a stage will take; null for unknown stages and for no or zero length."""
    factor = F.lit(None).cast("double")
    for name, value in factors.items():
        factor = F.when(stage == name, F.lit(value)).otherwise(factor)
    return F.rint(factor * F.nullif(ms, F.lit(0)) / 1000).cast("long")


#: Processing seconds for each second of audio.
STAGE_FACTORS = {"transcribing": 0.22, "aligning": 0.19, "diarizing": 0.51}
