"""Columns of lists that are computed once and in linear time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a block of running sums.
BLOCK = 64


def once(value: Column, use) -> Column:
    """``use(value)`` where value is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column, block: int = BLOCK) -> Column:
    """0, and the sum of the first 1, 2, ... values.

    Lists are appended to within blocks only, and block by block, so a long list isn't copied value by value.
    """
    zero = F.array(F.lit(0).cast("long"))
    grown = lambda x, step: F.aggregate(x, zero, lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + step(v)))

    def within(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int")), lambda k: grown(F.slice(v, k * block + 1, F.lit(block)), lambda x: x))

    def joined(blocks: Column) -> Column:
        begins = grown(blocks, lambda b: F.element_at(b, -1))
        whole = lambda both: F.flatten(F.zip_with(both["blocks"], both["begins"], lambda b, at: F.when(b.isNotNull(), F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + at)).otherwise(F.array(at))))
        return once(F.struct(blocks.alias("blocks"), begins.alias("begins")), whole)

    return once(once(values, within), joined)
