"""Error rates, scores and timings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import normal_words

#: Items of a run that says how far two sequences are apart at least.
GRAM = 5


def edit_distance(a, b) -> int:
    """Least number of changes between two strings or lists, for any number of different items.

    What they begin and end with alike is cut off. Then the band of diagonals within ``e`` changes grows with
    ``e`` until it holds the distance, so near texts take time and memory by their distance, not by their
    product; where that would cost more than comparing all (the band reaches about an eighth of
    their length, and at once where their runs of ``GRAM`` items say so), ``far_distance`` does, in memory linear in their length.
    """
    if a == b:
        return 0
    x, y = _codes(a, b)
    n = min(len(x), len(y))
    head = _alike(x, y, 0, 0)
    tail = _alike(x[::-1], y[::-1], 0, 0) if head < n else 0
    tail = min(tail, n - head)
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if not len(x) or not len(y):
        return max(len(x), len(y))
    most = max(16, min(len(x), len(y)) // 8)
    found = _near_distance(x, y, most) if _least_distance(x, y) <= most else None
    return found if found is not None else far_distance(x.tolist(), y.tolist())


def _least_distance(x: np.ndarray, y: np.ndarray) -> int:
    """A bound that the distance doesn't fall below: a change touches ``GRAM`` runs of so many items on each side."""
    apart = abs(len(x) - len(y))
    if min(len(x), len(y)) < GRAM:
        return apart
    grams = []
    for v in (x, y):
        own, n = np.zeros(len(v) - GRAM + 1, dtype=np.uint64), len(v) - GRAM + 1
        for k in range(GRAM):
            own = own * np.uint64(0x9E3779B97F4A7C15) + v[k : k + n].astype(np.uint64) + np.uint64(1)
        grams.append(own)
    both = np.concatenate(grams)
    order = np.argsort(both)
    sign = np.where(order < len(grams[0]), 1, -1)
    both = both[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return max(apart, -(-int(np.abs(np.add.reduceat(sign, first)).sum()) // (2 * GRAM)))


def _codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(a, str) and isinstance(b, str):
        return tuple(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
    numbers: dict = {}
    return tuple(np.array([numbers.setdefault(w, len(numbers)) for w in t], dtype=np.int64) for t in (a, b))


def _alike(x: np.ndarray, y: np.ndarray, i: int, j: int) -> int:
    """How many items are equal from ``x[i]`` and ``y[j]`` on."""
    begin, width = i, 16
    while True:
        n = min(width, len(x) - i, len(y) - j)
        apart = np.flatnonzero(x[i : i + n] != y[j : j + n])
        if len(apart) or not n:
            return i + (int(apart[0]) if len(apart) else 0) - begin
        i, j, width = i + n, j + n, width * 2


def _near_distance(x: np.ndarray, y: np.ndarray, most: int) -> int | None:
    """The distance if it is at most ``most``: for each number of changes the farthest place on each diagonal."""
    goal = len(y) - len(x)
    reach = np.full(1, _alike(x, y, 0, 0))  # in x, by diagonal
    for e in range(most + 1):
        if abs(goal) <= e and reach[goal + e] >= len(x):
            return e
        wide = np.full(2 * e + 5, -2)
        wide[2:-2] = reach
        # An item of y more, one of x more, or one of each.
        reach = np.maximum(np.maximum(wide[:-2], wide[2:] + 1), wide[1:-1] + 1)
        diagonal = np.arange(-e - 1, e + 2)
        reach = np.minimum(np.minimum(reach, len(x)), len(y) - diagonal)
        live = np.flatnonzero((reach >= 0) & (reach + diagonal >= 0))
        for _ in range(4):  # most stop at once
            live = live[(reach[live] < len(x)) & (reach[live] + diagonal[live] < len(y))]
            live = live[x[reach[live]] == y[reach[live] + diagonal[live]]]
            reach[live] += 1
        for k in live:
            reach[k] += _alike(x, y, int(reach[k]), int(reach[k] + diagonal[k]))
    return None


def far_distance(a, b) -> int:
    """The distance of sequences that aren't empty, by bits of one long number (Myers).

    The longer one is in the bits: a step on long numbers costs less than as many short ones.
    """
    if len(a) < len(b):
        a, b = b, a
    places: dict = {}
    for at, x in enumerate(a):
        places.setdefault(x, []).append(at)
    wanted = set(b)
    places = {x: _bits(at, len(a)) for x, at in places.items() if x in wanted}
    mask = (1 << len(a)) - 1
    up, down = mask, 0
    find = places.get
    for x in b:
        match = find(x, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        more = ((down | ((diagonal | up) & mask ^ mask)) << 1 | 1) & mask
        less = (up & diagonal) << 1
        up, down = (less | (diagonal | more) ^ mask) & mask, more & diagonal
    # From the last step's column on, each bit is a change more or less.
    return len(b) + up.bit_count() - down.bit_count()


def _bits(at: list[int], n: int) -> int:
    """The number with these bits."""
    if len(at) < 8:
        return sum(1 << i for i in at)
    whole = np.zeros(n, dtype=np.uint8)
    whole[at] = 1
    return int.from_bytes(np.packbits(whole, bitorder="little").tobytes(), "little")


def error_rates(pairs: DataFrame) -> DataFrame:
    """Rows with wer and cer, to four places; texts and vocabularies may be of any size. pairs: id, reference, hypothesis."""

    # The length is taken there too, so that texts are normalised once.
    @F.pandas_udf("double")
    def rate(a: pd.Series, b: pd.Series) -> pd.Series:
        both = ((None, None) if x is None or y is None else (x, y) if isinstance(x, str) else (list(x), list(y)) for x, y in zip(a, b))
        return pd.Series([None if x is None else edit_distance(x, y) / max(len(x), 1) for x, y in both], dtype="Float64")

    rows = pairs.withColumns({"_r": normal_words(F.col("reference")), "_h": normal_words(F.col("hypothesis"))})
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    wer = rate(words("_r"), words("_h"))
    cer = rate(F.replace("_r", F.lit(" "), F.lit("")), F.replace("_h", F.lit(" "), F.lit("")))
    return rows.withColumns({"wer": F.round(wer, 4), "cer": F.round(cer, 4)}).drop("_r", "_h")


def compression_ratio(rows: DataFrame, text: str = "text") -> DataFrame:
    """Bytes of a text over its bytes when compressed."""

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        import zlib

        return texts.map(lambda t: None if t is None else len(t.encode()) / len(zlib.compress(t.encode())))

    return rows.withColumn("ratio", ratio(F.col(text)))


def weighted_score(rows: DataFrame) -> DataFrame:
    """Mean of scores weighted by tokens, at least 1 each; 0 for none. rows: id, score, n_tokens."""
    n = F.when(F.coalesce("n_tokens", F.lit(0)) > 0, F.col("n_tokens")).otherwise(1)
    return rows.groupBy("id").agg(F.coalesce(F.sum(F.col("score") * n) / F.sum(F.when(F.col("score").isNotNull(), n)), F.lit(0.0)).alias("score"))


def mean_log(rows: DataFrame) -> DataFrame:
    """Mean logarithm of positive probabilities, else 0. rows: id, p."""
    return rows.groupBy("id").agg(F.coalesce(F.avg(F.when(F.col("p") > 0, F.ln("p"))), F.lit(0.0)).alias("score"))


def sequence_score(score: Column, length: Column, penalty: float = 1.0) -> Column:
    return score * F.pow(length, F.lit(penalty)) / (length + 1)


def real_time_factor(timings: DataFrame) -> DataFrame:
    """timings: id, stage, ms, audio_ms."""
    return timings.groupBy("id").agg(F.sum("ms").alias("ms"), F.max("audio_ms").alias("audio_ms")).withColumn("rtf", F.col("ms") / F.nullif("audio_ms", F.lit(0)))


def eligible(turns: DataFrame, wanted: int, people: int) -> DataFrame:
    """Speakers with enough turns for ``wanted`` turns dealt out among ``people``. turns: speaker."""
    return turns.groupBy("speaker").agg(F.count("*").alias("n")).where(F.col("n") >= -(-wanted // people))
