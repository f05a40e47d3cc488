"""Paths of a text through emissions: trellis, way back, and merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Columns kept of a stretch of frames from which the way back is found, and steps that are kept bit by bit.
WAYS, CELLS = 16, 1 << 24


class _Trellis:
    """Scores of a text's prefixes after each frame, one frame at a time."""

    def __init__(self, emission: np.ndarray, tokens: list[int], blank: int):
        if -1 in tokens:
            rest = np.delete(emission, blank, axis=1)
            emission = np.concatenate([emission, rest.max(axis=1, keepdims=True)], axis=1)
        self.emission, self.blank = emission, blank
        self.tokens = np.array([emission.shape[1] - 1 if k == -1 else k for k in tokens])
        self.frames, self.n = len(emission), len(tokens)

    def first(self) -> np.ndarray:
        score = np.full(self.n + 1, -np.inf)
        score[0] = 0.0 if self.n <= self.frames else np.inf
        return score

    def step(self, score: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores after frame ``t`` of as many prefixes as given, and which of them moved on."""
        stay = self.emission[t, self.blank]
        waits, moves = score[1:] + stay, score[:-1] + self.emission[t, self.tokens[: len(score) - 1]]
        moved = moves > waits
        after = np.empty_like(score)
        after[1:] = np.where(moved, moves, waits)
        # A path can't begin so late that the tokens don't fit in any more.
        after[0] = score[0] + stay if t < self.frames - self.n else np.inf
        return after, moved

    def back(self, score: np.ndarray, low: int, high: int, j: int) -> Iterator[tuple[int, int, bool]]:
        """(prefix, frame, moved) from frame ``high - 1`` back to ``low`` or the first token; ``score``: before ``low``.

        A prefix depends on shorter ones only, so the columns beyond ``j`` are left out. A long stretch is
        run through once more in parts, from columns kept along it.
        """
        score = score[: j + 1]
        if (high - low) * j <= CELLS or high - low <= WAYS:
            moved = np.empty((high - low, j), dtype=bool)
            for t in range(low, high):
                score, moved[t - low] = self.step(score, t)
            for t in reversed(range(low, high)):
                yield j, t, bool(moved[t - low, j - 1])
                j -= int(moved[t - low, j - 1])
                if not j:
                    return
            return
        width = -(-(high - low) // WAYS)
        kept = {low: score}
        for t in range(low, low + (high - low - 1) // width * width):
            score, _ = self.step(score, t)
            if (t + 1 - low) % width == 0:
                kept[t + 1] = score
        for begin in sorted(kept, reverse=True):
            for j, t, on in self.back(kept.pop(begin), begin, min(begin + width, high), j):
                yield j, t, on
            j -= int(on)
            if not j:
                return


def best_path(emission: np.ndarray, tokens: list[int], blank: int = 0) -> list[tuple[int, int, float]] | None:
    """(token, frame, probability) of the best path in time order; none if the first token isn't reached.

    A token of -1 stands for any but the blank. The path is the last column's
    greatest entry followed back; staying wins over moving on where they are equal.
    Memory grows with the frames and with the tokens, not with their product.
    """
    if not len(tokens) or not len(emission):
        return None
    trellis = _Trellis(emission, tokens, blank)
    score = trellis.first()
    whole = np.full(trellis.frames + 1, -np.inf)
    for t in range(trellis.frames):
        score, _ = trellis.step(score, t)
        whole[t + 1] = score[-1]
    path, j = [], trellis.n
    for j, t, on in trellis.back(trellis.first(), 0, int(np.argmax(whole)), trellis.n):
        path.append((j - 1, t, float(np.exp(emission[t, blank] if not on else trellis.emission[t, trellis.tokens[j - 1]]))))
        j -= int(on)
    return path[::-1] if not j else None


def paths(rows: DataFrame, blank: int = 0) -> DataFrame:
    """Rows (id, step, token, frame, score); ids without a path give none.

    rows: id, emission (a list of frames, each a list of log probabilities), tokens.
    """

    def run(parts):
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                path = best_path(np.array([np.asarray(f, dtype=float) for f in r.emission]), list(r.tokens), blank)
                out += [(r.id, k, *p) for k, p in enumerate(path or [])]
            yield pd.DataFrame(out, columns=["id", "step", "token", "frame", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "emission", "tokens").mapInPandas(run, f"id {kind}, step long, token long, frame long, score double")


def merge_repeats(path: DataFrame) -> DataFrame:
    """Runs of one token: first frame, frame after the last, mean score."""
    order = W.partitionBy("id").orderBy("step")
    rows = path.withColumn("_new", F.coalesce((F.col("token") != F.lag("token").over(order)).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    return rows.groupBy("id", "run").agg(F.first("token").alias("token"), F.min("frame").alias("from"), (F.max("frame") + 1).alias("to"), F.avg("score").alias("score"))


def merge_words(runs: DataFrame, separator: str = "|") -> DataFrame:
    """Words between separators: labels joined, score weighted by length. runs: id, run, label, from, to, score."""
    order = W.partitionBy("id").orderBy("run")
    rows = runs.withColumn("word", F.sum((F.col("label") == separator).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("long")).where(F.col("label") != separator)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "label"))), lambda x: x["label"]), "")
    length = F.col("to") - F.col("from")
    return rows.groupBy("id", "word").agg(text.alias("text"), F.min("from").alias("from"), F.max("to").alias("to"), (F.sum(F.col("score") * length) / F.sum(length)).alias("score"))
