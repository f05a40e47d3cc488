"""Where speech models and services plug in: each is a function over pandas batches, registered by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Batches = Iterator[pd.DataFrame]


class Registry:
    """Named plug-ins of one kind, with the schema of what they return."""

    def __init__(self, kind: str, schema: str):
        self.kind, self.schema = kind, schema
        self._known: dict[str, Callable[[Batches], Batches]] = {}

    def register(self, name: str, function: Callable[[Batches], Batches]) -> None:
        self._known[name] = function

    def apply(self, rows: DataFrame, name: str) -> DataFrame:
        if name not in self._known:
            raise ValueError(f"no such {self.kind}: {name}")
        return rows.mapInPandas(self._known[name], self.schema)


#: Audio bytes to samples; chunks to texts; first half minutes to languages; text and audio to emissions; audio to turns and to speech scores; texts to translations.
DECODERS = Registry("decoder", "recording_id string, sample_rate int, pcm binary")
TRANSCRIBERS = Registry("transcriber", "recording_id string, chunk long, start_ms long, end_ms long, text string, language string")
ALIGNERS = Registry("aligner", "id string, emission array<array<float>>, tokens array<int>")
DIARIZERS = Registry("diarizer", "recording_id string, ord long, s_start long, s_end long, speaker string")
LANGUAGE_DETECTORS = Registry("language detector", "recording_id string, language string, probability double")
DETECTORS = Registry("voice detector", "recording_id string, frame long, t_ms long, score double")
TRANSLATORS = Registry("translator", "doc string, pos long, tr string")


def translated(batched: DataFrame, name: str) -> DataFrame:
    """Translations of batched texts (doc, pos, text, batch); a translator that returns another number of texts fails."""
    from pyspark.sql import functions as F

    out = TRANSLATORS.apply(batched, name)
    counts = batched.groupBy("doc").agg(F.count("*").alias("sent")).join(out.groupBy("doc").agg(F.count("*").alias("got")), "doc", "left")
    right = F.when(F.col("sent") != F.coalesce("got", F.lit(0)), F.raise_error(F.lit("a translator returned another number of texts"))).otherwise(F.lit(True))
    checked = counts.select("doc", right.alias("ok"))
    return out.join(checked.where("ok"), "doc").drop("ok")
