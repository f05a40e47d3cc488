"""Whole jobs over plugged-in models: speech to segments, segments to timed words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plugins
from . import align, ctc, folds, interpolate


def transcribe(scores: DataFrame, transcriber: str, chunk_ms: int = 30_000, max_ms: int | None = None) -> DataFrame:
    """Segments of recordings from their speech scores: regions, packed into chunks, each given to the transcriber.

    scores: recording_id, frame, t_ms, score. Recordings without speech give none.
    """
    found = folds.regions(scores) if max_ms is None else folds.binarize(scores, max_ms=max_ms)
    chunks = folds.merge_chunks(found.withColumnRenamed("region", "seg_idx"), chunk_ms)
    return plugins.TRANSCRIBERS.apply(chunks.select("recording_id", "chunk", "start_ms", "end_ms"), transcriber)


def align_words(segments: DataFrame, dictionary: dict[str, int], aligner: str, spaced: bool = True, blank: int = 0) -> DataFrame:
    """Words with times: id, word_idx, word, start_ms, end_ms, score.

    segments: id, text, start_ms, end_ms. The aligner gets id, start_ms, end_ms and
    tokens, and returns id, emission and tokens. Characters the dictionary lacks
    match anything but the blank. Segments that can't be aligned give no words.
    """
    codes = F.create_map(*(F.lit(x) for pair in dictionary.items() for x in pair))
    clean = align.clean_characters(segments, spaced=spaced).withColumn("token", F.coalesce(F.try_element_at(codes, F.col("char")), F.lit(-1)))
    listed = F.array_sort(F.collect_list(F.struct("char_idx", "token")))
    wanted = clean.groupBy("id").agg(F.transform(listed, lambda x: x["token"]).alias("tokens"), F.transform(listed, lambda x: x["char_idx"]).alias("places"))
    asked = wanted.join(segments.select("id", "start_ms", "end_ms"), "id")
    emitted = plugins.ALIGNERS.apply(asked.select("id", "start_ms", "end_ms", "tokens"), aligner)
    runs = ctc.merge_repeats(ctc.paths(emitted, blank))
    frames = emitted.select("id", F.size("emission").alias("frames"))
    at = lambda c: F.col("start_ms") + align.frame_ms(F.col(c), F.col("end_ms") - F.col("start_ms"), F.col("frames"))
    timed = runs.join(frames, "id").join(asked, "id").select("id", F.get("places", F.col("token")).alias("char_idx"), at("from").alias("c_start"), at("to").alias("c_end"), "score")
    chars = align.characters(segments, spaced=spaced).join(timed, ["id", "char_idx"], "left").withColumnsRenamed({"c_start": "start_ms", "c_end": "end_ms"})
    aligned = chars.join(timed.select("id").distinct(), "id", "left_semi")
    return interpolate.fill_gaps(align.words(aligned), ["id"], "word_idx", ["start_ms", "end_ms"])
