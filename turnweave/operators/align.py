"""From characters to words to sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import once, running_sums

#: Characters of a bin when characters meet sentences.
BIN = 256


def characters(texts: DataFrame, text: str = "text", spaced: bool = True) -> DataFrame:
    """Rows (id, char_idx, char, word_idx); a blank has the number of the word after it.

    texts: id, text. Without blanks between words each character is a word. Places
    are summed up over the parts between blanks, of which there are far fewer than
    characters.
    """
    if not spaced:
        chars = texts.select("id", F.posexplode(F.split(F.col(text), "")).alias("char_idx", "char")).where("char != ''")
        return chars.select("id", F.col("char_idx").cast("long").alias("char_idx"), "char", F.col("char_idx").cast("long").alias("word_idx"))
    parts = texts.select("id", F.startswith(F.col(text), F.lit(" ")).cast("int").alias("_blank"), F.posexplode(F.split(F.col(text), " ", -1)).alias("_k", "_part"))
    before = F.sum(F.length("_part") + 1).over(W.partitionBy("id").orderBy("_k").rowsBetween(W.unboundedPreceding, -1))
    # Each part with the blank before it; a blank that begins the text isn't counted.
    parts = parts.withColumn("_at", F.greatest(F.coalesce(before, F.lit(0)) - 1, F.lit(0)))
    own = F.when(F.col("_k") > 0, F.concat(F.lit(" "), F.col("_part"))).otherwise(F.col("_part"))
    chars = parts.select("id", "_at", (F.col("_k") - F.col("_blank")).alias("_word"), F.posexplode(F.split(own, "")).alias("_i", "char")).where("char != ''")
    return chars.select("id", (F.col("_at") + F.col("_i")).alias("char_idx"), "char", F.greatest(F.col("_word"), F.lit(0)).cast("long").alias("word_idx"))


def clean_characters(texts: DataFrame, text: str = "text", spaced: bool = True) -> DataFrame:
    """The characters that are aligned: lower case, blanks as ``|``, none of the white space at the ends."""
    lead = F.length(F.regexp_extract(text, r"(?U)^\s*", 0))
    trail = F.length(text) - F.length(F.regexp_extract(text, r"(?U)\s*$", 0))
    chars = texts.withColumns({"_lead": lead, "_trail": trail}).select("id", "_lead", "_trail", F.posexplode(F.split(F.lower(text), "")).alias("char_idx", "char")).where("char != ''")
    kept = chars.where((F.col("char_idx") >= F.col("_lead")) & (F.col("char_idx") < F.col("_trail")))
    char = F.when(F.col("char") == " ", "|").otherwise(F.col("char")) if spaced else F.col("char")
    return kept.select("id", F.col("char_idx").cast("long").alias("char_idx"), char.alias("char"))


def alignable(segments: DataFrame, clean: DataFrame, length_ms: Column) -> DataFrame:
    """Segments with ``way``: align, or keep as they are for lack of characters or a start past the end."""
    some = clean.select(F.col("id")).distinct().withColumn("_some", F.lit(True))
    way = F.when(F.col("_some").isNull(), "no characters").when(F.col("start_ms") >= length_ms, "past the end").otherwise("align")
    return segments.join(some, "id", "left").withColumn("way", way).drop("_some")


def words(chars: DataFrame) -> DataFrame:
    """Rows of (id, word_idx): text, start, end and score from those of its characters other than blanks.

    chars: id, char_idx, char, word_idx, start_ms, end_ms, score.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_idx", "char"))), lambda x: x["char"]), "")
    score = F.floor(F.avg("score") * 1000 + 0.5) / 1000
    return chars.where("char != ' '").groupBy("id", "word_idx").agg(text.alias("word"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), score.alias("score"))


def word_runs(text: Column, starts: Column, ends: Column, scores: Column, kind: str = "bigint") -> Column:
    """``words`` within a text's row: (word_idx, word, start_ms, end_ms, score) from its characters' starts, ends and scores.

    Nothing is shuffled: a batch's texts and lists lie one after another, and each word is a stretch of them. A list holds
    nothing for a character that has no time (null, or past its end). kind: the type of starts and ends.
    """
    return F.arrow_udf(_word_runs, T.ArrayType(T.StructType.fromDDL(f"word_idx bigint, word string, start_ms {kind}, end_ms {kind}, score double")))(text, starts, ends, scores.cast("array<double>"))


def _values(column: pa.Array, char_row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of characters by row and place in it, and which there are."""
    column = column.cast(pa.list_(column.type.value_type))
    flat, begin = column.values, column.offsets.to_numpy()
    at = begin[:-1].astype(np.int64)[char_row] + place
    there = (at < begin[1:][char_row]) & column.is_valid().to_numpy(zero_copy_only=False)[char_row]
    if flat.null_count:
        there &= np.append(flat.is_valid().to_numpy(zero_copy_only=False), False)[np.where(there, at, len(flat))]
        flat = flat.fill_null(0)
    return np.append(flat.to_numpy(), 0)[np.where(there, at, len(flat))], there


def _word_runs(text: pa.Array, starts: pa.Array, ends: pa.Array, scores: pa.Array) -> pa.Array:
    known = text.is_valid().to_numpy(zero_copy_only=False)
    binary = text.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    first = np.searchsorted(at, offsets - offsets[0])
    row = np.repeat(np.arange(len(text)), np.diff(first))
    blank = data[at] == 0x20
    spoken = np.flatnonzero(~blank)
    # A word begins with its row's first character or after a blank.
    new = np.ones(len(spoken), dtype=bool)
    new[1:] = (np.diff(spoken) > 1) | (row[spoken[1:]] != row[spoken[:-1]])
    begin = np.flatnonzero(new)
    of = row[spoken[begin]]
    blanks = np.concatenate([[0], np.cumsum(blank)])
    index = blanks[spoken[begin]] - blanks[first[of]] - blank[first[of]]
    sizes = np.diff(np.append(at, len(data)))[spoken]
    place = spoken - first[row[spoken]]
    kept = data[data != 0x20]
    cut = np.append(0, np.cumsum(np.add.reduceat(sizes, begin) if len(begin) else sizes)).astype(np.int64)
    words_ = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(kept))]).cast(pa.string())

    def folded(column: pa.Array, fold: np.ufunc, least: bool) -> pa.Array:
        values, there = _values(column, row[spoken], place)
        bound = np.inf if values.dtype.kind == "f" else np.iinfo(values.dtype).max
        values = np.where(there, values, bound if least else -bound).astype(values.dtype)
        some = np.add.reduceat(there.astype(np.int64), begin) > 0 if len(begin) else there
        return pa.array(fold.reduceat(values, begin) if len(begin) else values, column.type.value_type, mask=~some)

    values, there = _values(scores, row[spoken], place)
    total, n = (np.add.reduceat(v, begin) if len(begin) else v.astype(float) for v in (np.where(there, values, 0.0), there.astype(np.int64)))
    mean = np.floor(np.nan_to_num(total / np.maximum(n, 1) * 1000 + 0.5)) / 1000
    fields = [pa.array(np.maximum(index, 0).astype(np.int64)), words_, folded(starts, np.minimum, True), folded(ends, np.maximum, False), pa.array(mean, pa.float64(), mask=n == 0)]
    found = pa.StructArray.from_arrays(fields, names=["word_idx", "word", "start_ms", "end_ms", "score"])
    bounds = pa.array(np.searchsorted(of, np.arange(len(text) + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, found, mask=pa.array(~known))


def sentence_runs(text: Column, starts: Column, ends: Column, strict: bool = False) -> Column:
    """``sentences`` within a text's row: (sentence, text, start_ms, end_ms), by the bounds of ``sentence_spans``."""
    parts = F.split(text, r"(?<=[.!?])\s+", -1)
    gaps = F.regexp_extract_all(text, F.lit(r"(?<=[.!?])\s+"), F.lit(0))
    # A blank's end doesn't count.
    spoken = F.zip_with(ends, F.split(text, ""), lambda e, c: F.when(c != " ", e))

    def cut(x: Column) -> Column:
        places = running_sums(F.zip_with(x["parts"], x["gaps"], lambda p, g: F.length(p) + F.coalesce(F.length(g), F.lit(0))))
        return once(F.struct(x["parts"].alias("parts"), x["starts"].alias("starts"), x["ends"].alias("ends"), places.alias("places")), found)

    def found(x: Column) -> Column:
        numbered = F.transform(x["parts"], lambda p, k: F.struct(k.cast("long").alias("sentence"), p.alias("text"), (F.get(x["places"], k) + 1).cast("int").alias("at"), (F.length(p) + (0 if strict else 1)).alias("n")))
        times = lambda r: F.struct(r["sentence"].alias("sentence"), r["text"].alias("text"), F.array_min(F.slice(x["starts"], r["at"], r["n"])).alias("start_ms"), F.array_max(F.slice(x["ends"], r["at"], r["n"])).alias("end_ms"))
        return F.transform(F.filter(numbered, lambda r: r["text"] != ""), times)

    return once(F.struct(parts.alias("parts"), gaps.alias("gaps"), starts.alias("starts"), spoken.alias("ends")), cut)


def sentence_spans(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows (id, sentence, from, to): split after . ! or ? and white space; to is exclusive."""
    parts = F.split(F.col(text), r"(?<=[.!?])\s+", -1)
    gaps = F.regexp_extract_all(F.col(text), F.lit(r"(?<=[.!?])\s+"), F.lit(0))
    rows = texts.select("id", parts.alias("parts"), gaps.alias("gaps")).select("id", "gaps", F.posexplode("parts").alias("sentence", "part"))
    order = W.partitionBy("id").orderBy("sentence")
    gap = F.coalesce(F.length(F.get("gaps", F.col("sentence"))), F.lit(0))
    rows = rows.withColumn("_whole", F.length("part") + gap)
    start = F.coalesce(F.sum("_whole").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select("id", F.col("sentence").cast("long").alias("sentence"), start.alias("from"), (start + F.length("part")).alias("to")).where("to > from")


def sentences(chars: DataFrame, spans: DataFrame, strict: bool = False) -> DataFrame:
    """Times of each sentence: the least start of its characters, the greatest end of those that aren't blanks.

    As in the reference the character right after a sentence counts too, unless
    ``strict``. Bins of places keep a text's characters from meeting all its sentences.
    """
    inside = (F.col("char_idx") >= F.col("from")) & ((F.col("char_idx") < F.col("to")) if strict else (F.col("char_idx") <= F.col("to")))
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("from") / BIN), F.floor(F.col("to") / BIN))))
    rows = chars.withColumn("_bin", F.floor(F.col("char_idx") / BIN)).join(binned, ["id", "_bin"]).where(inside)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("char_idx") < F.col("to"), F.struct("char_idx", "char")))), lambda x: x["char"]), "")
    return rows.groupBy("id", "sentence").agg(text.alias("text"), F.min("start_ms").alias("start_ms"), F.max(F.when(F.col("char") != " ", F.col("end_ms"))).alias("end_ms"))


def merge_sentences(rows: DataFrame, separator: str = " ") -> DataFrame:
    """Sentences of equal times become one, texts joined in order; without times they go."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "text"))), lambda x: x["text"]), separator)
    timed = rows.where("start_ms is not null and end_ms is not null")
    return timed.groupBy("id", "start_ms", "end_ms").agg(text.alias("text"), F.count("*").alias("n"), F.min("sentence").alias("sentence"))


def flat_words(segments: DataFrame) -> DataFrame:
    """All words of all segments: recording_id, seg_idx, word_idx, global_idx, word, start_ms, end_ms."""
    rows = segments.select("recording_id", "seg_idx", F.posexplode("words").alias("word_idx", "w"))
    place = F.row_number().over(W.partitionBy("recording_id").orderBy("seg_idx", "word_idx")) - 1
    return rows.select("recording_id", "seg_idx", F.col("word_idx").cast("long").alias("word_idx"), place.cast("long").alias("global_idx"), "w.word", "w.start_ms", "w.end_ms")


def frame_ms(frame: Column, length_ms: Column, frames: Column) -> Column:
    """Time of a frame of a trellis over ``length_ms``."""
    return F.floor(frame * length_ms / frames + 0.5).cast("long")
