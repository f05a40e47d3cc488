"""Licences by a positional index of rare words, in DataFrame operations only.

A text's words are numbered. How many texts have each word of the licence
notices gives its weight, ln((texts + 1) / (texts with it + 0.5)). The index lists
for each rare word the phrases that it is the rarest word of, and its offset
there. A text looks up the words it has, so that only phrases whose rarest word
it has are fetched; the word's place minus its offset is where the phrase would
begin, and the phrase stands there if the text has each other word at its offset.

A notice counts where its first key phrase stands and each further one within
``SLACK`` words of its place. The notice's other words are then looked up at
their places relative to that: the score is the share of its weight found, the
greatest of all notices.

Defined results: null text is empty; a text without a phrase has no labels,
null places and score 0; repeated rows count each; columns besides id and text
don't matter; an empty table gives none.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import BASE, NOTICES
from .scratch import Scratch

#: A word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words by which the key phrases of one notice may be shifted against each other.
SLACK = 30


def phrases() -> list[str]:
    """All phrases that are looked for: the base's first."""
    return list(dict.fromkeys([*BASE, *(p for _, keys, _ in NOTICES for p in keys)]))


def vocabulary() -> list[str]:
    return sorted({w for text in [*BASE, *(notice for *_, notice in NOTICES)] for w in text.split()} | {w for p in phrases() for w in p.split()})


def offset(phrase: str, notice: str) -> int:
    """Words of a notice before a phrase of it."""
    return len(f" {notice} ".split(f" {phrase} ")[0].split())


def _table(rows: DataFrame, columns: list[tuple[str, list]]) -> DataFrame:
    """A small table of fixed values, as columns of literals."""
    values = F.arrays_zip(*(F.array(*map(F.lit, v)).alias(name) for name, v in columns))
    return rows.sparkSession.range(1).select(F.explode(values).alias("v")).select(*(F.col("v")[name].alias(name) for name, _ in columns))


def _starts(postings: DataFrame, weight: dict[str, float]) -> DataFrame:
    """Rows (row, phrase, start): places where a phrase stands."""
    entries, members = [], []
    for k, phrase in enumerate(phrases()):
        own = phrase.split()
        rarest = max(range(len(own)), key=lambda j: (weight[own[j]], -j))
        entries.append((own[rarest], k, rarest, len(own)))
        members += [(k, j, w) for j, w in enumerate(own) if j != rarest]
    index = _table(postings, [(n, [e[i] for e in entries]) for i, n in enumerate(("word", "phrase", "shift", "size"))])
    found = postings.join(F.broadcast(index), "word").select("row", "phrase", (F.col("place") - F.col("shift")).alias("start"), "size")
    rest = _table(postings, [(n, [m[i] for m in members]) for i, n in enumerate(("phrase", "shift", "word"))])
    wanted = found.join(F.broadcast(rest), "phrase").select("row", "phrase", "start", "size", (F.col("start") + F.col("shift")).alias("place"), "word")
    whole = wanted.join(postings, ["row", "place", "word"]).groupBy("row", "phrase", "start", "size").agg(F.count("*").alias("n"))
    return whole.where("n = size - 1").select("row", "phrase", "start")


def _notices(starts: DataFrame, postings: DataFrame, weight: dict[str, float]) -> DataFrame:
    """Rows (row, notice, share): notices whose key phrases all stand, and the greatest share of their weight."""
    number = {p: k for k, p in enumerate(phrases())}
    keys = [(i, number[p], j, offset(p, notice), len(own)) for i, (_, own, notice) in enumerate(NOTICES) for j, p in enumerate(own)]
    key = _table(starts, [(n, [k[i] for k in keys]) for i, n in enumerate(("notice", "phrase", "part", "shift", "parts"))])
    parts = starts.join(F.broadcast(key), "phrase").select("row", "notice", "part", "parts", (F.col("start") - F.col("shift")).alias("begin"))
    first = parts.where("part = 0").drop("part")
    # A further phrase may stand near its place: both sides are dealt out to bins, and those that meet are compared.
    slot = F.floor(F.col("begin") / SLACK)
    further = parts.where("part > 0").select("row", "notice", "part", F.col("begin").alias("at"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    met = first.where("parts > 1").withColumn("slot", slot).join(further, ["row", "notice", "slot"]).where(F.abs(F.col("at") - F.col("begin")) <= SLACK)
    met = met.groupBy("row", "notice", "begin", "parts").agg(F.count_distinct("part").alias("n")).where("n = parts - 1")
    begins = first.where("parts = 1").select("row", "notice", "begin").unionByName(met.select("row", "notice", "begin"))
    words = [(i, j, w, weight[w]) for i, (*_, notice) in enumerate(NOTICES) for j, w in enumerate(notice.split())]
    word = _table(starts, [(n, [w[i] for w in words]) for i, n in enumerate(("notice", "shift", "word", "weight"))])
    total = _table(starts, [("notice", list(range(len(NOTICES)))), ("total", [sum(weight[w] for w in notice.split()) for *_, notice in NOTICES])])
    wanted = begins.join(F.broadcast(word), "notice").select("row", "notice", "begin", (F.col("begin") + F.col("shift")).alias("place"), "word", "weight")
    found = wanted.join(postings, ["row", "place", "word"]).groupBy("row", "notice", "begin").agg(F.sum("weight").alias("found"))
    return found.join(F.broadcast(total), "notice").groupBy("row", "notice").agg(F.least(F.lit(1.0), F.max(F.col("found") / F.col("total"))).alias("share"))


def _complete(present: Column) -> Column:
    """Whether a text has all words of some phrase."""
    some = F.lit(False)
    for phrase in phrases():
        some = some | F.forall(F.array(*map(F.lit, sorted(set(phrase.split())))), lambda w: F.array_contains(present, w))
    return some


def scan_licenses(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    scratch = Scratch(docs.sparkSession, "licenses")
    known = vocabulary()
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.withColumn("present", F.array_distinct(F.filter("words", lambda w: w.isin(known))))
    numbered = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda p: p["word"].isin(known))
    rows = rows.select("row", "doc", F.size("words").cast("long").alias("n_words"), "present", F.when(_complete(F.col("present")), numbered).alias("postings"))
    rows = scratch.keep(rows, "texts")  # row numbers stay as they are from here
    frequency = {r["word"]: r["count"] for r in rows.select(F.explode("present").alias("word")).groupBy("word").count().collect()}  # as many as the notices have words
    n = rows.count()
    weight = {w: math.log((n + 1) / (frequency.get(w, 0) + 0.5)) + 0.01 for w in known}
    postings = scratch.keep(rows.where("postings is not null").select("row", F.explode("postings").alias("p")).select("row", "p.place", "p.word"), "postings")
    starts = scratch.keep(_starts(postings, weight), "starts")
    shares = _notices(starts, postings, weight)
    base = _table(rows, [("phrase", list(range(len(BASE)))), ("label", list(BASE.values()))])
    places = starts.join(F.broadcast(base), "phrase").groupBy("row").agg(F.count("*").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"), F.collect_set("label").alias("base"))
    label = _table(rows, [("notice", list(range(len(NOTICES)))), ("label", [x for x, *_ in NOTICES])])
    more = shares.join(F.broadcast(label), "notice").groupBy("row").agg(F.max("share").alias("score"), F.collect_set("label").alias("more"))
    out = rows.select("row", "doc", "n_words").join(places, "row", "left").join(more, "row", "left")
    none = F.array().cast("array<string>")
    base_, more_ = F.coalesce("base", none), F.coalesce("more", none)
    return out.select(
        F.col("doc").alias(doc), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_, more_)), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
