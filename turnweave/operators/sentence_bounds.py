"""Sentence bounds by language: which words with a period are abbreviations, and which words begin sentences, counted over a corpus.

After Kiss and Strunk (2006): a type is an abbreviation if it stands with a period far more often than
tokens do in general (a likelihood ratio), is short, has periods inside, and hardly ever comes without one. A word begins
sentences if it follows a sentence's end far more often than it stands elsewhere. Counts go by
(language, type) with partial sums, so neither a frequent word nor a large language is a hot key; what is
learned is a row a language, and is broadcast: joined by shuffle, all sentences of a language would meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import once

#: Least score of an abbreviation, and least likelihood ratio of a word that begins sentences.
ABBREVIATION, STARTER = 0.3, 30.0
#: Where a sentence may end.
END = r"(?<=[.!?])\s+"


def _plain(token: Column, kept: str = "") -> Column:
    """A token in lower case without marks other than periods, hyphens and ``kept``."""
    return F.lower(F.regexp_replace(token, rf"[^\p{{L}}\p{{N}}.{kept}-]+", ""))


def _type(plain: Column) -> Column:
    return F.rtrim(plain, F.lit("."))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    """ln of p**k * (1 - p)**(n - k), with p kept off 0 and 1."""
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return k * F.ln(p) + (n - k) * F.ln(1 - p)


def learn(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (lang, abbreviations, starters): sorted lists of types. texts: lang, text; null languages are one."""
    # Marks go from whole texts, so that a token costs no pattern of its own; one of marks alone stays as an empty one.
    tokens = F.split(_plain(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "), " "), " ", -1)
    pairs = once(tokens, lambda t: F.arrays_zip(t.alias("w"), F.concat(F.array(F.lit("")), F.slice(t, F.lit(1), F.size(t) - 1)).alias("before")))
    rows = texts.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.explode(pairs).alias("x")).select("lang", "x.w", "x.before")
    after_period = F.col("before").endswith(".")
    rows = rows.select("lang", _type(F.col("w")).alias("type"), F.col("w").endswith(".").alias("period"), F.when(after_period, _type(F.col("before"))).alias("before")).where("type != ''")
    # Types are few; they are kept, since all that follows reads them and Spark would count them anew for each reader.
    counts = rows.groupBy("lang", "type").agg(F.count("*").alias("n"), F.sum(F.col("period").cast("long")).alias("k")).persist()
    whole = counts.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("k").alias("periods"))
    counts = counts.join(F.broadcast(whole), "lang")
    inside = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    size = F.length("type") - inside
    ratio = -2 * (_likelihood(F.col("k"), F.col("n"), F.col("periods") / F.col("all")) - _likelihood(F.col("k"), F.col("n"), F.lit(0.99)))
    score = ratio * F.exp(-size) * (inside + 1) * F.pow(size.cast("double"), -(F.col("n") - F.col("k")))
    short = counts.where((F.col("k") > 0) & ~F.col("type").rlike(r"^[0-9.-]+$") & (size > 0)).where(score >= ABBREVIATION).select("lang", "type")

    # Words after periods are counted in a second pass: pairs of words, which are as many as sentences, never meet in a shuffle.
    follows = rows.where("before is not null").join(F.broadcast(short.withColumnRenamed("type", "before")), ["lang", "before"], "left_anti")
    ends = follows.groupBy("lang", "type").agg(F.count("*").alias("first")).persist()
    breaks = ends.groupBy("lang").agg(F.sum("first").alias("breaks"))
    begins = ends.join(counts.select("lang", "type", "n", "all"), ["lang", "type"]).join(F.broadcast(breaks), "lang")
    first, n, b, every = (F.col(c) for c in ("first", "n", "breaks", "all"))
    rest = (n - first) / F.greatest(every - b, F.lit(1))
    apart = _likelihood(first, b, first / b) + _likelihood(n - first, every - b, rest) - _likelihood(first, b, n / every) - _likelihood(n - first, every - b, n / every)
    starters = begins.where((2 * apart >= STARTER) & (first / b > rest)).select("lang", "type")
    listed = lambda df, name: df.groupBy("lang").agg(F.array_sort(F.collect_set("type")).alias(name))
    out = whole.select("lang").join(listed(short, "abbreviations"), "lang", "left").join(listed(starters, "starters"), "lang", "left")
    none = F.array().cast("array<string>")
    return out.select("lang", F.coalesce("abbreviations", none).alias("abbreviations"), F.coalesce("starters", none).alias("starters"))


def spans(texts: DataFrame, learned: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (id, sentence, from, to): as ``align.sentence_spans``, but a period after an abbreviation or an initial ends no sentence.

    It does if the next word is capitalised and one that begins sentences. texts: id, lang, text; to is exclusive. A
    language that ``learned`` hasn't splits after every mark but an initial's.
    """
    parts = lambda t: F.struct(F.split(t, END, -1).alias("parts"), F.regexp_extract_all(t, F.lit(END), F.lit(0)).alias("gaps"))
    last = lambda part: F.regexp_extract(part, r"(?s)^(?:.*\s)?(\S*)$", 1)
    first = lambda part: F.regexp_extract(part, r"^(\S*)", 1)

    def cut(x: Column) -> Column:
        """Of each part its length, that of the gap after it, its last word and the next one's first."""
        following = lambda k: F.coalesce(first(F.get(x["parts"], k + 1)), F.lit(""))
        return F.transform(x["parts"], lambda part, k: F.struct(F.length(part).alias("n"), F.coalesce(F.length(F.get(x["gaps"], k)), F.lit(0)).alias("gap"), last(part).alias("last"), following(k).alias("following")))

    # What words there are decides in the text's row: parts go on as numbers.
    order = W.partitionBy("id").orderBy("k")
    rows = texts.select("id", F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.posexplode(once(once(F.coalesce(F.col(text), F.lit("")), parts), cut)).alias("k", "x"))
    rows = rows.select("id", "lang", "k", "x.n", "x.gap", _plain(F.col("x.last")).alias("last"), F.col("x.following").rlike(r"^[^\p{L}]*\p{Lu}").alias("capital"), _plain(F.col("x.following")).alias("following"))
    rows = rows.withColumns({"last_type": _type(F.col("last")), "next_type": _type(F.col("following"))})
    # Looked up by hash: in a list they would be searched word by word for each sentence.
    kinds = lambda types, bit: F.transform(types, lambda t: F.struct(t.alias("type"), F.lit(bit).alias("bit")))
    known = learned.select("lang", F.explode(F.concat(kinds("abbreviations", 1), kinds("starters", 2))).alias("x")).groupBy("lang", "x.type").agg(F.bit_or("x.bit").alias("bits"))
    found = lambda name: F.broadcast(known.select("lang", F.col("type").alias(f"{name}_type"), F.col("bits").alias(f"{name}_bits")))
    rows = rows.join(found("last"), ["lang", "last_type"], "left").join(found("next"), ["lang", "next_type"], "left")
    of = lambda name, bit: F.coalesce(F.col(f"{name}_bits"), F.lit(0)).bitwiseAND(bit) > 0
    short = F.col("last").endswith(".") & (of("last", 1) | F.col("last_type").rlike(r"^\p{L}$"))
    starts = F.col("capital") & of("next", 2)
    rows = rows.select("id", "k", "n", "gap", (short & ~starts).alias("goes_on"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"from": F.coalesce(F.sum(F.col("n") + F.col("gap")).over(before), F.lit(0)), "sentence": F.coalesce(F.sum((~F.col("goes_on")).cast("long")).over(before), F.lit(0))})
    rows = rows.groupBy("id", "sentence").agg(F.min("from").alias("from"), F.max(F.col("from") + F.col("n")).alias("to"))
    return rows.where("to > from").select("id", "sentence", F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"))
