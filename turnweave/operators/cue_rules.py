"""How lines of subtitles split in each language, as a table that segments are joined with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import UNSPACED

#: Languages whose scripts take fewer characters a line.
DENSE = ("th", "lo", "my", "km", "am", "ko", "ja", "zh", "ti", "ta", "te", "kn", "ml", "hi", "ne", "mr", "ar", "fa", "ur", "ka")
#: Commas of languages with one of their own.
COMMAS = {"ja": "、", "zh": "，", "fa": "،", "ur": "،"}
#: Words before which a line may split, of four languages; other languages' come as a table of the caller's.
CONJUNCTIONS = {
    "en": "and whether or as but so for nor which yet although since unless when while because if how that than who where what near before after across through until once whereas even both either neither though",
    "fr": "et ou mais parce bien pendant quand où comme si que avant après aussitôt jusqu’à à malgré donc tant puisque ni soit encore dès lorsque",
    "de": "und oder aber weil obwohl während wenn wo wie dass bevor nachdem sobald bis außer trotzdem also sowie indem weder sowohl zwar jedoch",
    "es": "y o pero porque aunque sin mientras cuando donde como si que antes después tan hasta a por ya ni sino",
}
#: Longest line, and the least on both sides of a split: for most languages, and for dense ones.
LINE, DENSE_LINE = (45, 30), (30, 20)


def conjunctions(spark: SparkSession) -> DataFrame:
    """Rows (lang, word) of the built-in languages."""
    return spark.createDataFrame([(lang, word) for lang, words in CONJUNCTIONS.items() for word in words.split()], "lang string, word string")


def rules(languages: DataFrame, words: DataFrame) -> DataFrame:
    """For each language (lang) its row (lang, max_line, least, comma, space, conjunctions); ``words`` as ``conjunctions``."""
    lang = F.col("lang")
    comma = F.lit(",")
    for code, mark in COMMAS.items():
        comma = F.when(lang == code, mark).otherwise(comma)
    known = words.groupBy("lang").agg(F.array_sort(F.collect_set(F.lower("word"))).alias("conjunctions"))
    size = lambda k: F.when(lang.isin(*DENSE), DENSE_LINE[k]).otherwise(LINE[k])
    rows = languages.select("lang").distinct().join(known, "lang", "left")
    return rows.select("lang", size(0).alias("max_line"), size(1).alias("least"), comma.alias("comma"), F.when(lang.isin(*UNSPACED), 0).otherwise(1).alias("space"), F.coalesce("conjunctions", F.array().cast("array<string>")).alias("conjunctions"))
