"""Which model aligns a language unless the caller names one, and which language a recording is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages whose aligner is a bundle of the audio library.
BUNDLES = {
    "en": "WAV2VEC2_ASR_BASE_960H",
    "fr": "VOXPOPULI_ASR_BASE_10K_FR",
    "de": "VOXPOPULI_ASR_BASE_10K_DE",
    "es": "VOXPOPULI_ASR_BASE_10K_ES",
    "it": "VOXPOPULI_ASR_BASE_10K_IT",
}
#: Languages whose aligner comes from a public hub of models.
HUB = {
    "ja": "jonatasgrosman/wav2vec2-large-xlsr-53-japanese",
    "zh": "jonatasgrosman/wav2vec2-large-xlsr-53-chinese-zh-cn",
    "nl": "jonatasgrosman/wav2vec2-large-xlsr-53-dutch",
    "uk": "Yehor/wav2vec2-xls-r-300m-uk-with-small-lm",
    "pt": "jonatasgrosman/wav2vec2-large-xlsr-53-portuguese",
    "ar": "jonatasgrosman/wav2vec2-large-xlsr-53-arabic",
    "cs": "comodoro/wav2vec2-xls-r-300m-cs-250",
    "ru": "jonatasgrosman/wav2vec2-large-xlsr-53-russian",
    "pl": "jonatasgrosman/wav2vec2-large-xlsr-53-polish",
    "hu": "jonatasgrosman/wav2vec2-large-xlsr-53-hungarian",
    "fi": "jonatasgrosman/wav2vec2-large-xlsr-53-finnish",
    "fa": "jonatasgrosman/wav2vec2-large-xlsr-53-persian",
    "el": "jonatasgrosman/wav2vec2-large-xlsr-53-greek",
    "tr": "mpoyraz/wav2vec2-xls-r-300m-cv7-turkish",
    "da": "saattrupdan/wav2vec2-xls-r-300m-ftspeech",
    "he": "imvladikon/wav2vec2-xls-r-300m-hebrew",
    "vi": "nguyenvulebinh/wav2vec2-base-vi-vlsp2020",
    "ko": "kresnik/wav2vec2-large-xlsr-korean",
    "ur": "kingabzpro/wav2vec2-large-xls-r-300m-Urdu",
    "te": "anuragshas/wav2vec2-large-xlsr-53-telugu",
    "hi": "theainerd/Wav2Vec2-large-xlsr-hindi",
    "ca": "softcatala/wav2vec2-large-xlsr-catala",
    "ml": "gvs/wav2vec2-large-xlsr-malayalam",
    "no": "NbAiLab/nb-wav2vec2-1b-bokmaal-v2",
    "nn": "NbAiLab/nb-wav2vec2-1b-nynorsk",
    "sk": "comodoro/wav2vec2-xls-r-300m-sk-cv8",
    "sl": "anton-l/wav2vec2-large-xlsr-53-slovenian",
    "hr": "classla/wav2vec2-xls-r-parlaspeech-hr",
    "ro": "gigant/romanian-wav2vec2",
    "eu": "stefan-it/wav2vec2-large-xlsr-53-basque",
    "gl": "ifrz/wav2vec2-large-xlsr-galician",
    "ka": "xsway/wav2vec2-large-xlsr-georgian",
    "lv": "jimregan/wav2vec2-large-xlsr-latvian-cv",
    "tl": "Khalsuu/filipino-wav2vec2-l-xls-r-300m-official",
    "sv": "KBLab/wav2vec2-large-voxrex-swedish",
    "id": "cahya/wav2vec2-large-xlsr-indonesian",
}
#: Milliseconds of a recording that its language is detected from.
HEARD_MS = 30_000


def aligner(language: Column, chosen: Column) -> Column:
    """(model, kind): the caller's model, else the language's own; kind is bundle or hub, and null where there is no model."""
    known = F.create_map(*(F.lit(x) for pair in (BUNDLES | HUB).items() for x in pair))
    model = F.coalesce(F.nullif(F.trim(chosen), F.lit("")), F.try_element_at(known, F.coalesce(language, F.lit(""))))
    return F.struct(model.alias("model"), F.when(model.isin(*BUNDLES.values()), "bundle").when(model.isNotNull(), "hub").alias("kind"))


def detected(scores: DataFrame, lengths: DataFrame, heard_ms: int = HEARD_MS) -> DataFrame:
    """Each recording's most probable language: recording_id, language, probability, short.

    scores: recording_id, language, probability (what a detector says of the first ``heard_ms``); lengths: recording_id, length_ms.
    Of equal probabilities the first language in order holds. ``short``: there was less to hear than that.
    """
    best = scores.where("language is not null and probability is not null").groupBy("recording_id").agg(F.min_by(F.struct("language", "probability"), F.struct(-F.col("probability"), F.col("language"))).alias("b"))
    return best.join(lengths, "recording_id", "left").select("recording_id", "b.language", "b.probability", (F.coalesce("length_ms", F.lit(0)) < heard_ms).alias("short"))
