"""Models by language, and languages by a detector's scores."""

from pyspark.sql import functions as F

from turnweave import plugins
from turnweave.functions import aligners


def test_models_of_languages(spark):
    rows = [("en", None), ("ja", ""), ("xx", None), (None, None), ("xx", " mine "), ("de", "VOXPOPULI_ASR_BASE_10K_FR"), ("id", None)]
    df = spark.createDataFrame(rows, "l string, c string").select(aligners.aligner(F.col("l"), F.col("c")).alias("a"))
    assert [(r.a.model, r.a.kind) for r in df.collect()] == [
        ("WAV2VEC2_ASR_BASE_960H", "bundle"), ("jonatasgrosman/wav2vec2-large-xlsr-53-japanese", "hub"), (None, None), (None, None), ("mine", "hub"), ("VOXPOPULI_ASR_BASE_10K_FR", "bundle"), ("cahya/wav2vec2-large-xlsr-indonesian", "hub"),
    ]
    assert len(aligners.BUNDLES) == 5 and len(aligners.HUB) == 36


def test_detected_languages(spark):
    def detect(parts):
        for p in parts:
            yield p.assign(probability=[0.5 if lang != "fr" else 0.2 for lang in p["language"]])[["recording_id", "language", "probability"]]

    plugins.LANGUAGE_DETECTORS.register("fixed", detect)
    asked = spark.createDataFrame([("a", "en"), ("a", "de"), ("a", "fr"), ("b", "fr")], "recording_id string, language string")
    scores = plugins.LANGUAGE_DETECTORS.apply(asked, "fixed").unionByName(spark.createDataFrame([("c", None, 0.9), ("c", "es", None)], "recording_id string, language string, probability double"))
    lengths = spark.createDataFrame([("a", 30_000)], "recording_id string, length_ms long")
    found = {r.recording_id: (r.language, r.probability, r.short) for r in aligners.detected(scores, lengths).collect()}
    assert found == {"a": ("de", 0.5, False), "b": ("fr", 0.2, True)}
