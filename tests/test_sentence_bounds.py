"""Abbreviations and sentence starters learned from texts, and sentences that go on after them."""

import random

from turnweave.operators import sentence_bounds


def corpus():
    rng = random.Random(4)
    words = {"en": "apple river stone walks slowly green house under table many often".split(), "de": "haus fluss stein geht langsam viele unter tisch oft baum".split()}
    rows = []
    for k in range(120):
        lang = ("en", "de")[k % 2]
        out = []
        for _ in range(12):
            said = rng.choices(words[lang], k=rng.randint(4, 9))
            if rng.random() < 0.5:
                said.insert(rng.randint(1, len(said)), rng.choice({"en": ("Dr.", "approx."), "de": ("bzw.", "z.B.")}[lang]) + f" {rng.choice('XY')}{rng.choice(words[lang])}")
            out.append(rng.choice({"en": ("The", "When"), "de": ("Der", "Wenn")}[lang]) + " " + " ".join(said) + ".")
        rows.append((k, lang, " ".join(out)))
    return rows


def test_abbreviations_are_learned_by_language_and_do_not_split(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    learned = {r.lang: r for r in sentence_bounds.learn(df).collect()}
    assert {"dr"} <= set(learned["en"].abbreviations) and {"bzw", "z.b"} <= set(learned["de"].abbreviations)
    assert not set(learned["en"].abbreviations) & {"apple", "river", "table", "bzw", "z.b"}
    assert {"the", "when"} <= set(learned["en"].starters) and {"der", "wenn"} <= set(learned["de"].starters) and "dr" not in learned["en"].starters
    more = [(200, "de", "Der Baum bzw. Xhaus steht. Wenn z.B. Ytisch geht."), (201, "de", "Das war bzw. Der Fluss geht."), (202, "xx", "Bzw. split. Here!  Too"), (203, "en", "By J. Smith. The end."), (204, "de", None), (205, None, "ab. b"), (206, "de", ""), (207, "en", "Dr. Xapple walks. The river ")]
    texts = spark.createDataFrame(more, "id long, lang string, text string")
    found = {}
    for r in sentence_bounds.spans(texts, sentence_bounds.learn(df)).orderBy("id", "sentence").collect():
        found.setdefault(r.id, []).append(dict((i, t) for i, _, t in more)[r.id][r["from"] : r.to])
    assert found == {
        200: ["Der Baum bzw. Xhaus steht.", "Wenn z.B. Ytisch geht."], 201: ["Das war bzw.", "Der Fluss geht."], 202: ["Bzw.", "split.", "Here!", "Too"], 203: ["By J. Smith.", "The end."],
        205: ["ab.", "b"], 207: ["Dr. Xapple walks.", "The river "],
    }
    assert sentence_bounds.learn(df.limit(0)).count() == 0
