"""Personal data by candidate gradient boosting, in DataFrame operations only.

Exact patterns give the base spans. Broader generators propose further,
overlapping candidates, and boosted trees score each by its format and the words
before it. The trees learn from spans whose nature is known by how they were made:
generated spans and look-alikes in contexts that point to them or away from them,
the base spans of a bounded sample of documents, respelled in their own
contexts, and the sample's numbers that break a kind's check. On the other half
of these, a kind's threshold is the least score above which nearly all candidates
are good; where a kind has few, the share of all kinds counts in. The trees become
one SQL expression, so that one pass over the texts finds, scores and redacts.
Labelled candidates are sorted into one task for the fit (a bounded sample), so a
table gives the same trees on any number of cores and in any partitioning.

Defined results: null text is empty; repeated rows count each; a table without
personal data still has a model, from the generated examples; of accepted
candidates that overlap the one of highest score stays; columns named ``base``
and ``spans`` are replaced, and ones named ``_all``, ``_new`` or ``_b_`` and a kind dropped; very long texts are read whole;
an empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii_examples import COUNTER, HINTS, examples, respelled
from .scratch import Scratch
from .spans import SPAN, digits, digest, find, luhn

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. A run is entered only at its begin or where the last match ended, which finds the same matches
#: faster; possessive repeats match the same too, and run on long texts without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates: the same things as people also write them.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}",
    "card": r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00|\()?[0-9][0-9 ().\/-]{7,18}[0-9](?![0-9])",
}
#: Most documents, on average, that the model sees; they are chosen by a hash of their ids.
SAMPLE = 20_000
#: Generated examples of each kind.
EXAMPLES = 3_000
#: Most labelled candidates that a model is fitted on and measured with, chosen by a hash of what they are.
LABELLED = 200_000
#: Share of good ones among the candidates above a threshold.
PRECISION = 0.98
#: Candidates of all kinds that count with a kind's own when its threshold is set.
PRIOR = 30.0
BEFORE = 24
#: Names of the features, in order; the last two are the context.
FEATURES = (
    "kind", "length", "digits", "others", "joined_before", "joined_after", "luhn", "spaces", "at_sign", "prefix", "groups", "date", "book", "end", "sentence", "octets", "largest", "first_group", "dots", "number_first", "longest", "slashes",
    "hint", "counter",
)


def _valid_ip(s: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind that its fixed pattern and check accept."""
    digit = text.rlike("[0-9]")
    n = lambda s: F.length(digits(s["text"]))
    return {
        "email": find(text, EMAIL, text.contains("@")),
        "ip": F.filter(find(text, IP, digit), lambda s: _valid_ip(s["text"])),
        "card": F.filter(find(text, CARD, digit), lambda s: n(s).between(14, 19) & luhn(digits(s["text"]))),
        "phone": F.filter(find(text, PHONE, text.contains("+")), lambda s: n(s).between(10, 15)),
    }


def _words(values) -> str:
    return r"(?<![a-z])(?:" + "|".join(re.escape(v) for v in sorted(values, key=len, reverse=True)) + r")(?![a-z])"


def _features(text: Column, kind: int, s: Column) -> Column:
    word = lambda c: F.coalesce(c.rlike("^[A-Za-z0-9]$"), F.lit(False))
    span = s["text"]
    number = digits(span)
    groups = F.filter(F.split(span, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    before = F.lower(F.substring(text, F.greatest(s["start"] - BEFORE + 1, F.lit(1)), F.least(s["start"], F.lit(BEFORE))))
    end = F.regexp_extract(span, r"([A-Za-z0-9-]+)$", 1)
    prefix = F.when(span.startswith("+"), 1).when(span.startswith("(0"), 2).when(span.startswith("("), 3).when(span.startswith("00"), 4).when(span.startswith("0"), 5).otherwise(0)
    values = {
        "kind": F.lit(kind), "length": F.length(span), "digits": F.length(number), "others": F.length(F.regexp_replace(span, "[A-Za-z0-9]", "")),
        "joined_before": word(F.substring(text, s["start"], F.lit(1))) & (s["start"] > 0), "joined_after": word(F.substring(text, s["end"] + 1, F.lit(1))),
        "luhn": luhn(number), "spaces": F.regexp_count(span, F.lit(" ")), "at_sign": F.when(span.rlike(r"[(\[]at[)\]]"), 2).when(span.rlike(" @|@ "), 1).otherwise(0), "prefix": prefix, "groups": F.size(groups),
        "date": span.rlike(r"(?<![0-9])(?:(?:19|20)\d\d[-/.](?:0?[1-9]|1[0-2])[-/.][0-3]?\d|[0-3]?\d[-/.][01]?\d[-/.](?:19|20)\d\d|(?:19|20)\d\d-(?:19|20)\d\d)"), "book": number.rlike("^97[89]") & (F.length(number) == 13),
        "end": F.when(end.rlike("^[a-z]{2,6}$"), 2).when(end.rlike("^[A-Z][a-z]+$"), 1).otherwise(0), "sentence": span.rlike(r"[a-z0-9] ?\. +\S+$") & ~span.rlike(r" \. "),
        "octets": F.size(groups) == 4, "largest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.substring(g, 1, 6).cast("int"))), F.lit(0)),
        "first_group": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)), "dots": F.regexp_count(span, F.lit(r"\.")), "number_first": span.rlike("^[0-9]+[^A-Za-z0-9]"),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)), "slashes": F.regexp_count(span, F.lit("/")),
        "hint": before.rlike(_words(HINTS[KINDS[kind]])), "counter": before.rlike(_words(COUNTER)),
    }
    return F.array(*(values[name].cast("double") for name in FEATURES))


def candidates(text: Column, base: dict[str, Column] | None = None) -> Column:
    """All proposed spans that aren't base spans: (kind, start, end, features)."""
    digit = text.rlike("[0-9]")
    test = {"email": text.rlike(r"@|\(at\)|\[at\]"), "ip": digit, "card": digit, "phone": digit}

    def of(k: int, kind: str) -> Column:
        known = lambda s: F.exists(base[kind], lambda b: (b["start"] == s["start"]) & (b["end"] == s["end"])) if base else F.lit(False)
        wide = F.filter(find(text, WIDE[kind], test[kind]), lambda s: ~known(s))
        return F.transform(wide, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _features(text, k, s).alias("features")))

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def _broken(c: Column, text: Column) -> Column:
    """Whether a candidate breaks the check of its kind, whatever stands around it."""
    span = F.substring(text, c["start"] + 1, c["end"] - c["start"])
    n = F.length(digits(span))
    return F.when(c["kind"] == 1, ~_valid_ip(F.regexp_replace(span, " ", ""))).when(c["kind"] == 2, ~luhn(digits(span))).when(c["kind"] == 3, (n < 7) | (n > 15)).otherwise(F.lit(False))


class Trees:
    """Boosted trees as rules over a feature array, with a threshold for each kind."""

    def __init__(self, trees: list[tuple[float, list]], thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, features: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, limit, low, high = node
            return F.when(features[feature] <= limit, value(low)).otherwise(value(high))

        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + value(tree) * weight
        return total

    def margin(self, c: Column) -> Column:
        """How far a candidate's score lies above its kind's threshold; null without one."""
        limit = F.lit(None).cast("double")
        for kind, t in self.thresholds.items():
            limit = F.when(c["kind"] == kind, F.lit(t)).otherwise(limit)
        return self.score(c["features"]) - limit

    def used(self) -> set[str]:
        """Names of the features that the trees split on."""
        def of(node) -> set[int]:
            return {node[0]} | of(node[2]) | of(node[3]) if isinstance(node, tuple) else set()

        return {FEATURES[i] for _, tree in self.trees for i in of(tree)}


def _parse(text: str) -> list[tuple[float, list]]:
    """The trees in a fitted model's printed form."""
    trees = []
    for weight, body in re.findall(r"Tree \d+ \(weight ([-\d.Ee]+)\):\n(.*?)(?=\n\s*Tree |\Z)", text, re.S):
        lines = [x.strip() for x in body.strip().split("\n")]

        def node():
            line = lines.pop(0)
            if m := re.match(r"Predict: (.*)", line):
                return float(m[1])
            m = re.match(r"If \(feature (\d+) <= (.*)\)", line)
            low = node()
            lines.pop(0)
            return int(m[1]), float(m[2]), low, node()

        trees.append((float(weight), node()))
    return trees


def labelled(docs: DataFrame, doc: str, text: str, sample: int = SAMPLE, made: int = EXAMPLES) -> DataFrame:
    """Rows (held, kind, features, label, weight): candidates of known nature, half of them held out."""
    spark = docs.sparkSession
    shown = examples(spark, made).withColumn("c", F.explode(candidates(F.col("text"))))
    mine = (F.col("c.kind") == F.col("kind")) & F.col("good")
    exact = (F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end"))
    shown = shown.where(~mine | exact).select("id", "c", mine.cast("double").alias("label"), F.lit(True).alias("made"))
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.lit("pii"), F.col(doc)), F.lit(1 << 20)).cast("double") / (1 << 20)
    chosen = docs.where(draw < min(1.0, sample / max(n, 1))).select(F.xxhash64(F.col(doc)).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chosen = chosen.withColumns({f"b_{k}": c for k, c in base_spans(F.col("text")).items()})
    # Base spans in other spellings, where they stand.
    def numbered(k: int, kind: str) -> Column:
        return F.transform(f"b_{kind}", lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("at"), s["end"].alias("to"), s["text"].alias("span")))

    spans = F.concat(*(numbered(k, kind) for k, kind in enumerate(KINDS)))
    own = chosen.select("id", "text", F.explode(spans).alias("s")).select(F.xxhash64("id", "s.at").alias("id"), "s.k", F.substring("text", F.greatest(F.col("s.at") - 39, F.lit(1)), F.least(F.col("s.at"), F.lit(40))).alias("before"), F.col("s.span").alias("span"), F.substring("text", F.col("s.to") + 1, F.lit(20)).alias("after"))
    other = F.lit(None).cast("string")
    for k, kind in enumerate(KINDS):
        other = F.when(F.col("k") == k, respelled(kind, F.col("span"))).otherwise(other)
    own = own.withColumn("span", other).select("id", "k", F.length("before").alias("start"), F.length(F.concat("before", "span")).alias("end"), F.concat("before", "span", "after").alias("text"))
    own = own.withColumn("c", F.explode(candidates(F.col("text")))).where("c.kind = k and c.start = start and c.end = end").select("id", "c", F.lit(1.0).alias("label"))
    broken = chosen.select("id", "text", F.explode(candidates(F.col("text"), {k: F.col(f"b_{k}") for k in KINDS})).alias("c")).where(_broken(F.col("c"), F.col("text")))
    found = own.unionByName(broken.select(F.xxhash64("id", "c.start").alias("id"), "c", F.lit(0.0).alias("label"))).withColumn("made", F.lit(False))
    rows = shown.unionByName(found).select((F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)) == 0).alias("held"), "made", F.col("c.kind").alias("kind"), F.col("c.features").alias("features"), "label")
    # The trees must not depend on how many cores there are: these rows go to one task in one order, up to a bound.
    rows = Scratch(spark, "pii").keep(rows.orderBy(F.xxhash64("kind", "features", "label"), "kind", "features", "label", "held", "made").limit(LABELLED), "labelled")
    rows = rows.repartition(1).sortWithinPartitions("kind", "features", "label", "held", "made")
    # What the sample shows weighs a quarter of the generated examples at most, however large it is.
    total = {r["made"]: r["count"] for r in rows.groupBy("made").count().collect()}
    weight = min(1.0, total.get(True, 0) / (4.0 * max(total.get(False, 0), 1)))
    return rows.withColumn("weight", F.when(F.col("made"), 1.0).otherwise(weight))


def fit(docs: DataFrame, doc: str, text: str, sample: int = SAMPLE, precision: float = PRECISION) -> Trees:
    """Fit on one half of the labelled candidates; the other half sets the thresholds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = labelled(docs, doc, text, sample)
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=1, maxBins=64, weightCol="weight").fit(rows.where("not held").select(array_to_vector("features").alias("features"), "label", "weight"))
    trees = Trees(_parse(model.toDebugString), {})
    scores = rows.where("held").groupBy("kind", F.floor(F.transform(F.array("features"), trees.score)[0] * 50).alias("score")).agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect()
    for kind in range(len(KINDS)):
        for score in sorted({r["score"] for r in scores}, reverse=True):
            above = [r for r in scores if r["score"] >= score]
            share = sum(r["good"] for r in above) / sum(r["n"] for r in above)
            mine = [r for r in above if r["kind"] == kind]
            good, n = sum(r["good"] for r in mine), sum(r["n"] for r in mine)
            if good + PRIOR * share >= precision * (n + PRIOR) and score > 0:
                trees.thresholds[kind] = score / 50
    return trees


def find_pii(docs: DataFrame, doc: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The input with columns ``base`` and ``spans``: structs of a list of (start, end, text) for each kind."""
    model = fit(docs, doc, text, sample)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = {k: F.col(f"_b_{k}") for k in KINDS}
    rows = docs.withColumns({f"_b_{k}": c for k, c in base_spans(t).items()})
    apart = lambda c: ~F.exists(F.concat(*base.values()), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    scored = F.transform(F.filter(candidates(t, base), apart), lambda c: F.struct(model.margin(c).alias("margin"), (-c["start"]).alias("first"), (-c["kind"]).alias("k"), c["end"].alias("end")))
    rows = rows.withColumn("_all", F.filter(scored, lambda c: c["margin"] >= 0))
    beaten = lambda c: F.exists("_all", lambda d: (-d["first"] < c["end"]) & (-c["first"] < d["end"]) & (d > c))
    rows = rows.withColumn("_new", F.filter("_all", lambda c: ~beaten(c)))
    cut = lambda c: F.struct((-c["first"]).alias("start"), c["end"].alias("end"), F.substring(t, 1 - c["first"], c["end"] + c["first"]).alias("text"))

    def with_new(k: int, kind: str) -> Column:
        return F.concat(base[kind], F.transform(F.filter("_new", lambda c: c["k"] == -k), cut).cast(SPAN))

    found = {kind: with_new(k, kind) for k, kind in enumerate(KINDS)}
    rows = rows.withColumn("base", F.struct(*(base[k].alias(k) for k in KINDS))).withColumn("spans", F.struct(*(found[k].alias(k) for k in KINDS)))
    return rows.drop("_all", "_new", *(f"_b_{k}" for k in KINDS))


def digests(found: DataFrame) -> dict[str, Column]:
    """Counts and digests of the spans of ``find_pii``."""
    base = [(k, F.col("base")[k]) for k in KINDS]
    return {f"n_{k}": F.size(c).cast("long") for k, c in base} | {"base_sha256": F.sha2(digest(base), 256), "spans": digest([(k, F.col("spans")[k]) for k in KINDS])}


def redact(text: Column, spans: Column) -> Column:
    """The text with each span of ``find_pii`` replaced by its kind in brackets; null stays null."""

    def tagged(kind: str) -> Column:
        return F.transform(spans[kind], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag")))

    listed = F.array_sort(F.concat(*map(tagged, KINDS)))
    t = text.cast("string")

    def build(x: Column) -> Column:
        ends = F.transform(x, lambda s: s["end"])
        upto = lambda i: F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0))
        pieces = F.transform(x, lambda s, i: F.when(s["start"] >= upto(i), F.concat(F.substring(t, upto(i) + 1, s["start"] - upto(i)), s["tag"])).otherwise(""))
        return F.concat(F.array_join(pieces, ""), F.substring(t, F.array_max(ends) + 1, F.length(t)))

    return F.when(t.isNotNull() & (F.size(listed) > 0), F.transform(F.array(listed), build)[0]).otherwise(t)
