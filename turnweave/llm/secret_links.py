"""Secrets by multipart credential linking, in DataFrame operations only.

Exact patterns give the base spans. Long mixed tokens are only weak candidates:
one is reported when an identifier (a user, client or access key id) and an
endpoint, or an access key id alone, stand within ``SCOPE`` characters of it in
the same text. The ends of parts are dealt out to bins as wide as the scope, and
those of tokens to the bins within a scope of them; they are joined on text and bin
with the distance as a further condition, so a long text with many parts makes no
more pairs than fit into a few bins.

Defined results: null text is empty; repeated rows count each; very long texts are read
whole; only the id and the text are read, so other columns' names don't matter; an empty table
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .spans import SPAN, digest, find

KINDS = ("assign", "access", "hex")
#: Fixed patterns.
KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = KEY + r"[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
#: Parts of a credential.
IDENTIFIER = r"""(?i:client_?id|user(?:name)?|login|account|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?i:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[a-z0-9.-]{4,})"""
WEAK = r"[A-Za-z0-9+/_=-]{20,}"
SCOPE = 400


def base_spans(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    word = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api")
    return {
        "assign": F.filter(find(text, ASSIGN, word), lambda s: F.length(F.regexp_replace(s["text"], "^" + KEY, "")) >= 12),
        "access": F.filter(find(text, ACCESS, text.contains("AKIA")), lambda s: F.length(s["text"]) >= 18),
        "hex": find(text, HEX),
    }


def parts(text: Column, base: dict[str, Column]) -> dict[str, Column]:
    """Identifiers and endpoints, and weak candidates in texts that have either."""
    low = F.lower(text)
    named = low.contains("id") & low.rlike("client_?id|access_?key_?id") | low.contains("user") | low.contains("login") | low.contains("account")
    reached = text.contains("://") | low.contains("host") | low.contains("endpoint") | low.contains("server") | low.contains("url")
    identifier, endpoint = find(text, IDENTIFIER, named), find(text, ENDPOINT, reached)
    mixed = lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]") & ~s["text"].rlike("^[A-Z][a-z]+$")
    return {"identifier": identifier, "endpoint": endpoint, "weak": F.filter(find(text, WEAK, named | reached | text.contains("AKIA")), mixed)}


def _linked(rows: DataFrame, scope: int) -> DataFrame:
    """Rows (row, spans): weak candidates that complement other parts of a credential."""
    base = F.concat(*(F.col(k) for k in KINDS))
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    weak = rows.select("row", F.explode(F.filter("weak", apart)).alias("w")).select("row", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    other = None
    for kind, column in (("access", "access"), ("identifier", "identifier"), ("endpoint", "endpoint")):
        found = rows.where(F.size("weak") > 0).select("row", F.lit(kind).alias("kind"), F.explode(column).alias("p"))
        other = found if other is None else other.unionByName(found)
    # A part before a candidate ends less than a scope before its start, one after it starts less than that after its end; what lies between their ends doesn't matter.
    at = lambda c: F.floor(F.col(c) / scope)
    weak = weak.withColumn("bin", F.explode(F.array_distinct(F.array(at("start") - 1, at("start"), at("end"), at("end") + 1))))
    other = other.select("row", "kind", F.col("p.start").alias("from"), F.col("p.end").alias("to"))
    other = other.withColumn("bin", F.explode(F.array_distinct(F.array(at("from"), at("to")))))
    near = (F.col("from") < F.col("end") + scope) & (F.col("to") > F.col("start") - scope) & ((F.col("from") >= F.col("end")) | (F.col("to") <= F.col("start")))
    has = lambda kind: F.max(F.col("kind") == kind)
    pairs = weak.join(other, ["row", "bin"]).where(near).groupBy("row", "start", "end").agg(has("access").alias("a"), has("identifier").alias("i"), has("endpoint").alias("e"))
    return pairs.where("a or (i and e)").groupBy("row").agg(F.collect_list(F.struct("start", "end", F.lit("").alias("text"))).alias("linked"))


def find_secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Rows (doc, assign, access, hex, linked): lists of (start, end, text); ``text`` is empty in the last."""
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns(base_spans(F.col("text")))
    rows = rows.withColumns(parts(F.col("text"), {})).select(F.monotonically_increasing_id().alias("row"), "doc", *KINDS, "identifier", "endpoint", "weak")
    rows = scratch.keep(rows, "parts")  # row numbers stay as they are from here
    linked = _linked(rows, scope)
    found = rows.select("row", "doc", *KINDS).join(linked, "row", "left")
    return found.select(F.col("doc").alias(doc), *KINDS, F.coalesce(F.array_sort("linked"), F.array().cast(SPAN)).alias("linked"))


def digests(found: DataFrame) -> dict[str, Column]:
    base = [(k, F.col(k)) for k in KINDS]
    return {f"n_{k}": F.size(k).cast("long") for k in KINDS} | {"base_sha256": F.sha2(digest(base), 256), "spans": digest([*base, ("linked", F.col("linked"))])}
