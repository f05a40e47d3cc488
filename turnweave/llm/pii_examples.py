"""Examples that the PII model learns from, made by SQL functions: spans in known spellings and look-alikes, in contexts.

Labels come from how a text was made, not from any check of the span. Each
example is a function of its number, so every table gets the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import digits, luhn

#: Words that often stand before each kind; and before things that only look like one.
HINTS = {
    "email": ("mail", "e-mail:", "contact", "write to", "mailto", "correo", "schreib an", "reach"), "ip": ("ip", "host", "server", "ip address", "client ip", "login from ip", "adresse ip"),
    "card": ("card", "visa", "credit card", "card number", "karte", "carte", "tarjeta", "mastercard"), "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "ruf an", "llamar", "ring"),
}
COUNTER = ("version", "release", "build", "isbn", "issn", "order", "invoice", "section", "chapter", "since", "price", "score", "sku", "serial", "tracking", "rechnung", "page", "dated", "bestellung", "on", "part no")
NEUTRAL = ("and", "the", "is", "of", "with", "then", "der", "und", "est", "les", "que", "otra", "here", "now", "")
_WORDS = ("me", "noon", "market", "home", "look", "meet", "sell", "buy", "this", "lunch", "two", "once", "work", "gate", "then", "them")
_NEXT = ("Then", "Sell", "We", "It", "And", "But", "Buy", "Call", "They", "So")
_NAMES = ("bob", "anna", "j.smith", "info", "sales", "maria_k", "x.y", "office", "tom99", "lee")
_HOSTS = ("mail", "example", "post", "firma", "my-site", "uni", "corp", "web")
_ENDS = ("com", "org", "net", "de", "fr", "es", "io", "edu")


def _draw(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(key)), F.lit(n))


def _pick(key: str, values) -> Column:
    values = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.element_at(F.array(*values), (_draw(key, len(values)) + 1).cast("int"))


def _number(key: str, n: int) -> Column:
    """``n`` digits, the first not 0."""
    return F.concat((_draw(key + "first", 9) + 1).cast("string"), F.lpad(_draw(key, 10 ** (n - 1)).cast("string"), n - 1, "0")) if n > 1 else (_draw(key, 9) + 1).cast("string")


def _between(key: str, low: int, high: int) -> Column:
    return (_draw(key, high - low + 1) + low).cast("string")


def _two(key: str, low: int, high: int) -> Column:
    return F.lpad(_between(key, low, high), 2, "0")


def _checked(number: Column) -> Column:
    """A number with the last digit that passes the Luhn check."""
    whole = F.transform(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: F.concat(number, d))
    return F.filter(whole, lambda n: luhn(n))[0]


def _unchecked(number: Column, key: str) -> Column:
    """A number with a last digit that fails the Luhn check: what breaks the check is no card, however it is spelled."""
    whole = F.transform(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: F.concat(number, d))
    return F.get(F.filter(whole, lambda n: ~luhn(n)), _draw(key, 9).cast("int"))


def respelled(kind: str, text: Column) -> Column:
    """A span of the exact pattern, written in another way that candidates cover."""
    d = digits(text)
    if kind == "email":
        at, dot = _pick("at", (" (at) ", " [at] ", "(at)", "[at]")), _pick("dot", (".", " (dot) ", " [dot] ", "."))
        return F.concat(F.substring_index(text, "@", 1), at, F.replace(F.substring_index(text, "@", -1), F.lit("."), dot))
    if kind == "ip":
        return F.replace(text, F.lit("."), _pick("dot", (" . ", ". ", " .")))
    if kind == "card":
        return F.regexp_replace(d, "(?<=^.{4}|^.{8}|^.{12})(?=.)", ".")
    body = F.right(d, F.lit(10))
    return _pick("form", (
        F.concat(F.lit("("), F.substring(body, 1, 3), F.lit(") "), F.substring(body, 4, 7)), F.concat(F.substring(body, 1, 3), F.lit("-"), F.substring(body, 4, 3), F.lit("-"), F.substring(body, 7, 4)),
        F.concat(F.lit("00"), d), F.concat(F.lit("0"), F.substring(body, 1, 3), F.lit(" "), F.substring(body, 4, 7)),
    ))


def _good(kind: str) -> list[Column]:
    n = _number
    if kind == "email":
        name, host, end = _pick("name", _NAMES), _pick("host", _HOSTS), _pick("end", _ENDS)
        marks = ((" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), ("@", " . "), (" @ ", " . "))
        return [F.concat(name, F.lit(at), host, F.lit(dot), end) for at, dot in marks]
    if kind == "ip":
        parts = [_between(f"octet{i}", 1, 254) for i in range(4)]
        return [F.concat_ws(dot, *parts) for dot in (" . ", ". ", " .", " . ")]
    if kind == "card":
        first = _pick("brand", ("4", "51", "54", "37", "6011", "4", "4"))
        number = _checked(F.rpad(F.concat(first, n("a", 8), n("b", 7)), 15, "0"))
        four = [F.substring(number, 1 + 4 * i, 4) for i in range(4)]
        return [F.concat_ws(mark, *four) for mark in (".", "/")]
    return [
        F.concat(F.lit("(0"), n("area", 2), F.lit(") "), n("line", 7)), F.concat(F.lit("0"), n("mobile", 3), F.lit(" "), n("line", 7)), F.concat(F.lit("("), n("us", 3), F.lit(") "), n("x", 3), F.lit("-"), n("y", 4)),
        F.concat_ws("-", n("us", 3), n("x", 3), n("y", 4)), F.concat(F.lit("0049 "), n("mobile", 3), F.lit(" "), n("line", 7)), F.concat(F.lit("0"), n("area", 2), F.lit("/"), n("line", 7)),
        F.concat_ws(" ", F.concat(F.lit("0"), n("a1", 1)), n("a2", 2), n("a3", 2), n("a4", 2), n("a5", 2)), F.concat(F.lit("0"), n("mobile", 3), F.lit("-"), n("line", 7)), F.concat_ws(".", n("us", 3), n("x", 3), n("y", 4)),
    ]


def _bad(kind: str) -> list[Column]:
    n = _number
    year, month, day = _between("year", 1950, 2035), _two("month", 1, 12), _two("day", 1, 31)
    if kind == "email":
        word, other, after = _pick("word", _WORDS), _pick("other", _WORDS), _pick("next", _NEXT)
        return [
            F.concat(word, F.lit(" @ "), other, F.lit(". "), after), F.concat(_between("n", 1, 99), F.lit(" @ "), other, F.lit(". "), after), F.concat(word, F.lit(" @ "), _between("p", 1, 99), F.lit("."), _two("c", 0, 99)),
            F.concat(_between("n", 1, 99), F.lit(" @ "), _between("p", 1, 99), F.lit("."), _two("c", 0, 99)), F.concat(word, F.lit(" (at) "), other, F.lit(". "), after), F.concat(word, F.lit(" @ "), other, F.lit(" . "), after),
        ]
    if kind == "ip":
        small = [_between(f"small{i}", 0, 12) for i in range(4)]
        return [F.concat_ws(" . ", *small), F.concat_ws(". ", *small), F.concat_ws(".", small[0], small[1], n("w", 3), n("z", 3)), F.concat_ws(" . ", n("k", 3), n("l", 3), n("m", 3), n("o", 3)), F.concat_ws(" .", *small)]
    if kind == "card":
        wrong = _unchecked(F.concat(n("s", 4), n("t", 4), n("u", 4), n("v", 3)), "wrong")
        fours = [F.substring(wrong, 1 + 4 * i, 4) for i in range(4)]
        return [
            F.concat(F.lit("978-"), n("g", 1), F.lit("-"), n("h", 2), F.lit("-"), n("k", 6), F.lit("-"), n("l", 1)), n("m", 15), F.concat(n("o", 1), F.lit("."), n("p", 14)), F.concat(year, month, day, F.lit(" "), n("r", 8)),
            *(F.concat_ws(mark, *fours) for mark in ("-", ".", "/")),
        ]
    hour, minute = _two("hour", 0, 23), _two("minute", 0, 59)
    return [
        F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), hour), F.concat(day, F.lit("."), month, F.lit("."), year, F.lit(" "), hour), F.concat(year, F.lit("/"), month, F.lit("/"), day, F.lit(" "), hour),
        F.concat(F.lit("978-"), n("g", 1), F.lit("-"), n("h", 2), F.lit("-"), n("k", 6), F.lit("-"), n("l", 1)), F.concat_ws("-", year, _between("later", 1950, 2035), n("q", 3)), F.concat(n("o", 1), F.lit("."), n("p", 9)),
        F.concat_ws(" ", n("s1", 1), F.lit("000"), F.lit("000"), n("s2", 3)), F.concat_ws(" ", n("s1", 3), n("s3", 3), n("s4", 3), n("s5", 3)), F.concat_ws("-", n("t", 4), year, n("u", 4)), n("v", 10),
        F.concat_ws(".", *(_between(f"w{i}", 0, 12) for i in range(6))), F.concat(day, F.lit("/"), month, F.lit("/"), year, F.lit(" "), hour, F.lit("."), minute), F.concat(n("x", 2), F.lit("."), n("y", 6), F.lit(" "), n("z", 2), F.lit("."), n("zz", 4)),
        F.concat(F.lit("979-"), n("g", 2), F.lit("-"), n("h", 4), F.lit("-"), n("k", 3), F.lit("-"), n("l", 1)), F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), F.lit("("), hour, F.lit("."), minute),
    ]


def examples(spark: SparkSession, n: int) -> DataFrame:
    """``n`` rows (id, text, kind, start, end, good) of each kind."""
    out = None
    for k, kind in enumerate(HINTS):
        good = _draw("good", 2) == 0
        hint, counter, neutral = _pick("hint", HINTS[kind]), _pick("counter", COUNTER), _pick("neutral", NEUTRAL)
        # A hint stands before most good ones and some bad ones, a counter-hint before many bad ones. Spaced addresses are good only after a hint.
        share = 100 if kind == "ip" else 70
        before = F.when(good, F.when(_draw("lead", 100) < share, hint).otherwise(neutral)).otherwise(F.when(_draw("lead", 100) < 5, hint).when(_draw("lead", 100) < 55, counter).otherwise(neutral))
        span = F.when(good, _pick("form", _good(kind))).otherwise(_pick("form", _bad(kind)))
        rows = spark.range(n).withColumn("id", F.col("id") * len(HINTS) + k)
        rows = rows.select("id", F.concat(_pick("fill", NEUTRAL), F.lit(" "), _pick("fill2", NEUTRAL), F.lit(" "), before, F.lit(" ")).alias("before"), span.alias("span"), F.concat(_pick("stop", (" ", ", ", ". ", " ")), _pick("after", NEUTRAL), F.lit(" "), _pick("after2", NEUTRAL)).alias("after"), good.alias("good"))
        rows = rows.select("id", F.concat("before", "span", "after").alias("text"), F.lit(k).alias("kind"), F.length("before").alias("start"), F.length(F.concat("before", "span")).alias("end"), "good")
        out = rows if out is None else out.unionByName(rows)
    return out
