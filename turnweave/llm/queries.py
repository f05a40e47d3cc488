"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chaining import fuzzy_passages

    return fuzzy_passages(_documents(spark, sf_dir))


def op2_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_levels import remove_repeats

    return remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fair_mix import fair_mix

    return fair_mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .edit_match import find_leaks

    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests, find_pii

    found = find_pii(_documents(spark, sf_dir))
    return found.select("doc_id", *(c.alias(name) for name, c in digests(found).items()))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bag_minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir)).select("doc_id", "class_id", "kept")


def op7_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_bayes import keep_good

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(_documents(spark, sf_dir), labels, carry=["doc_id", "source", "lang"])


def op9_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_index import scan_licenses

    found = scan_licenses(_documents(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_links import digests, find_secrets

    found = find_secrets(_documents(spark, sf_dir))
    return found.select("doc_id", *(c.alias(name) for name, c in digests(found).items()))


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_tree import tree_scores

    return tree_scores(_documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(_documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_FAIR_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight
  FROM sized GROUP BY source
), rated AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS rate FROM sources
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM rated WINDOW before AS (ORDER BY rate, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT arg_min(level, rate) AS level FROM levels WHERE level <= rate
), targets AS (
  SELECT r.source, r.source_size, least(r.most, coalesce(c.level * r.weight, r.most)) AS target FROM rated r, chosen c
), timed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS through
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), units AS (
  SELECT CAST(through AS DOUBLE) / target AS finish, size FROM timed WHERE target > 0
  UNION ALL
  SELECT CAST(source_size + through AS DOUBLE) / target, size FROM timed WHERE target > 0
), upto AS (
  SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS words FROM units GROUP BY finish
), cut AS (
  SELECT max(finish) AS last FROM upto WHERE words <= 1.5::DOUBLE * (SELECT sum(size) FROM sized)
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CASE WHEN CAST(through AS DOUBLE) / target <= last THEN 1 ELSE 0 END
                    + CASE WHEN CAST(source_size + through AS DOUBLE) / target <= last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM timed, cut
"""


#: Weighted Jaccard of five-word shingles over all pairs that share one, and what is reachable by links.
_NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w
), c AS (SELECT doc_id, shingle, count(*) AS n FROM s GROUP BY ALL
), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE 10 * m >= 8 * (x.t + y.t - m)
  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id
), e AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node
)
SELECT node AS doc_id, min(root) AS class_id, min(root) = node AS kept FROM reach GROUP BY node
"""

_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), u AS (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS n FROM v
  WHERE x IS NOT NULL AND list_bool_and(list_transform(x, lambda a: a IS NOT NULL AND isfinite(a)))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND a.n > 0 AND b.n > 0 WHERE list_dot_product(a.x, b.x) >= 0.9::DOUBLE * a.n * b.n
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node
)
SELECT node AS vec_id, (SELECT count(*) FROM e WHERE e.a = node) AS n_links, min(root) AS component_id, min(root) = node AS kept FROM reach GROUP BY node
"""


def _licences_sql() -> str:
    """Phrases and notices by comparing every word of a text with every word of them, weighed by document frequencies."""
    from .license_index import BASE, NOTICES, SLACK, WORD, offset, phrases

    number = {p: k for k, p in enumerate(phrases())}
    members = ", ".join(f"({k}, {j}, '{w}', {len(p.split())})" for p, k in number.items() for j, w in enumerate(p.split()))
    keys = ", ".join(f"({i}, {number[p]}, {j}, {offset(p, notice)}, {len(own)})" for i, (_, own, notice) in enumerate(NOTICES) for j, p in enumerate(own))
    words = ", ".join(f"({i}, {j}, '{w}')" for i, (*_, notice) in enumerate(NOTICES) for j, w in enumerate(notice.split()))
    labels = ", ".join(f"({i}, '{label}')" for i, (label, *_) in enumerate(NOTICES))
    base = ", ".join(f"({number[p]}, '{label}')" for p, label in BASE.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), member(phrase, j, word, size) AS (VALUES {members}
), key_(notice, phrase, part, shift, parts) AS (VALUES {keys}
), noticed(notice, j, word) AS (VALUES {words}
), named(notice, label) AS (VALUES {labels}
), base(phrase, label) AS (VALUES {base}
), vocabulary AS (SELECT word FROM member UNION SELECT word FROM noticed
), p AS (
  SELECT * FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM d) SEMI JOIN vocabulary USING (word)
), weights AS (
  SELECT word, ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT r) + 0.5)) + 0.01 AS weight FROM vocabulary LEFT JOIN p USING (word) GROUP BY word
), starts AS (
  SELECT r, phrase, place - j AS s FROM p JOIN member USING (word) GROUP BY r, phrase, place - j HAVING count(*) = max(size)
), parts AS (SELECT r, notice, part, parts, s - shift AS b FROM starts JOIN key_ USING (phrase)
), begins AS (
  SELECT f.r, f.notice, f.b FROM parts f LEFT JOIN parts g ON g.r = f.r AND g.notice = f.notice AND g.part > 0 AND abs(g.b - f.b) <= {SLACK}
  WHERE f.part = 0 GROUP BY f.r, f.notice, f.b HAVING count(DISTINCT g.part) = max(f.parts) - 1
), found AS (
  SELECT r, notice, b, sum(weight) AS found FROM begins JOIN noticed n USING (notice) JOIN p USING (r, word) JOIN weights USING (word) WHERE p.place = b + n.j GROUP BY r, notice, b
), totals AS (SELECT notice, sum(weight) AS total FROM noticed JOIN weights USING (word) GROUP BY notice
), more AS (
  SELECT r, least(1.0, max(found / total)) AS score FROM found JOIN totals USING (notice) GROUP BY r
), places AS (
  SELECT r, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM starts JOIN base USING (phrase) GROUP BY r
), every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM starts JOIN base USING (phrase) UNION SELECT r, label FROM begins JOIN named USING (notice)) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN places USING (r) LEFT JOIN every USING (r) LEFT JOIN more USING (r)
"""


def _secrets_sql() -> str:
    """Places by the lengths of the texts between matches; parts linked by comparing all of a text's."""
    from .secret_links import ACCESS, ASSIGN, ENDPOINT, HEX, IDENTIFIER, KEY, SCOPE, WEAK

    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "endpoint": ENDPOINT, "weak": WEAK}
    each = " UNION ALL ".join(f"SELECT r, {k} AS k, '{name}' AS kind, string_split_regex(x, {quoted(p)}) AS between, regexp_extract_all(x, {quoted(p)}) AS found FROM d" for k, (name, p) in enumerate(kinds.items()))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents
), each_ AS ({each}
), placed AS (
  SELECT r, k, kind, m, CAST(list_sum(list_transform(between[1:j], lambda b: length(b))) + coalesce(list_sum(list_transform(found[1:j - 1], lambda b: length(b))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(found) AS m, generate_subscripts(found, 1) AS j FROM each_)
), spans AS (
  SELECT r, k, kind, s, s + length(m) AS e FROM placed WHERE CASE kind
    WHEN 'assign' THEN length(regexp_replace(m, {quoted("^" + KEY)}, '')) >= 12 WHEN 'access' THEN length(m) >= 18
    WHEN 'weak' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') ELSE true END
), base AS (SELECT * FROM spans WHERE k < 3
), weak AS (
  SELECT r, s, e FROM spans w WHERE kind = 'weak' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND w.s < b.e)
), near AS (
  SELECT w.r, w.s, w.e, bool_or(p.kind = 'access') AS a, bool_or(p.kind = 'identifier') AS i, bool_or(p.kind = 'endpoint') AS n
  FROM weak w JOIN spans p ON p.r = w.r AND p.kind IN ('access', 'identifier', 'endpoint') AND p.s < w.e + {SCOPE} AND p.e > w.s - {SCOPE} AND (p.s >= w.e OR p.e <= w.s) GROUP BY ALL
), listed AS (
  SELECT r, k, kind, s, e FROM base UNION ALL SELECT r, 3, 'linked', s, e FROM near WHERE a OR (i AND n)
), joined AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM listed GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (r)
"""


#: Shares of all kept terms in all groups, and every pair of sources term by term.
_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), w AS (SELECT r, lang, source, unnest(t) AS term FROM d
), counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL
), kept AS (SELECT lang, term, sum(n) AS total FROM counts GROUP BY lang, term HAVING sum(docs) >= 30
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT c.lang, source, term, c.n, CAST(1 + (1000000000::HUGEINT * (c.n + 5)) // (sum(c.n) OVER (PARTITION BY c.lang, source) + 5 * v.v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (c.total + 5)) // (v.n + 5 * v.v) AS BIGINT) AS q
  FROM c JOIN v ON v.lang = c.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), all_ AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM all_
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: Each filter of each order judged by comparing all documents of a part with all orders.
_FILTERS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lowest AS (SELECT text, min(doc_id) AS lowest FROM d GROUP BY text
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1
), m AS (
  SELECT part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > lowest THEN 16 ELSE 0 END) AS mask,
         doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM toxic WHERE doc_id IS NOT NULL) AS toxic
  FROM d JOIN lowest USING (text)
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM m GROUP BY part, mask
), letter(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before FROM orders, range(1, 6) r(step)
), rows_ AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(g) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(t) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM c, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM rows_
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_fair_mix": _FAIR_MIX_SQL, "op6_bag_minhash": _NEAR_SQL, "op7_itq": _VECTORS_SQL, "op9_license_index": _licences_sql(), "op10_linked_secrets": _secrets_sql(), "op12_source_divergence": _DIVERGENCE_SQL, "op13_filter_audit": _FILTERS_SQL}
