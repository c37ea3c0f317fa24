"""One query for each operator, over its whole table, and SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesia.llm import audit, decontam, exactdup, langid, mixing, neardup, phrases, pii, quality, secrets, sharding, suffixes, toxicity
from kinesia.llm._shared import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.external_shuffle(docs, 40, keep=["doc_id"])


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, and how often."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select("doc_id", "_mix.*").where("copies > 0")


def _weights(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _deal(name: str, source: str, parents: str, tie: str) -> str:
    over = f"PARTITION BY {parents}"
    before = f"OVER ({over} ORDER BY cap / w, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) {before}, 0)::HUGEINT AS c, (sum(w) OVER ({over}) - coalesce(sum(w) {before}, 0))::HUGEINT AS wr FROM {source}),
{name}_b AS (SELECT *, cap::HUGEINT * wr <= (b - c) * w AS sat FROM {name}_a),
{name}_c AS (SELECT *, b - coalesce(sum(CASE WHEN sat THEN cap END) OVER ({over}), 0) AS rest, sum(CASE WHEN NOT sat THEN w END) OVER ({over}) AS wu FROM {name}_b),
{name} AS (SELECT * EXCLUDE (c, wr, sat, rest, wu, b), (CASE WHEN sat THEN cap ELSE (rest::HUGEINT * w) // wu::HUGEINT END)::BIGINT AS budget FROM {name}_c)"""


ORACLES["op10_mixing"] = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) = '' THEN 'domain_other'
      ELSE 'domain' || (regexp_extract(source, '([0-9]{{1,9}})', 1)::BIGINT % 4) END AS domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS have, (sum(tokens) * 2)::BIGINT AS cap FROM docs GROUP BY ALL),
top AS (SELECT domain, sum(cap)::BIGINT AS cap, {_weights("domain", mixing.DOMAIN_WEIGHTS)} AS w, 0 AS root,
  (SELECT least(sum(have)::HUGEINT * 3 // 4, sum(cap)) FROM leaves) AS b FROM leaves GROUP BY domain),
{_deal("doms", "top", "root", "domain")},
mid AS (SELECT l.*, d.budget AS b FROM (SELECT domain, lang, sum(cap)::BIGINT AS cap, {_weights("lang", mixing.LANG_WEIGHTS)} AS w FROM leaves GROUP BY domain, lang) l JOIN doms d USING (domain)),
{_deal("langs", "mid", "domain", "lang")},
low AS (SELECT l.*, 1 AS w, m.budget AS b FROM leaves l JOIN langs m USING (domain, lang)),
{_deal("dealt", "low", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, budget AS leaf_budget, CASE WHEN have > 0 THEN budget // have ELSE 0 END AS full_epochs,
  CASE WHEN have > 0 THEN budget % have ELSE 0 END AS need FROM dealt),
keyed AS (SELECT *, md5('7:' || full_epochs || ':' || doc_id) AS k FROM docs JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, tokens, leaf_budget,
  (full_epochs + CASE WHEN need > 0 AND upto <= need THEN 1 ELSE 0 END)::BIGINT AS copies
FROM summed WHERE full_epochs + CASE WHEN need > 0 AND upto <= need THEN 1 ELSE 0 END > 0
"""


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.profiles(docs.where(~langid.held_out())))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op3_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comps AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comps USING (doc_id)
"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


@query
def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.interactions(audit.joint_failures(docs, table(spark, sf_dir, "labels")))


ORACLES["op11_filter_audit"] = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM words),
kinds AS (
  SELECT part, a, b, c, d, e, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic, count(*) AS n
  FROM flags LEFT JOIN labels l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
long AS (SELECT k.*, x, CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails FROM kinds k, letters),
first AS (
  SELECT part, filter_order, instr(filter_order, x) AS step, x, n, good, toxic, fails,
    min(CASE WHEN fails THEN instr(filter_order, x) END) OVER (PARTITION BY part, filter_order, a, b, c, d, e, good, toxic) AS gone,
    sum(fails::INT) OVER (PARTITION BY part, filter_order, a, b, c, d, e, good, toxic) AS n_fails
  FROM long, orders),
steps AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM first GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM steps
"""


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op13_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, (count(*) OVER (PARTITION BY norm))::BIGINT AS group_size,
  doc_id = first(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY c DESC, doc_id)
"""


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLES["op12_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m FROM places, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, phrase, m, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
parts AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
inner_ AS (
  SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, m, k, unnest(range(1, m - k + 2)) AS i FROM parts, (SELECT unnest([2, 3]) AS k) WHERE k < m)),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
left_ AS (SELECT p.* FROM parts p LEFT JOIN longest USING (lang, phrase) WHERE m >= 2 AND (longer IS NULL OR 100 * longer < 80 * a)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM left_)),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, h.a AS l, t.a AS r, ((2000000::HUGEINT * c.a) // (h.a + t.a))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
