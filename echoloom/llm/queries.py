"""The registered queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .divergence import source_divergence
from .exactdedup import exact_duplicates
from .fingerprints import fingerprint_in_order
from .html_extract import extract_main_text
from .importance import resample
from .mixing import draws
from .neardup import near_duplicates
from .packing import pack
from .pii import pseudonymize
from .quality import fit_quality, quality_scores
from .search import search
from .tokencount import count_tokens
from .toxicity import toxicity_scores

#: The public tokenizer whose tokens op10 counts.
TOKENIZER = "name:byte_bpe_50k.json"
#: The key of op2's permutations, for reproducible results here; a deployment passes its own secret.
KEY = b"echoloom example key"


def _held_out():
    """A null id has no label and counts as the empty text, whose sum is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~_held_out())
    scores = toxicity_scores(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), KEY)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, num=80, den=100)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_in_order(table(spark, sf_dir, "documents"))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.filter(F.col("doc_id") % 100 == 0), k=10)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), least_docs=10, terms=10)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_words=20, percent=5, seed=42)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_toxicity,
        op2_pii,
        op3_near_duplicates,
        op4_fingerprints,
        op5_search,
        op6_packing,
        op7_quality,
        op8_html_extraction,
        op9_mixing,
        op10_token_counts,
        op11_source_divergence,
        op12_importance_resampling,
        op13_exact_dedup,
    )
    return {f.__name__: f for f in every}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All pairs that share a shingle, their exact similarities, and what links reach: right, and quadratic.
_NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.y, r.c FROM r JOIN both_ways b ON b.x = r.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n"""


_SOURCE_DIVERGENCE = f"""WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT lang, source, row, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM e GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY ALL),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 2)) // (total + 2 * v) AS HUGEINT) AS p FROM x JOIN t USING (lang, source) JOIN v USING (lang)),
lt AS (SELECT lang, sum(n) AS total FROM x GROUP BY lang),
q AS (SELECT lang, term, CAST(1 + (1000000000 * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS HUGEINT) AS q FROM x JOIN lt USING (lang) JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10"""
_EXACT_DEDUP = f"""SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  coalesce(doc_id = max(doc_id) OVER same, max(doc_id) OVER same IS NULL) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents) WINDOW same AS (PARTITION BY t)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": _NEAR_DUPLICATES, "op11_source_divergence": _SOURCE_DIVERGENCE, "op13_exact_dedup": _EXACT_DEDUP}
