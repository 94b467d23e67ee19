"""The registered queries of the table function of runs and of merged cubes, and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import cubes, reports, runs
from .operators.repetition import record_of, with_repetition
from .queries import _docs, _FIRST, _pairs, _PAIRS

LONGEST = 32


def loop_runs(spark, d):
    """Every maximal repetition with a period up to 32 in the documents that the detector finds a loop in."""
    looped = with_repetition(_docs(spark, d).select("doc_id", "text")).filter(F.col("hit").isNotNull()).drop("hit")
    found = runs.with_runs(looped, "text", max_period=LONGEST)
    return found.select("doc_id", "start", "end", "period", "repeats", "unit")


def loop_cube(spark, d):
    """Texts and loops by source, status and round, and all sums over them, merged from a cube of each of three rounds."""
    status, _ = record_of(F.col("hit"))
    word = F.regexp_extract("text", r"^\s*(\S+)", 1).alias("word")
    rows = with_repetition(_docs(spark, d).select("doc_id", "source", "text")).select("source", status, (F.col("doc_id") % 3).alias("round"), word)
    counts = {"n_texts": F.lit(1), "n_loops": F.col("status") == "loop_detected"}
    dimensions = ["source", "status", "round"]
    parts = [cubes.cube(rows.filter(F.col("round") == k), dimensions, counts, "word", "word") for k in range(3)]
    whole = cubes.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), dimensions, list(counts))
    return whole.select("level", *dimensions, *counts)


def top_by_column(spark, d):
    """The most frequent tokens and sources, from one pass over the pairs."""
    return reports.top_of_each(_pairs(spark, d), ["token", "source"], 5)


def queries():
    every = (loop_runs, loop_cube, top_by_column)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "loop_runs": f"""{_FIRST},
c AS (SELECT d.doc_id, d.text, length(d.text) AS n FROM looped JOIN documents d USING (doc_id)),
ch AS (SELECT doc_id, unnest(x) AS c, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, string_split(text, '') AS x FROM c)),
later AS (SELECT doc_id, c, k, p, k + p AS k2 FROM ch, (SELECT unnest(range(1, {LONGEST + 1})) AS p) q),
same AS (SELECT a.doc_id, a.p, a.k FROM later a JOIN ch b ON b.doc_id = a.doc_id AND b.k = a.k2 AND b.c = a.c),
g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, p ORDER BY k) AS island FROM same),
i AS (SELECT doc_id, p, min(k) - 1 AS s, max(k) + p AS e FROM g GROUP BY doc_id, p, island),
long AS (SELECT * FROM i WHERE e - s >= greatest(4 * p, 60)),
kept AS (SELECT l.* FROM long l WHERE NOT EXISTS (SELECT 1 FROM i o WHERE o.doc_id = l.doc_id AND o.p < l.p AND l.p % o.p = 0 AND o.s <= l.s AND o.e >= l.e))
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", CAST(p AS INTEGER) AS period, CAST((e - s) // p AS INTEGER) AS repeats, substr(text, CAST(s + 1 AS BIGINT), CAST(p AS BIGINT)) AS unit FROM kept JOIN c USING (doc_id)""",
        "loop_cube": f"""{_FIRST},
r AS (SELECT source, CASE WHEN h.doc_id IS NULL THEN 'clean' ELSE 'loop_detected' END AS status, d.doc_id % 3 AS round FROM documents d LEFT JOIN looped h USING (doc_id))
SELECT grouping_id(source, status, round) AS level, source, status, round, count(*) AS n_texts, count(*) FILTER (status = 'loop_detected') AS n_loops FROM r GROUP BY CUBE (source, status, round)""",
        "top_by_column": f"""WITH {_PAIRS},
c AS (SELECT 'token' AS name, token AS value, count(*) AS cnt FROM pairs GROUP BY token UNION ALL SELECT 'source', source, count(*) FROM pairs GROUP BY source)
SELECT name, value, cnt FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY cnt DESC, value) <= 5""",
    }
