"""The registered queries of as-of and interval joins and of exact quantiles, and the same results as DuckDB SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from .operators import quantiles, repetition, tokens
from .operators.joins import asof_join, interval_join
from .operators.probes import hits_by_joins
from .queries import _docs, _hits_sql, _HIT_PARTS, _words, read, WORD


# As-of joins ----------------------------------------------------------------------------------------------------------


def _kind(spark, d, kind):
    return read(spark, d, "events").filter(F.col("event_type") == kind).select("user_id", "ts", "event_id", "value")


def asof_view(spark, d):
    """The last view of each purchase's user before it, in the three days before."""
    got = asof_join(_kind(spark, d, "purchase"), _kind(spark, d, "view"), ["user_id"], "ts", "ts", strict=True, tolerance=timedelta(days=3), cell=timedelta(days=1))
    return got.select("event_id", F.col("match.event_id").alias("view_id"), F.col("match.value").alias("view_value"))


def asof_next_click(spark, d):
    """The next click of each error's user, at its time or after."""
    got = asof_join(_kind(spark, d, "error"), _kind(spark, d, "click"), ["user_id"], "ts", "ts", direction="forward", cell=timedelta(days=2))
    return got.select("event_id", F.col("match.event_id").alias("click_id"))


def asof_nearest_error(spark, d):
    """The error next to each view, before or after it, of all users: one key with all rows, in cells of an hour."""
    one = lambda kind: _kind(spark, d, kind).withColumn("all", F.lit(1))
    got = asof_join(one("view"), one("error"), ["all"], "ts", "ts", direction="nearest", cell=timedelta(hours=1))
    return got.select("event_id", F.col("match.event_id").alias("error_id"))


def loop_hits_by_joins(spark, d):
    """``loop_hits`` as a self-join of places: the next and the previous place of each probe's text."""
    found = hits_by_joins(_docs(spark, d), "doc_id")
    return found.select("doc_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "period", "repeats", F.col("repeat_start").alias("repeat_start_char"), "snippet")


# Interval joins -------------------------------------------------------------------------------------------------------


def tokens_at_probes(spark, d):
    """The token that holds each probe of the detector: many points and spans of each document."""
    places = _docs(spark, d).filter(F.length("text") > 16).select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 17, F.lit(128))).alias("pos"))
    return tokens.locate(tokens.token_spans(_words(spark, d), "doc_id"), places, "doc_id").select("doc_id", "pos", "idx")


def loop_tokens(spark, d):
    """Tokens that begin in a loop: spans of all lengths, from a line to a whole document."""
    found = repetition.with_repetition(_docs(spark, d).select("doc_id", "text")).filter(F.col("hit").isNotNull())
    hits = found.select("doc_id", F.col("hit.start").alias("start"), F.col("hit.end").alias("end"))
    words = found.select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("decoded"))  # of texts with a loop: no other token can meet one
    starts = tokens.token_spans(words, "doc_id").select("doc_id", "idx", "char_start")
    met = interval_join(starts, hits, ["doc_id"], "char_start", "start", "end", narrowest=1024)
    return met.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


# Quantiles ------------------------------------------------------------------------------------------------------------


def value_quantiles(spark, d):
    """Interpolated quantiles of the values of each kind of event."""
    got = quantiles.exact_quantiles(read(spark, d, "events"), ["event_type"], "value", {"p5": 0.05, "median": 0.5, "p95": 0.95, "p100": 1.0})
    return got.select("event_type", *(F.round(c, 9).alias(c) for c in ("p5", "median", "p95", "p100")))


def price_quantiles(spark, d):
    """Lower quantiles of all prices: one group with all rows."""
    got = quantiles.exact_quantiles(read(spark, d, "lineitem"), [], "l_extendedprice", {"p1": 0.01, "median": 0.5, "p99": 0.99}, "lower")
    return got.select("p1", "median", "p99")


def queries():
    every = (asof_view, asof_next_click, asof_nearest_error, loop_hits_by_joins, tokens_at_probes, loop_tokens, value_quantiles, price_quantiles)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    words = "regexp_extract_all(text, '\\s?\\S+')"
    tokens_sql = f"(SELECT doc_id, t, idx, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS idx FROM (SELECT doc_id, {words} AS w FROM documents)))"
    hits = f"WITH {_HIT_PARTS.format(total=60, repeats=4)}"
    quantiles_of = ", ".join(f"round(quantile_cont(value, {q}), 9) AS {n}" for n, q in (("p5", 0.05), ("median", 0.5), ("p95", 0.95), ("p100", 1.0)))
    return {
        "asof_view": "SELECT l.event_id, r.event_id AS view_id, r.value AS view_value FROM events l LEFT JOIN events r ON r.event_type = 'view' AND r.user_id = l.user_id AND r.ts < l.ts AND r.ts >= l.ts - INTERVAL 3 DAY WHERE l.event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC NULLS LAST, r.event_id DESC) = 1",
        "asof_next_click": "SELECT l.event_id, r.event_id AS click_id FROM events l LEFT JOIN events r ON r.event_type = 'click' AND r.user_id = l.user_id AND r.ts >= l.ts WHERE l.event_type = 'error' QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts NULLS LAST, r.event_id DESC) = 1",
        "asof_nearest_error": "WITH b AS (SELECT l.event_id, l.ts AS here, (SELECT max({'ts': r.ts, 'id': r.event_id}) FROM events r WHERE r.event_type = 'error' AND r.ts <= l.ts) AS b, (SELECT min(r.ts) FROM events r WHERE r.event_type = 'error' AND r.ts >= l.ts) AS f FROM events l WHERE l.event_type = 'view'), n AS (SELECT b.*, (SELECT max(r.event_id) FROM events r WHERE r.event_type = 'error' AND r.ts = b.f) AS f_id FROM b) SELECT event_id, CASE WHEN f IS NULL OR epoch_us(here) - epoch_us(b.ts) <= epoch_us(f) - epoch_us(here) THEN b.id ELSE f_id END AS error_id FROM n",
        "loop_hits_by_joins": _hits_sql(60, 4),
        "tokens_at_probes": f"SELECT d.doc_id, CAST(u.pos AS INTEGER) AS pos, CAST(s.idx AS INTEGER) AS idx FROM documents d, unnest(range(0, length(d.text) - 16, 128)) AS u(pos) JOIN {tokens_sql} s ON s.doc_id = d.doc_id AND s.e - length(s.t) <= u.pos AND u.pos < s.e",
        "loop_tokens": f"{hits} SELECT h.doc_id, count(*) AS n_tokens, CAST(min(s.idx) AS INTEGER) AS first_idx, CAST(max(s.idx) AS INTEGER) AS last_idx FROM hits h JOIN {tokens_sql} s ON s.doc_id = h.doc_id AND s.e - length(s.t) >= h.start_char AND s.e - length(s.t) < h.end_char WHERE h.first = 1 GROUP BY h.doc_id",
        "value_quantiles": f"SELECT event_type, {quantiles_of} FROM events GROUP BY event_type",
        "price_quantiles": "SELECT quantile_disc(l_extendedprice, 0.01) AS p1, quantile_disc(l_extendedprice, 0.5) AS median, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem",
    }
