"""The registered queries of the engine's own operators, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PROMPT_TEMPLATE, Choice, Repetition
from .functions import scalar
from .operators import balance, choose, features, loss, metrics, reports, repetition, tokens
from .shared import drop_path
from .sources.readers import format_prompt

SKIPPED = ["bfcl", "tau", "src1"]
SOURCES = ["src1", "src2", "src5"]
TARGET, STRENGTH, SEED = 300, 0.8, 3407
WORD = r"\s?\S+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return read(spark, d, "documents")


# Detection ----------------------------------------------------------------------------------------------------------


def _hits(spark, d, r: Repetition) -> DataFrame:
    found = repetition.with_repetition(_docs(spark, d).select("doc_id", "source", "text"), "text", r).filter(F.col("hit").isNotNull())
    return found.select("doc_id", *(F.col("hit")[k].alias(a) for k, a in (("start", "start_char"), ("end", "end_char"), ("period", "period"), ("repeats", "repeats"), ("repeat_start", "repeat_start_char"), ("snippet", "snippet"))))


def loop_hits(spark, d):
    return _hits(spark, d, Repetition())


def loop_hits_loose(spark, d):
    return _hits(spark, d, Repetition(min_repeats=2, min_total_repeated=32))


def loop_rate_by_source(spark, d):
    rows = repetition.with_repetition(_docs(spark, d).select("source", "text"))
    return reports.loop_rate(rows, F.col("hit").isNotNull(), "source").withColumn("loop_rate", F.round("loop_rate", 6))


def loop_report(spark, d):
    rows = repetition.with_repetition(_docs(spark, d).select("text"))
    return reports.loop_rate(rows, F.col("hit").isNotNull()).withColumn("loop_rate", F.round("loop_rate", 6))


def generation_records(spark, d):
    rows = _docs(spark, d).select("source", F.col("doc_id").cast("string").alias("prompt"), F.col("text").alias("completion"))
    out = repetition.generation_records(rows)
    return out.select("source", "prompt", "status", F.col("repetition.start_char").alias("start_char"), F.col("repetition.repeats").alias("repeats"), F.length("completion").alias("n"))


_HIT_PARTS = """
probes AS (
  SELECT doc_id, text, n, CAST(u.sp AS BIGINT) AS sp, substr(text, CAST(u.sp + 1 AS BIGINT), 16) AS fp
  FROM (SELECT doc_id, source, text, length(text) AS n FROM documents WHERE length(text) >= {total}) d,
       unnest(range(0, d.n - 16, 128)) AS u(sp)
),
found AS (
  SELECT doc_id, text, n, sp,
         instr(substr(text, sp + 17, 1024), fp) AS f,
         instr(reverse(substr(text, greatest(sp - 1024, 0) + 1, least(sp, 1024))), reverse(fp)) AS b
  FROM probes
),
cand AS (
  SELECT doc_id, text, n, sp, 0 AS dir, sp AS st, f + 15 AS p FROM found WHERE f > 0 AND f + 15 <= 1024
  UNION ALL
  SELECT doc_id, text, n, sp, 1, sp - (b + 15), b + 15 FROM found WHERE b > 0 AND b + 15 <= 1024
),
close AS (
  SELECT *, substr(text, st + 1, p) AS pat FROM cand
  WHERE st + p <= n AND (substr(text, st + p + 1, p) = substr(text, st + 1, p) OR (st >= p AND substr(text, st - p + 1, p) = substr(text, st + 1, p)))
),
runs AS (
  SELECT *,
    coalesce(list_position(list_transform(range(1, CAST((n - st) // p AS BIGINT)), lambda k: substr(text, CAST(st + k * p + 1 AS BIGINT), p) = pat), false) - 1, (n - st) // p - 1) AS fw,
    coalesce(list_position(list_transform(range(1, CAST(st // p + 1 AS BIGINT)), lambda k: substr(text, CAST(st - k * p + 1 AS BIGINT), p) = pat), false) - 1, st // p) AS bw
  FROM close
),
hits AS (
  SELECT doc_id, st - bw * p AS start_char, st + (fw + 1) * p AS end_char, p AS period, fw + bw + 1 AS repeats,
         CASE WHEN p > 100 THEN substr(pat, 1, 100) || '...' ELSE pat END AS snippet,
         row_number() OVER (PARTITION BY doc_id ORDER BY sp, dir) AS first
  FROM runs WHERE fw + bw + 1 >= {repeats} AND (fw + bw + 1) * p >= {total}
)"""


def _hits_sql(total: int, repeats: int) -> str:
    return f"WITH {_HIT_PARTS.format(total=total, repeats=repeats)} SELECT doc_id, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, CAST(period AS INTEGER) AS period, CAST(repeats AS INTEGER) AS repeats, CAST(start_char + period AS INTEGER) AS repeat_start_char, snippet FROM hits WHERE first = 1"


_FIRST = f"WITH {_HIT_PARTS.format(total=60, repeats=4)}, looped AS (SELECT * FROM hits WHERE first = 1)"
_RATE = "count(*) AS n_texts, count(h.doc_id) AS n_loops, round(100.0 * count(h.doc_id) / greatest(count(*), 1), 6) AS loop_rate FROM documents d LEFT JOIN looped h USING (doc_id)"


# Prompts and filters ------------------------------------------------------------------------------------------------


def prompt_format(spark, d):
    """Conversations as one prompt each; turns are gathered per conversation."""
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("chat"))
    return turns.select("conv_id", format_prompt(F.lit(""), F.col("chat"), PROMPT_TEMPLATE).alias("prompt"))


def skip_filter(spark, d):
    return _docs(spark, d).filter(~scalar.holds_any("source", SKIPPED)).select("doc_id", "source")


def source_isin(spark, d):
    return _docs(spark, d).filter(F.col("source").isin(*SOURCES)).select("doc_id", "source")


def _with_marks(spark, d):
    return _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(scalar.TRIMMED_MARK), "text")).otherwise(F.col("text")).alias("source_prompt"))


def trimmed_filter(spark, d):
    kept, _ = features.drop_trimmed(_with_marks(spark, d))
    return kept.select("doc_id")


def trimmed_count(spark, d):
    return features.drop_trimmed(_with_marks(spark, d))[1]


def source_labels(spark, d):
    a, b = F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.when(F.col("doc_id") % 3 == 1, "").otherwise(F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return _docs(spark, d).select("doc_id", scalar.source_label(a, b, F.lit(None).cast("string")).alias("label"))


# Tokens -------------------------------------------------------------------------------------------------------------


def _words(spark, d):
    return _docs(spark, d).select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("decoded"))


def token_spans(spark, d):
    return tokens.token_spans(_words(spark, d), "doc_id").select("doc_id", "idx", F.col("char_start").cast("int").alias("char_start"), "char_end")


def char_to_token(spark, d):
    """The word of the middle character, by a fold in the row."""
    rows = _words(spark, d).withColumn("pos", (F.length("text") / 2).cast("int"))
    return rows.select("doc_id", "pos", tokens.token_index(F.col("decoded"), F.col("pos")).alias("idx"))


def char_to_token_join(spark, d):
    """The same by a range join on the spans."""
    places = _docs(spark, d).select("doc_id", (F.length("text") / 2).cast("int").alias("pos"))
    return tokens.locate(tokens.token_spans(_words(spark, d), "doc_id"), places, "doc_id").select("doc_id", "pos", "idx")


def context_before(spark, d):
    rows = _words(spark, d).withColumn("k", F.least(F.lit(5), F.size("decoded")))
    return rows.select("doc_id", tokens.context_before(F.concat(F.col("doc_id").cast("string"), F.lit(": ")), F.col("decoded"), F.col("k")).alias("context"))


# Choice of tokens ---------------------------------------------------------------------------------------------------


def _alternatives(spark, d):
    """Each embedding as alternatives: place k has token t<k> and its value as logprob."""
    options = F.transform("embedding", lambda x, k: F.struct(k.alias("ord"), F.concat(F.lit("t"), k.cast("string")).alias("tok"), x.cast("double").alias("lp")))
    return read(spark, d, "embeddings").select("vec_id", options.alias("options"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("rejected"))


def _choice(spark, d, c: Choice, temperature: float):
    rows = choose.with_choice(_alternatives(spark, d), "options", "rejected", temperature, c)
    return rows.select("vec_id", F.array_join(F.transform("chosen", lambda x: x["decoded"]), ",").alias("chosen"), F.size("chosen").alias("n"))


def choose_tokens(spark, d):
    return _choice(spark, d, Choice(), 1.0)


def choose_min_p(spark, d):
    return _choice(spark, d, Choice(min_p=0.6, top_k=None), 0.5)


def choose_top_k(spark, d):
    return _choice(spark, d, Choice(top_k=5, skip_raw_token_substrings=("7",), require_alnum=True), 0.25)


_P = """
WITH opts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS lp, generate_subscripts(embedding, 1) - 1 AS ord FROM embeddings),
p AS (SELECT vec_id, label, ord, power(exp(lp), {power}) / sum(power(exp(lp), {power})) OVER (PARTITION BY vec_id) AS p FROM opts),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, ord) AS rank, max(p) OVER (PARTITION BY vec_id) AS best FROM p WHERE ord <> label),
k AS (SELECT * FROM r WHERE {keep}),
c AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p, ord) AS pos FROM k WHERE {after})
SELECT vec_id, coalesce(string_agg('t' || ord, ',' ORDER BY pos) FILTER (pos <= 20), '') AS chosen, CAST(count(*) FILTER (pos <= 20) AS INTEGER) AS n FROM c GROUP BY vec_id"""


# Sampling -----------------------------------------------------------------------------------------------------------


def _pairs(spark, d):
    return _docs(spark, d).select("doc_id", "source", F.regexp_extract("text", r"^\s*(\S+)", 1).alias("token"))


def rejected_ratios(spark, d):
    return balance.token_ratios(_pairs(spark, d), "token", STRENGTH).withColumn("ratio", F.round("ratio", 9))


def quotas(spark, d):
    """The picks of each token, of cells that give rows or whose token has a quota."""
    matrix, path = balance.count_matrix(_pairs(spark, d), "token", "source")
    cells = balance.nested_quotas(matrix, "token", "source", TARGET, STRENGTH)
    drop_path(spark, path)
    return cells.groupBy("token", "cnt", "quota").agg(F.sum("take").alias("take")).filter((F.col("quota") > 0) | (F.col("take") > 0))


def nested_picks(spark, d):
    """The rows that each token and source gives, to a row."""
    matrix, path = balance.count_matrix(_pairs(spark, d), "token", "source")
    cells = balance.nested_quotas(matrix, "token", "source", TARGET, STRENGTH)
    drop_path(spark, path)
    return cells.filter("take > 0").select("token", "source", "n", "take")


def source_share(spark, d):
    return reports.shares(_pairs(spark, d), "source").withColumn("share", F.round("share", 9))


def regularised_sample(spark, d):
    return balance.sample_pairs(_pairs(spark, d), token="token", source="source", key="doc_id", most=TARGET, strength=STRENGTH, seed=SEED).select("doc_id", "token", "source")


def source_balance_equal(spark, d):
    return balance.sample_pairs(_pairs(spark, d), token="token", source="source", key="doc_id", most=None, strength=STRENGTH, seed=SEED, mode="equal").select("doc_id", "source")


def source_balance_sqrt(spark, d):
    return balance.sample_pairs(_pairs(spark, d), token="token", source="source", key="doc_id", most=None, strength=STRENGTH, seed=SEED, mode="sqrt").select("doc_id", "source")


_PAIRS = "pairs AS (SELECT doc_id, source, regexp_extract(text, '^\\s*(\\S+)', 1) AS token FROM documents)"
_RATIOS = f"""{_PAIRS},
counts AS (SELECT token, count(*) AS cnt FROM pairs GROUP BY token),
w AS (SELECT token, cnt, CASE WHEN cnt <= m THEN 1.0::DOUBLE ELSE power(m / cnt, {STRENGTH}) END * cnt AS weighted FROM counts, (SELECT quantile_cont(cnt, 0.5) AS m FROM counts)),
ratios AS (SELECT token, cnt, weighted / sum(weighted) OVER () AS ratio FROM w)"""
#: The rule itself, a step a pick: the state of every cell with the cell that is best in it.
_QUOTAS = f"""{_RATIOS},
goal AS (SELECT least({TARGET}, count(*)) AS goal FROM pairs),
q AS (SELECT token, cnt, round(ratio, 12) AS ratio, CAST(round_even(round(ratio, 12) * goal, 0) AS BIGINT) AS quota FROM ratios, goal),
pool AS (SELECT source, count(*) / (SELECT count(*) FROM pairs)::DOUBLE AS share FROM pairs GROUP BY source),
m AS (SELECT token, source, count(*) AS n FROM pairs GROUP BY ALL),
state AS (
  SELECT 0 AS step, token, source, n, cnt, ratio, quota, share, 0 AS take, 0 AS seen, 0 AS chosen FROM m JOIN q USING (token) JOIN pool USING (source)
  UNION ALL
  SELECT step + 1, token, source, n, cnt, ratio, quota, share, take + CAST(token = best.t AND source = best.s AS INTEGER), seen + CAST(token = best.t AS INTEGER), chosen + CAST(source = best.s AS INTEGER)
  FROM (SELECT *, first_value({{'t': token, 's': source}}) OVER (ORDER BY take < n AND seen < quota DESC, take < n DESC, ratio - seen / greatest(step, 1)::DOUBLE DESC, share - chosen / greatest(step, 1)::DOUBLE DESC, token, source) AS best FROM state)
  WHERE step < (SELECT goal FROM goal)),
taken AS (SELECT * FROM state WHERE step = (SELECT max(step) FROM state))"""
_SAMPLE = f"""WITH RECURSIVE {_QUOTAS},
r AS (SELECT doc_id, token, source, row_number() OVER (PARTITION BY token, source ORDER BY md5('{SEED}|' || doc_id)) AS rn FROM pairs)
SELECT doc_id, token, source FROM r JOIN taken USING (token, source) WHERE rn <= take"""


def _balance_sql(cap: str) -> str:
    return f"""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS rows, count(*) AS sources, sum(sqrt(n)) AS roots FROM c),
caps AS (SELECT source, {cap} AS cap FROM c, t),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}|' || doc_id)) AS rn FROM documents)
SELECT doc_id, source FROM r JOIN caps USING (source) WHERE rn <= cap"""


# Features -----------------------------------------------------------------------------------------------------------


def word_encoder():
    """A toy tokenizer: an id a word (its length and first letters), none for white space."""
    return lambda text: [len(w) for w in text.split()]


def _toy_pairs(spark, d):
    """Pairs from documents: the text before its last two words is the context, words are the tokens."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    rows = _docs(spark, d).select("doc_id", "text", words.alias("w")).withColumn("n", F.size("w"))
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit("")).when(F.col("doc_id") % 5 == 1, F.lit("two words")).otherwise(F.get("w", F.lit(0)))
    chosen = F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 13 == 0, F.array(F.lit("a b"))).otherwise(F.slice("w", 2, 3))
    return rows.select(
        "doc_id",
        F.when(F.col("doc_id") % 17 == 0, F.lit("")).otherwise(F.col("text")).alias("context_before"),
        raw.alias("rejected_token"),
        raw.alias("rejected_decoded"),
        chosen.alias("multi_chosen_tokens"),
        chosen.alias("multi_chosen_decoded"),
    )


def filter_cascade(spark, d):
    rows = features.tokenise(_toy_pairs(spark, d), word_encoder, max_length=1000)
    return rows.select("doc_id", F.coalesce("reject_reason", F.lit("kept")).alias("reason"), F.size("chosen_ids").alias("n_chosen"))


def filter_cascade_counts(spark, d):
    return features.filter_counts(features.tokenise(_toy_pairs(spark, d), word_encoder, max_length=1000))


_STOP = ", ".join(f"'{w}'" for w in scalar.STOP_WORDS)
_CASCADE = f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w FROM documents),
x AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS context, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE len(w) END AS n,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'two words' ELSE w[1] END AS raw,
  CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 1 ELSE len(w[2:4]) END AS chosen,
  CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 0 ELSE len(w[2:4]) END AS single FROM w),
y AS (SELECT *, lower(trim(raw, ' ' || chr(9) || chr(10) || chr(13))) AS low FROM x),
z AS (SELECT *, coalesce(nullif(regexp_replace(low, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g'), ''), nullif(low, ''), raw) AS key FROM y),
r AS (SELECT doc_id, single, CASE WHEN context = '' THEN 'empty_context' WHEN n + 1 > 1000 THEN 'over_length' WHEN coalesce(raw, '') = '' THEN 'no_rejected' WHEN raw LIKE '% %' THEN 'rejected_not_single'
  WHEN key IN ({_STOP}) THEN 'rejected_stopword' WHEN chosen < 1 THEN 'no_chosen' WHEN single < 1 THEN 'chosen_not_single' ELSE 'kept' END AS reason FROM z)"""


def normal_keys(spark, d):
    words = _docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("w")).distinct()
    return words.groupBy(scalar.normal_key("w").alias("key"), scalar.is_stop_word("w").alias("stop")).agg(F.count("*").alias("n"))


# Loss and metrics ---------------------------------------------------------------------------------------------------


def _logits(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("logits"))
    ref = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("logits").alias("ref_logits"))
    ids = F.array_distinct(F.array(*((F.col("vec_id") * a + b) % 64 for a, b in ((1, 10), (7, 3), (13, 5))))).cast("array<int>")
    rows = e.join(ref, "vec_id").withColumn("rejected_id", F.col("label").cast("int"))
    return rows.withColumn("chosen_ids", F.filter(ids, lambda c: c != F.col("rejected_id"))).withColumn("batch", (F.col("vec_id") % 8).cast("int"))


def preference_loss(spark, d):
    terms = loss.with_terms(_logits(spark, d), epsilon=0.5, tau_target=0.2)
    return terms.select("vec_id", F.round("pref", 6).alias("pref"), F.round("tether", 6).alias("tether"), "n_tether", F.round("excess", 6).alias("excess"), "n_target", "n_won", "n_margin", "n_chosen")


def batch_metrics(spark, d):
    out = loss.batch_metrics(loss.with_terms(_logits(spark, d), epsilon=0.5, tau_target=0.2), "batch")
    return out.select("batch", *(F.round(c, 6).alias(c) for c in ("pref_loss", "mse_elem", "mse_target", "chosen_win", "margin_win", "mean_delta", "active_weight", "loss")))


def median_delta(spark, d):
    return loss.median_delta(loss.with_terms(_logits(spark, d), epsilon=0.5), "batch").withColumn("median_delta", F.round("median_delta", 6))


_LOGITS = """WITH e AS (SELECT a.vec_id, a.label AS rej, CAST(a.embedding AS DOUBLE[]) AS lg, CAST(b.embedding AS DOUBLE[]) AS rf FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
ids AS (SELECT vec_id, rej, unnest(list_distinct([(vec_id + 10) % 64, (vec_id * 7 + 3) % 64, (vec_id * 13 + 5) % 64])) AS c FROM e),
ch AS (SELECT * FROM ids WHERE c <> rej),
d AS (SELECT vec_id, vec_id % 8 AS batch, c, lg[c + 1] - lg[e.rej + 1] AS delta, lg[c + 1] - rf[c + 1] AS gap FROM ch JOIN e USING (vec_id)),
dw AS (SELECT *, least(greatest((0.5 - delta) / 0.5, 0), 1) AS weight, ln(1 + exp(0.5 - delta)) AS sp FROM d),
rowwise AS (SELECT vec_id, sum(sp * weight) / count(*) AS pref, count(*) AS n_chosen, count(*) FILTER (delta > 0) AS n_won, count(*) FILTER (delta >= 0.5) AS n_margin, sum(delta) AS s_delta, sum(weight) AS s_weight,
  sum(gap * gap) AS m2, sum(power(greatest(abs(gap) - 0.2, 0), 2)) AS ex FROM dw GROUP BY vec_id),
full_gap AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda k: power(lg[k] - rf[k], 2))) AS g2, power(lg[rej + 1] - rf[rej + 1], 2) AS r2, power(greatest(abs(lg[rej + 1] - rf[rej + 1]) - 0.2, 0), 2) AS rx FROM e),
t AS (SELECT vec_id, CAST(vec_id % 8 AS INTEGER) AS batch, pref, n_chosen, n_won, n_margin, s_delta, s_weight, g2 - m2 - r2 AS tether, 64 - n_chosen - 1 AS n_tether, ex + rx AS excess, n_chosen + 1 AS n_target FROM rowwise JOIN full_gap USING (vec_id))"""


def _events(spark, d):
    rows = read(spark, d, "events").select("event_type", "value", "ts", "event_id")
    return metrics.numbered(rows, ["event_type"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "step").select("event_type", "value", "step")


def metric_windows(spark, d):
    out = metrics.window_means(_events(spark, d), "event_type", "step", "value")
    return out.withColumn("mean_value", F.round("mean_value", 6))


def threshold_stop(spark, d):
    return metrics.threshold_stop(_events(spark, d), "event_type", "step", "value", 200.0)


def plateau_stop(spark, d):
    return metrics.plateau_stop(_events(spark, d), "event_type", "step", "value", patience=10)


_EVENTS = "WITH ev AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events)"


# Reports and names --------------------------------------------------------------------------------------------------


def starter_share(spark, d):
    """Share of loops by the word at which the loop begins."""
    rows = repetition.with_repetition(_docs(spark, d).select("doc_id", "text")).filter(F.col("hit").isNotNull())
    word = F.regexp_extract(F.expr("substring(text, hit.repeat_start + 1)"), r"^\s*(\S+)", 1)
    return reports.shares(rows.select(word.alias("starter")), "starter").withColumn("share", F.round("share", 9))


def top_counter(spark, d):
    return reports.top_counts(_pairs(spark, d), "token")


def _model_names(spark, d):
    name = F.concat(F.lit("org/"), F.col("p_name"), F.lit("_"), F.col("p_size").cast("string"), F.lit("b_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_HF").otherwise("-x"))
    return read(spark, d, "part").select("p_partkey", name.alias("name"))


def model_name_parse(spark, d):
    return _model_names(spark, d).select("p_partkey", scalar.base_name("name").alias("base"), scalar.model_size("name").alias("size"), scalar.parent_id("name").alias("parent"))


def sanitize_names(spark, d):
    return read(spark, d, "part").select("p_partkey", scalar.safe_name(F.concat(F.lit("-_ "), "p_name", F.lit("/#"), "p_type", F.lit(" !"))).alias("safe"))


def layers(spark, d):
    rows = read(spark, d, "supplier").select(F.concat(F.lit("model.layers."), (F.col("s_suppkey") % 32).cast("string"), F.lit(".w")).alias("name"), F.col("s_suppkey").alias("size"))
    marked = metrics.trained_layers(rows, "name", scalar.layer_of("name"), 10)
    return marked.groupBy("layer", "trainable").agg(F.sum("size").alias("parameters"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        loop_hits, loop_hits_loose, loop_rate_by_source, loop_report, generation_records, prompt_format, skip_filter, source_isin, trimmed_filter, trimmed_count, source_labels,
        token_spans, char_to_token, char_to_token_join, context_before, choose_tokens, choose_min_p, choose_top_k, rejected_ratios, quotas, nested_picks, source_share, regularised_sample, source_balance_equal,
        source_balance_sqrt, filter_cascade, filter_cascade_counts, normal_keys, preference_loss, batch_metrics, median_delta, metric_windows, threshold_stop, plateau_stop, starter_share, top_counter,
        model_name_parse, sanitize_names, layers,
    )
    from . import queries_files, queries_joins, queries_mining, queries_streams, queries_tables

    return {f.__name__: f for f in every} | queries_mining.queries() | queries_joins.queries() | queries_streams.queries() | queries_tables.queries() | queries_files.queries()


def oracle_sql() -> dict[str, str]:
    from . import queries_files, queries_joins, queries_mining, queries_streams, queries_tables

    skipped = " OR ".join(f"contains(lower(source), '{s}')" for s in SKIPPED)
    words = "regexp_extract_all(text, '\\s?\\S+')"
    template = PROMPT_TEMPLATE.replace("'", "''").partition("{prompt}")
    mark = scalar.TRIMMED_MARK
    marked = f"(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{mark}' || text ELSE text END AS source_prompt FROM documents)"
    names = "(SELECT p_partkey, 'org/' || p_name || '_' || p_size || 'b_' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_HF' ELSE '-x' END AS name FROM part)"
    spans = f"(SELECT doc_id, text, len(w) AS nw, w, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS idx FROM (SELECT doc_id, text, {words} AS w FROM documents))"
    ends = f"(SELECT doc_id, text, idx, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM {spans})"
    located = f"SELECT d.doc_id, CAST(length(d.text) // 2 AS INTEGER) AS pos, CAST(s.idx AS INTEGER) AS idx FROM documents d {{join}} JOIN {ends} s ON s.doc_id = d.doc_id AND s.e - length(s.t) <= length(d.text) // 2 AND length(d.text) // 2 < s.e"
    return queries_mining.oracle_sql() | queries_joins.oracle_sql() | queries_streams.oracle_sql() | queries_tables.oracle_sql() | queries_files.oracle_sql() | {
        "loop_hits": _hits_sql(60, 4),
        "loop_hits_loose": _hits_sql(32, 2),
        "loop_rate_by_source": f"{_FIRST} SELECT d.source, {_RATE} GROUP BY d.source",
        "loop_report": f"{_FIRST} SELECT {_RATE}",
        "generation_records": f"{_FIRST} SELECT d.source, CAST(d.doc_id AS VARCHAR) AS prompt, CASE WHEN h.doc_id IS NULL THEN 'clean' ELSE 'loop_detected' END AS status, CAST(h.start_char AS INTEGER) AS start_char, CAST(h.repeats AS INTEGER) AS repeats, CAST(length(d.text) AS INTEGER) AS n FROM documents d LEFT JOIN looped h USING (doc_id)",
        "prompt_format": f"SELECT conv_id, '{template[0]}' || string_agg(role || ': ' || text, chr(10) ORDER BY turn) || '{template[2]}' AS prompt FROM conversations GROUP BY conv_id",
        "skip_filter": f"SELECT doc_id, source FROM documents WHERE NOT ({skipped})",
        "source_isin": f"SELECT doc_id, source FROM documents WHERE source IN ({', '.join(repr(s) for s in SOURCES)})",
        "trimmed_filter": f"SELECT doc_id FROM {marked} WHERE NOT starts_with(coalesce(source_prompt, ''), '{mark}')",
        "trimmed_count": f"SELECT count(*) FILTER (starts_with(coalesce(source_prompt, ''), '{mark}')) AS n_dropped FROM {marked}",
        "source_labels": f"SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN source END, ''), nullif(CASE WHEN doc_id % 3 = 1 THEN '' WHEN doc_id % 2 = 0 THEN lang END, ''), '{scalar.UNKNOWN_SOURCE}') AS label FROM documents",
        "token_spans": f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(e - length(t) AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end FROM {ends}",
        "char_to_token": located.format(join="LEFT"),
        "char_to_token_join": located.format(join=""),
        "context_before": f"SELECT doc_id, doc_id || ': ' || coalesce(array_to_string({words}[1:5], ''), '') AS context FROM documents",
        "choose_tokens": _P.format(power=1.0, keep="rank <= 50", after="true"),
        "choose_min_p": _P.format(power=2.0, keep="p >= 0.6 * best", after="true"),
        "choose_top_k": _P.format(power=4.0, keep="rank <= 5", after="NOT contains('t' || ord, '7')"),
        "rejected_ratios": f"WITH {_RATIOS} SELECT token, cnt, round(ratio, 9) AS ratio FROM ratios",
        "quotas": f"WITH RECURSIVE {_QUOTAS} SELECT token, cnt, quota, CAST(sum(take) AS BIGINT) AS take FROM taken GROUP BY token, cnt, quota HAVING quota > 0 OR sum(take) > 0",
        "nested_picks": f"WITH RECURSIVE {_QUOTAS} SELECT token, source, n, CAST(take AS BIGINT) AS take FROM taken WHERE take > 0",
        "source_share": "SELECT source, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY source",
        "regularised_sample": _SAMPLE,
        "source_balance_equal": _balance_sql("floor(rows / sources)"),
        "source_balance_sqrt": _balance_sql("floor(round(rows * sqrt(n) / roots, 9))"),
        "filter_cascade": f"{_CASCADE} SELECT doc_id, reason, CAST(single AS INTEGER) AS n_chosen FROM r",
        "filter_cascade_counts": f"{_CASCADE} SELECT reason, count(*) AS n FROM r GROUP BY reason",
        "normal_keys": f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents), k AS (SELECT coalesce(nullif(regexp_replace(lower(w), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g'), ''), lower(w)) AS key FROM w) SELECT key, key IN ({_STOP}) AS stop, count(*) AS n FROM k GROUP BY ALL",
        "preference_loss": f"{_LOGITS} SELECT vec_id, round(pref, 6) AS pref, round(tether, 6) AS tether, CAST(n_tether AS INTEGER) AS n_tether, round(excess, 6) AS excess, CAST(n_target AS INTEGER) AS n_target, CAST(n_won AS INTEGER) AS n_won, CAST(n_margin AS INTEGER) AS n_margin, CAST(n_chosen AS INTEGER) AS n_chosen FROM t",
        "batch_metrics": f"{_LOGITS}, b AS (SELECT batch, avg(pref) AS pref_loss, sum(tether) / sum(n_tether) AS mse_elem, sum(excess) / sum(n_target) AS mse_target, avg(n_won / n_chosen) AS chosen_win, sum(n_margin) / sum(n_chosen) AS margin_win, sum(s_delta) / sum(n_chosen) AS mean_delta, sum(s_weight) / sum(n_chosen) AS active_weight FROM t GROUP BY batch) SELECT batch, round(pref_loss, 6) AS pref_loss, round(mse_elem, 6) AS mse_elem, round(mse_target, 6) AS mse_target, round(chosen_win, 6) AS chosen_win, round(margin_win, 6) AS margin_win, round(mean_delta, 6) AS mean_delta, round(active_weight, 6) AS active_weight, round(pref_loss + 0.4 * mse_elem + 0.05 * mse_target, 6) AS loss FROM b",
        "median_delta": f"{_LOGITS} SELECT CAST(batch AS INTEGER) AS batch, round(quantile_disc(delta, 0.5), 6) AS median_delta FROM d GROUP BY batch",
        "metric_windows": f"{_EVENTS} SELECT event_type, (step - 1) // 5 AS \"window\", round(avg(value), 6) AS mean_value, count(*) AS n FROM ev GROUP BY ALL",
        "threshold_stop": f"{_EVENTS} SELECT event_type, CAST(min(step) FILTER (value >= 200.0) AS INTEGER) AS stop_step FROM ev GROUP BY event_type",
        "plateau_stop": f"{_EVENTS}, m AS (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ev), g AS (SELECT *, max(CASE WHEN best IS NULL OR value > best THEN step END) OVER (PARTITION BY event_type ORDER BY step) AS risen FROM m) SELECT event_type, min(step) FILTER (step - risen >= 10) AS stop_step FROM g GROUP BY event_type",
        "starter_share": f"{_FIRST}, s AS (SELECT regexp_extract(substr(text, CAST(h.start_char + h.period + 1 AS BIGINT)), '^\\s*(\\S+)', 1) AS starter FROM looped h JOIN documents USING (doc_id)) SELECT starter, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM s GROUP BY starter",
        "top_counter": f"WITH {_PAIRS} SELECT token, count(*) AS cnt FROM pairs GROUP BY token ORDER BY cnt DESC, token LIMIT 8",
        "model_name_parse": f"SELECT p_partkey, base, coalesce(nullif(regexp_extract(base, '(?i)(\\d+B)', 1), ''), 'model') AS size, coalesce(nullif(regexp_extract(base, '_(\\d+)_HF(?:_|$)', 1), ''), regexp_extract_all(base, '\\d+')[-1], 'unknown') AS parent FROM (SELECT p_partkey, regexp_extract(name, '([^/]*)$', 1) AS base FROM {names})",
        "sanitize_names": "SELECT p_partkey, regexp_replace(regexp_replace(trim('-_ ' || p_name || '/#' || p_type || ' !'), '[^A-Za-z0-9._+-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS safe FROM part",
        "layers": "WITH l AS (SELECT CAST(s_suppkey % 32 AS INTEGER) AS layer, s_suppkey AS size FROM supplier) SELECT layer, layer > (SELECT max(layer) FROM l) - 10 AS trainable, CAST(sum(size) AS BIGINT) AS parameters FROM l GROUP BY ALL",
    }
