"""The registered queries of reading, mining and feature operators, and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar
from .functions.bytelevel import byte_of_character
from .operators import balance, features, loss, metrics, reports
from .operators.pairs import build_pairs, cap_pairs
from .operators.repetition import with_repetition
from .operators.tokens import with_decoded
from .plans.mine import mined
from .plans.training_data import model_names
from .queries import _HIT_PARTS, _docs, _events, _logits, _model_names, _pairs, _PAIRS, _toy_pairs, SOURCES, WORD, read
from .shared import drop_path, new_path, stored
from .sources import readers
from .streaming.detect import windowed_rates, write_whole

EPOCHS, BATCH, ACCUMULATION = 1.5, 4, 8
LENGTH = 64


# Completions --------------------------------------------------------------------------------------------------------


def _raw(word):
    """A word as a byte-level token: its UTF-8 bytes as printable characters."""
    shown = {b: chr(c) for c, b in sorted(byte_of_character().items(), reverse=True) if c < 0x2500}
    hidden = [b for b in range(256) if shown[b] != chr(b)]
    return F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "".join(map(chr, hidden)), "".join(shown[b] for b in hidden))


def _responses(spark, d):
    """Documents as completion responses: words are tokens, each with four alternatives.

    Of ten documents one has a plain text, one no choice, one no alternatives at the first place, and one is broken.
    """
    # a word has white space only before it, so what stands between two line breaks more is a word
    joined = F.array_join(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), "\n\n")
    quoted = F.replace(F.replace(_raw(joined), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rows = _docs(spark, d).select("doc_id", "source", "text", F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(quoted, "ĊĊ")).alias("raw"))
    option = lambda t: F.concat(F.lit('{"'), t, F.lit('":-0.25,"'), t, F.lit('1":-1.0,"'), t, F.lit('2":-2.0,"Ġ":-0.5,"'), t, F.lit('b":-1.0}'))
    tops = F.transform("raw", lambda t, k: F.when((k > 0) | (F.col("doc_id") % 10 != 2), option(t)).otherwise("null"))
    tokens = F.when(F.size("raw") > 0, F.concat(F.lit('"'), F.array_join("raw", '","'), F.lit('"'))).otherwise("")
    lists = F.when(F.col("raw").isNull(), '"tokens":null,"top_logprobs":null').otherwise(F.concat(F.lit('"tokens":['), tokens, F.lit('],"top_logprobs":['), F.array_join(tops, ","), F.lit("]")))
    full = F.concat(F.lit('{"choices":[{"text":"","logprobs":{'), lists, F.lit("}}]}"))
    plain = F.to_json(F.struct(F.array(F.struct("text", F.lit(None).cast("string").alias("logprobs"))).alias("choices")), {"ignoreNullFields": "false"})
    kind = F.col("doc_id") % 10
    response = F.when(kind == 0, plain).when(kind == 1, '{"choices": []}').when(kind == 3, F.lit('{"choices": [')).otherwise(full)
    return rows.select("doc_id", "source", F.concat(F.col("doc_id").cast("string"), F.lit(": ")).alias("prompt"), response.alias("response"))


def parse_completions(spark, d):
    rows = readers.parse_completions(_responses(spark, d))
    options = F.flatten(F.transform("alternatives", lambda a: a["options"]))
    total = F.aggregate(F.transform(options, lambda o: o["lp"]), F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", "failed", F.length("completion").alias("n_chars"), F.size("tokens").alias("n_tokens"), F.size("alternatives").alias("n_places"), F.size(options).alias("n_options"), F.round(total, 6).alias("lp"))


def decode_tokens(spark, d):
    """The byte-level tokens of each document as text again."""
    words = F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), _raw)
    rows = with_decoded(_docs(spark, d).select("doc_id", words.alias("tokens")))
    return rows.select("doc_id", F.size("decoded").alias("n"), F.md5("decoded_text").alias("text_md5"), F.get("decoded", F.size("decoded") - 1).alias("last"))


def _completions(spark, d):
    return readers.parse_completions(_responses(spark, d))


def mined_pairs(spark, d):
    made = build_pairs(_completions(spark, d), 1.0)  # failed ones make none; a filter on them would parse responses twice
    return made.select("source_prompt", "source", "rejected_decoded", F.array_join("multi_chosen_decoded", "|").alias("chosen"), F.md5("context_before").alias("context_md5"), F.col("repetition.rejected_token_index").alias("idx"), F.col("repetition.period").alias("period"), F.col("repetition.repeats").alias("repeats"))


def mined_by_source(spark, d):
    """Records, loops and pairs of a mining run for each source, in one pass; failed responses have none."""
    rows = mined(_completions(spark, d)).filter(F.col("error").isNull())
    return rows.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if(F.col("hit").isNotNull()).alias("n_loops"), F.count_if(F.col("pair").isNotNull()).alias("n_pairs"))


def failed_responses(spark, d):
    return _completions(spark, d).groupBy("failed").agg(F.count("*").alias("n"))


def first_pairs(spark, d):
    """Pairs up to a target, in an order."""
    return cap_pairs(_pairs(spark, d), 75, "source", "doc_id")


def loop_rate_rounds(spark, d):
    """Loop rates of three rounds with their change."""
    rows = with_repetition(_docs(spark, d).select((F.col("doc_id") % 3).alias("round"), "text"))
    rates = reports.rate_change(reports.loop_rate(rows, F.col("hit").isNotNull(), "round"))
    return rates.select("round", "n_texts", "n_loops", F.round("loop_rate", 6).alias("loop_rate"), F.round("change", 6).alias("change"))


def stream_rates(spark, d):
    """Error rates of the events in windows of an hour, from a stream over the table's files."""
    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", 1).alias("hit"))
    out = new_path(spark)
    running = write_whole(windowed_rates(stream, "ts", "1 hour"), f"{out}/rates", f"{out}/state")
    running.awaitTermination()
    written = spark.read.parquet(f"{out}/rates")
    last = written.agg(F.max("batch")).first()[0]
    rates = written.filter(F.col("batch") == last).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "n_texts", "n_loops", F.round("loop_rate", 6).alias("loop_rate"))
    result, _ = stored(rates)
    drop_path(spark, out)
    return result


# Readers ------------------------------------------------------------------------------------------------------------


def _prompt_lines(spark, d):
    """Documents as JSON lines: a plain text, or two messages for every third one."""
    chat = F.to_json(F.array(F.struct(F.lit("human").alias("from"), F.col("text").alias("value")), F.struct(F.lit("gpt").alias("from"), F.lit("ok").alias("value"))))
    plain = F.to_json(F.struct("source", F.col("text").alias("conversations")))
    spoken = F.concat(F.lit('{"source":"'), "source", F.lit('","conversations":'), chat, F.lit("}"))
    return _docs(spark, d).select(F.when(F.col("doc_id") % 3 == 0, spoken).otherwise(plain).alias("value"))


def read_prompts(spark, d):
    rows = readers.prompts(_prompt_lines(spark, d), skip=["src1"])
    prompt = readers.format_prompt(F.col("text"), F.col("chat_messages"), "<{prompt}>")
    return rows.select("source", F.md5(prompt).alias("prompt_md5"), F.coalesce(F.size("chat_messages"), F.lit(0)).alias("n_messages"))


def prompts_of_sources(spark, d):
    rows = readers.prompts(_prompt_lines(spark, d), source_values=SOURCES)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("chat_messages").alias("n_chats"))


def max_prompts(spark, d):
    """The first prompts of lines in the order of ids."""
    lines = _docs(spark, d).orderBy("doc_id").select(F.to_json(F.struct("source", F.col("doc_id").cast("string").alias("conversations"))).alias("value"))
    return readers.prompts(lines, skip=["src2"], limit=60).select("source", "text")


def chat_roles(spark, d):
    """Turns in the from/value form, read as messages."""
    said = F.when(F.col("role") == "assistant", "gpt").when(F.col("role") == "user", "human").otherwise(F.col("role"))
    rows = read(spark, d, "conversations").select(F.to_json(F.array(F.struct(said.alias("from"), F.col("text").alias("value")))).alias("field"))
    turns = rows.select(F.explode(readers.messages_of(F.col("field"))).alias("m"))
    return turns.groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("m.content")).alias("chars"))


def blank_lines(spark, d):
    lines = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return readers.non_blank(lines, "line").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def pair_lines(spark, d):
    """Pairs written as JSON lines, with blank lines between, and read again."""
    pairs = _toy_pairs(spark, d).withColumn("source", F.col("doc_id").cast("string")).drop("doc_id")
    lines = readers.as_lines(pairs)
    got = readers.pairs_of(lines.unionByName(lines.select(F.lit(" \t").alias("value"))))
    return got.select(F.col("source").cast("bigint").alias("doc_id"), F.md5("context_before").alias("context_md5"), "rejected_token", F.size("multi_chosen_tokens").alias("n_chosen"), F.col("repetition").isNull().alias("no_repetition"))


# Features -----------------------------------------------------------------------------------------------------------


def thin_chosen(spark, d):
    """The values of each embedding as chosen tokens, without the most frequent ones of the row."""
    shown = F.transform(F.col("embedding").cast("array<double>"), lambda x, k: F.struct(k.alias("id"), F.concat(F.lit(" T"), F.floor(F.abs(x) * 4).cast("string"), F.lit(".")).alias("decoded")))
    rows = read(spark, d, "embeddings").select("vec_id", shown.alias("c")).withColumn("kept", features.thin_chosen(F.col("c")))
    return rows.select("vec_id", F.size("kept").alias("n"), F.array_join(F.transform("kept", lambda x: x["id"].cast("string")), ",").alias("ids"))


def padded_ids(spark, d):
    """The parts of each order as ids, padded on the left, with their positions."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines")).withColumn("ids", F.transform("lines", lambda x: x["l_partkey"]))
    padded, places = features.pad_left(F.col("ids"), LENGTH, 0), features.position_ids(F.size("ids"), LENGTH)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("l_orderkey", text(padded).alias("padded"), text(places).alias("places"))


def min_chosen(spark, d):
    """Rows with enough chosen tokens; without a cap and a mode all of them stay."""
    chosen = F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, (F.col("doc_id") % 4).cast("int"))
    rows = _docs(spark, d).select("doc_id", "source", F.lit("t").alias("token"), F.when(F.col("doc_id") % 9 != 0, chosen).alias("chosen"))
    return balance.sample_pairs(rows, token="token", source="source", key="doc_id", most=None, strength=0.0, seed=7, chosen="chosen", min_chosen=2).select("doc_id", "source")


def clipped_norms(spark, d):
    """Factors that bring each embedding's norm down to that of the one before it."""
    rows = _logits(spark, d)
    scale = loss.clipped_norm_scale(F.col("logits"), F.col("ref_logits"), clip=0.9)
    return rows.select("vec_id", F.round(scale, 9).alias("scale"))


# Reports ------------------------------------------------------------------------------------------------------------


def named_windows(spark, d):
    """Means of windows of steps, with the names of training and evaluation metrics."""
    rows = _events(spark, d).withColumn("split", F.when(F.col("step") % 2 == 0, "eval").otherwise("train"))
    log = rows.select(metrics.named(F.col("split"), F.col("event_type")).alias("name"), "step", "value")
    return metrics.window_means(log, "name", "step", "value", every=50).withColumn("mean_value", F.round("mean_value", 6))


def estimated_steps(spark, d):
    counts = _docs(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return counts.select("source", "n", metrics.estimated_steps(F.col("n"), EPOCHS, BATCH, ACCUMULATION).alias("steps"))


def merged_names(spark, d):
    made = model_names(_model_names(spark, d), "name", user="a user", job="local run", examples=12_000, rate=1.5e-5, epochs=1.0)
    return made.select("name", "merged_name")


def snippets(spark, d):
    return _docs(spark, d).select("doc_id", scalar.snippet("text", 40).alias("snippet"))


def queries():
    every = (
        parse_completions, decode_tokens, mined_pairs, mined_by_source, failed_responses, first_pairs, loop_rate_rounds, stream_rates, read_prompts, prompts_of_sources, max_prompts, chat_roles, blank_lines, pair_lines,
        thin_chosen, padded_ids, min_chosen, clipped_norms, named_windows, estimated_steps, merged_names, snippets,
    )
    return {f.__name__: f for f in every}


_WORDS = f"regexp_extract_all(text, '{WORD}')"
_KIND = "doc_id % 10"
#: Texts as their words make them, for the detector, and the words that hold a character.
_MINED = f"""WITH documents AS (SELECT doc_id, source, CASE WHEN {_KIND} = 0 THEN text WHEN {_KIND} IN (1, 3) THEN '' ELSE array_to_string({_WORDS}, '') END AS text, {_WORDS} AS w FROM main.documents WHERE {_KIND} <> 3),
{_HIT_PARTS.format(total=60, repeats=4)},
looped AS (SELECT * FROM hits WHERE first = 1),
t AS (SELECT h.doc_id, d.source, d.w, h.start_char + h.period AS pos, h.period, h.repeats, unnest(d.w) AS word, generate_subscripts(d.w, 1) AS k FROM looped h JOIN documents d USING (doc_id) WHERE {_KIND.replace('doc_id', 'h.doc_id')} <> 0),
e AS (SELECT *, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM t),
made AS (SELECT * FROM e WHERE pos < upto AND pos >= upto - length(word) AND NOT (doc_id % 10 = 2 AND k = 1))"""


def oracle_sql() -> dict[str, str]:
    names = "(SELECT p_partkey, 'org/' || p_name || '_' || p_size || 'b_' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_HF' ELSE '-x' END AS name FROM part)"
    places = f"CASE WHEN {_KIND} IN (0, 1, 3) THEN 0 WHEN {_KIND} = 2 THEN greatest(n - 1, 0) ELSE n END"
    from .queries import _EVENTS, _FIRST

    return {
        "parse_completions": f"SELECT doc_id, {_KIND} = 3 AS failed, CAST(CASE WHEN {_KIND} = 0 THEN length(text) ELSE 0 END AS INTEGER) AS n_chars, CAST(CASE WHEN {_KIND} IN (0, 1, 3) THEN 0 ELSE n END AS INTEGER) AS n_tokens, CAST({places} AS INTEGER) AS n_places, CAST(5 * ({places}) AS INTEGER) AS n_options, round(-4.75 * ({places}), 6)::DOUBLE AS lp FROM (SELECT doc_id, text, len({_WORDS}) AS n FROM documents)",
        "decode_tokens": f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(w, '')) AS text_md5, w[-1] AS last FROM (SELECT doc_id, {_WORDS} AS w FROM documents)",
        "mined_pairs": f"{_MINED} SELECT doc_id || ': ' AS source_prompt, source, word AS rejected_decoded, word || '2|' || word || '1|' || word || 'b' AS chosen, md5(doc_id || ': ' || array_to_string(w[1:k - 1], '')) AS context_md5, CAST(k - 1 AS INTEGER) AS idx, CAST(period AS INTEGER) AS period, CAST(repeats AS INTEGER) AS repeats FROM made",
        "mined_by_source": f"{_MINED} SELECT d.source, count(*) AS n_texts, count(h.doc_id) AS n_loops, count(m.doc_id) AS n_pairs FROM documents d LEFT JOIN looped h USING (doc_id) LEFT JOIN made m USING (doc_id) GROUP BY d.source",
        "failed_responses": f"SELECT {_KIND} = 3 AS failed, count(*) AS n FROM documents GROUP BY 1",
        "first_pairs": f"WITH {_PAIRS} SELECT doc_id, source, token FROM pairs ORDER BY source, doc_id LIMIT 75",
        "loop_rate_rounds": f"{_FIRST}, r AS (SELECT d.doc_id % 3 AS round, count(*) AS n_texts, count(h.doc_id) AS n_loops, 100.0::DOUBLE * count(h.doc_id) / greatest(count(*), 1) AS rate FROM documents d LEFT JOIN looped h USING (doc_id) GROUP BY 1) SELECT round, n_texts, n_loops, round(rate, 6) AS loop_rate, round(rate - lag(rate) OVER (ORDER BY round), 6) AS change FROM r",
        "stream_rates": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n_texts, count(*) FILTER (event_type = 'error') AS n_loops, round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*), 6) AS loop_rate FROM events GROUP BY 1",
        "read_prompts": "SELECT source, md5('<' || CASE WHEN doc_id % 3 = 0 THEN 'user: ' || text || chr(10) || 'assistant: ok' ELSE text END || '>') AS prompt_md5, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_messages FROM documents WHERE NOT contains(lower(source), 'src1')",
        "prompts_of_sources": f"SELECT source, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS n_chats FROM documents WHERE source IN ({', '.join(repr(s) for s in SOURCES)}) GROUP BY source",
        "max_prompts": "SELECT source, CAST(doc_id AS VARCHAR) AS text FROM documents WHERE NOT contains(lower(source), 'src2') ORDER BY doc_id LIMIT 60",
        "chat_roles": "SELECT CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'user' END AS role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1",
        "blank_lines": "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_replace(line, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]', '', 'g') <> '' GROUP BY doc_id",
        "pair_lines": "WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w FROM documents) SELECT doc_id, md5(CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END) AS context_md5, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'two words' ELSE w[1] END AS rejected_token, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 1 ELSE len(w[2:4]) END AS INTEGER) AS n_chosen, true AS no_repetition FROM w",
        "thin_chosen": "WITH k AS (SELECT vec_id, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(abs(x) * 4) AS BIGINT))) AS key, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), c AS (SELECT vec_id, key, count(*) AS c FROM k GROUP BY ALL), p AS (SELECT vec_id, quantile_cont(c, 0.95) AS most FROM c GROUP BY vec_id) SELECT vec_id, CAST(count(*) AS INTEGER) AS n, string_agg(k::VARCHAR, ',' ORDER BY k) AS ids FROM k JOIN c USING (vec_id, key) JOIN p USING (vec_id) WHERE c <= most GROUP BY vec_id",
        "padded_ids": f"WITH i AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(list_concat(list_transform(range({LENGTH} - len(ids)), lambda x: 0), ids), ',') AS padded, array_to_string(list_concat(list_transform(range({LENGTH} - len(ids)), lambda x: 0), range(len(ids))), ',') AS places FROM i",
        "min_chosen": "SELECT doc_id, source FROM documents WHERE doc_id % 9 <> 0 AND least(len(regexp_extract_all(text, '\\S+')), doc_id % 4) >= 2",
        "clipped_norms": "WITH e AS (SELECT a.vec_id, sqrt(list_sum(list_transform(CAST(a.embedding AS DOUBLE[]), lambda x: x * x))) AS g, sqrt(list_sum(list_transform(CAST(b.embedding AS DOUBLE[]), lambda x: x * x))) AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(CASE WHEN g > 0.9 * (p + 1e-3) THEN 0.9 * (p + 1e-3) / (g + 1e-6) ELSE 1.0 END, 9)::DOUBLE AS scale FROM e",
        "named_windows": f"{_EVENTS} SELECT CASE WHEN step % 2 = 0 THEN 'eval_' || event_type ELSE event_type END AS name, (step - 1) // 50 AS \"window\", round(avg(value), 6) AS mean_value, count(*) AS n FROM ev GROUP BY ALL",
        "estimated_steps": f"SELECT source, count(*) AS n, CAST(ceil(count(*) * {EPOCHS} / {BATCH * ACCUMULATION}) AS BIGINT) AS steps FROM documents GROUP BY source",
        "merged_names": f"WITH b AS (SELECT name, regexp_extract(name, '([^/]*)$', 1) AS base FROM {names}), s AS (SELECT name, coalesce(nullif(regexp_extract(base, '(?i)(\\d+B)', 1), ''), 'model') AS size, coalesce(nullif(regexp_extract(base, '_(\\d+)_HF(?:_|$)', 1), ''), regexp_extract_all(base, '\\d+')[-1], 'unknown') AS parent FROM b) SELECT name, regexp_replace('a-user_prefs' || size || '_from' || parent || '_12000-samples_lr1.5e-5_ep1_local-run_HF', '[^A-Za-z0-9._+-]+', '-', 'g') AS merged_name FROM s",
        "snippets": "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS snippet FROM documents",
    }
