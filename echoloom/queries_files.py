"""The registered queries of whole phases that read and write files, and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .config import MiningConfig, TrainingConfig
from .plans.mine import run_mining
from .plans.training_data import write_training_data
from .queries import _CASCADE, _toy_pairs, word_encoder
from .queries_mining import _completions, _KIND, _MINED, _prompt_lines
from .shared import drop_path, new_path, stored
from .sources import readers
from .sources.lines import NAME as LINES
from .sources.lines import register_lines


def _kept(frame, out):
    result, _ = stored(frame)
    drop_path(frame.sparkSession, out)
    return result


def prompt_files(spark, d):
    """Prompts loaded from JSON lines in files, formatted."""
    out = new_path(spark)
    _prompt_lines(spark, d).write.text(out)
    rows = readers.load_prompts(spark, input_jsonl=out, skip=["src1"])
    prompt = readers.format_prompt(F.col("text"), F.col("chat_messages"), "<{prompt}>")
    return _kept(rows.select("source", F.md5(prompt).alias("prompt_md5"), F.coalesce(F.size("chat_messages"), F.lit(0)).alias("n_messages")), out)


def mining_files(spark, d):
    """What a mining run writes, for each source: records, loops, pairs and failed rows."""
    out = new_path(spark)
    run_mining(_completions(spark, d), out, MiningConfig(temperature=1.0, target_pairs=1_000_000_000))
    lines = [("generations", "source string, status string"), ("pairs", "source string"), ("failed", "source string, error_class string")]
    generations, pairs, failed = (spark.read.schema(kind).json(f"{out}/{name}") for name, kind in lines)
    one, none = F.lit(1), F.lit(0)
    rows = generations.select("source", one.alias("text"), (F.col("status") == "loop_detected").cast("int").alias("loop"), none.alias("pair"), none.alias("lost"))
    rows = rows.unionByName(pairs.select("source", none.alias("text"), none.alias("loop"), one.alias("pair"), none.alias("lost")))
    rows = rows.unionByName(failed.select("source", none.alias("text"), none.alias("loop"), none.alias("pair"), one.alias("lost")))
    return _kept(rows.groupBy("source").agg(*(F.sum(c).alias(n) for c, n in (("text", "n_texts"), ("loop", "n_loops"), ("pair", "n_pairs"), ("lost", "n_failed")))), out)


def training_files(spark, d):
    """The counts by reason that the training phase reports, of pairs read from JSON lines."""
    out = new_path(spark)
    readers.write_json(_toy_pairs(spark, d).withColumn("source", F.col("doc_id").cast("string")).drop("doc_id"), f"{out}/pairs")
    write_training_data(readers.read_pairs(spark, f"{out}/pairs"), word_encoder, out, TrainingConfig(max_train_examples=None, max_seq_length=1000, min_chosen_tokens=0, filter_rejected_stop_words=True))
    return _kept(spark.read.schema("reason string, n long").json(f"{out}/reports/reasons"), out)


def source_lines(spark, d):
    """Completions written and read through the data source of JSON lines, two of their three columns."""
    register_lines(spark)
    out = new_path(spark)
    _completions(spark, d).select("source", "prompt", "response").write.format(LINES).mode("append").save(out)
    rows = spark.read.format(LINES).schema("source string, response string").option("split_bytes", 1 << 20).load(out)
    return _kept(rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("response") == '{"choices": []}').alias("n_without_choices")), out)


def queries():
    return {f.__name__: f for f in (prompt_files, mining_files, training_files, source_lines)}


def oracle_sql() -> dict[str, str]:
    return {
        "prompt_files": "SELECT source, md5('<' || CASE WHEN doc_id % 3 = 0 THEN 'user: ' || text || chr(10) || 'assistant: ok' ELSE text END || '>') AS prompt_md5, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_messages FROM documents WHERE NOT contains(lower(source), 'src1')",
        "mining_files": f"{_MINED}, f AS (SELECT source, count(*) AS n FROM main.documents WHERE {_KIND} = 3 GROUP BY source), m AS (SELECT d.source, count(*) AS n_texts, count(h.doc_id) AS n_loops, count(m.doc_id) AS n_pairs FROM documents d LEFT JOIN looped h USING (doc_id) LEFT JOIN made m USING (doc_id) GROUP BY d.source) SELECT coalesce(m.source, f.source) AS source, coalesce(n_texts, 0) AS n_texts, coalesce(n_loops, 0) AS n_loops, coalesce(n_pairs, 0) AS n_pairs, coalesce(f.n, 0) AS n_failed FROM m FULL JOIN f ON f.source = m.source",
        "source_lines": f"SELECT source, count(*) AS n, count(*) FILTER ({_KIND} = 1) AS n_without_choices FROM documents GROUP BY source",
        "training_files": f"{_CASCADE} SELECT reason, count(*) AS n FROM r GROUP BY reason",
    }
