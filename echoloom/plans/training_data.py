"""Training data: pairs in, filtered, sampled, tokenised features and their reports out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import TrainingConfig
from ..functions.scalar import base_name, chosen_count, format_epochs, format_number, is_trimmed, model_size, parent_id, safe_name, source_label
from ..operators.balance import sample_pairs
from ..operators.features import drop_trimmed, filter_counts, tokenise
from ..operators.metrics import estimated_steps
from ..operators.reports import top_counts, top_of_each
from ..shared import drop_path, stored
from ..sources.readers import write_json


@dataclass
class Prepared:
    dropped: DataFrame
    features: DataFrame
    reasons: DataFrame
    sampled: DataFrame
    by_rejected: DataFrame
    by_chosen: DataFrame
    by_source: DataFrame
    tokenised: DataFrame


def prepare(pairs: DataFrame, encode: Callable[[], Callable[[str], list[int]]], cfg: TrainingConfig = TrainingConfig(), own_source: bool = False) -> Prepared:
    """``own_source`` lets pairs without source fields of their own be balanced by ``source``."""
    untrimmed, dropped = drop_trimmed(pairs)
    rows = untrimmed.withColumn("source_label", source_label("source_dataset", "source_task", "source_eval_key", fallback="source" if own_source else None))
    rows = rows.withColumn("__key", F.sha2(F.to_json(F.struct(*[F.col(c) for c in pairs.columns])), 256))
    sampled = sample_pairs(rows, token="rejected_decoded", source="source_label", key="__key", most=cfg.max_train_examples, strength=cfg.rejected_regularisation_strength, seed=cfg.seed, mode=cfg.source_balance_mode, chosen="multi_chosen_decoded", min_chosen=cfg.min_chosen_tokens).drop("__key")
    tokenised = tokenise(sampled, encode, max_length=cfg.max_seq_length, stop_words=cfg.filter_rejected_stop_words, chosen_strength=cfg.chosen_regularisation_strength)
    features = tokenised.filter(F.col("reject_reason").isNull()).select("prompt_ids", "chosen_ids", "rejected_token_id", "rejected_decoded", "chosen_decoded")
    counted = pairs.withColumn("n_chosen", chosen_count("multi_chosen_decoded").cast("string"))
    return Prepared(dropped, features, filter_counts(tokenised), sampled, top_counts(pairs, "rejected_decoded"), top_counts(counted, "n_chosen"), top_counts(sampled, "source_label"), tokenised)


def steps(cfg: TrainingConfig, examples: int) -> int:
    return estimated_steps(examples, cfg.num_epochs, cfg.batch_size, cfg.gradient_accumulation_steps)


def write_training_data(pairs: DataFrame, encode: Callable[[], Callable[[str], list[int]]], out: str, cfg: TrainingConfig = TrainingConfig(), own_source: bool = False, user: str = "local", job: str = "local") -> dict:
    """Writes <out>/features and, under <out>/reports, the counts by reason, rejected token, number of chosen tokens and
    source; returns the totals with the schedule and, if it is to be made, the merged model's name and folder."""
    ready = prepare(pairs, encode, cfg, own_source)
    spark, counts = pairs.sparkSession, Observation()
    kept = F.col("reject_reason").isNull()
    tokenised, path = stored(ready.tokenised.observe(counts, F.count_if(kept).alias("n")))  # sampled and tokenised once
    write_json(tokenised.filter(kept).select(ready.features.columns), f"{out}/features")
    n = counts.get["n"]
    write_json(filter_counts(tokenised).coalesce(1), f"{out}/reports/reasons")
    write_json(top_counts(tokenised, "source_label").coalesce(1), f"{out}/reports/by_source")
    drop_path(spark, path)
    # what is counted of all pairs, in one pass
    names = {"rejected_decoded": "by_rejected", "n_chosen": "by_chosen", "trimmed": "trimmed"}
    counted = pairs.withColumn("n_chosen", chosen_count("multi_chosen_decoded").cast("string")).withColumn("trimmed", is_trimmed("source_prompt"))
    tops, path = stored(top_of_each(counted, list(names)))
    for column in ("rejected_decoded", "n_chosen"):
        write_json(tops.filter(F.col("name") == column).select(F.col("value").alias(column), "cnt").orderBy(F.desc("cnt"), column).coalesce(1), f"{out}/reports/{names[column]}")
    dropped = tops.filter("name = 'trimmed' AND value = 'true'").agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    drop_path(spark, path)
    report = {"examples": n, "dropped_trimmed": dropped, "steps": steps(cfg, n)}
    if cfg.model_name and cfg.auto_merged_output_name:
        named = model_names(spark.range(1).select(F.lit(cfg.model_name).alias("name")), "name", user=user, job=job, examples=n, rate=cfg.learning_rate, epochs=cfg.num_epochs)
        report["merged_name"] = named.first()["merged_name"]
        report["merged_dir"] = merged_dir(str(cfg.merged_output_dir), report["merged_name"])
    write_json(spark.createDataFrame([report]).coalesce(1), f"{out}/reports/summary")
    return report


def model_names(models: DataFrame, name: str, *, user: str, job: str, examples: int, rate: float, epochs: float, tag: str = "prefs"):
    """Names of models trained from each parent: user_tag-size, parent, samples, rate, epochs, job."""
    parts = F.concat_ws("_", F.concat(safe_name(F.lit(user)), F.lit(f"_{tag}"), model_size(name)), F.concat(F.lit("from"), parent_id(name)), F.lit(f"{examples}-samples"), F.lit(f"lr{format_number(rate)}"), F.lit(f"ep{format_epochs(epochs)}"), safe_name(F.lit(job)), F.lit("HF"))
    return models.select(name, base_name(name).alias("base"), safe_name(parts).alias("merged_name"))


def merged_dir(base: str, name: str, auto: bool = True) -> str:
    """The directory beside ``base``, or ``base`` itself."""
    return base if not auto else f"{base.rstrip('/').rpartition('/')[0] or '.'}/{name}"
