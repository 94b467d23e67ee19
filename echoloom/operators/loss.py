"""Evaluation of the single-token preference loss over rows of logits.

A row holds logits, ref_logits (arrays over the vocabulary), chosen_ids and rejected_id (from 0). Row terms are
array expressions; a batch (a group) is one partial aggregation with the sums that its ratios need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

#: Fixed value: softplus is taken as its argument from here on.
_LINEAR = 20.0


def softplus(x: Column) -> Column:
    return F.when(x > _LINEAR, x).otherwise(F.log1p(F.exp(x)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def with_terms(rows: DataFrame, epsilon: float = 2.0, tau_target: float = 0.5) -> DataFrame:
    """Adds the row's terms of loss and metrics."""
    bad = F.get("logits", F.col("rejected_id"))
    rows = rows.withColumn("delta", F.transform("chosen_ids", lambda c: F.get("logits", c) - F.get("logits", F.col("rejected_id"))))
    rows = rows.withColumn("weight", F.transform("delta", lambda d: F.least(F.greatest((epsilon - d) / epsilon, F.lit(0.0)), F.lit(1.0))))
    n = F.size("chosen_ids")
    pref = _sum(F.zip_with("delta", "weight", lambda d, w: softplus(epsilon - d) * w)) / F.greatest(n, F.lit(1))
    moved = F.array_union(F.transform("chosen_ids", lambda c: c.cast("bigint")), F.array(F.col("rejected_id").cast("bigint")))
    gaps = F.zip_with("logits", "ref_logits", lambda a, b: a - b)
    target_gaps = F.transform(moved, lambda k: F.get("logits", k.cast("int")) - F.get("ref_logits", k.cast("int")))
    rows = rows.withColumn("__gaps", gaps).withColumn("__moved", target_gaps)
    all_square = _sum(F.transform("__gaps", lambda g: g * g))
    moved_square = _sum(F.transform("__moved", lambda g: g * g))
    excess = _sum(F.transform("__moved", lambda g: F.pow(F.greatest(F.abs(g) - tau_target, F.lit(0.0)), F.lit(2.0))))
    return rows.select(
        "*",
        pref.alias("pref"),
        n.alias("n_chosen"),
        F.size(F.filter("delta", lambda d: d > 0)).alias("n_won"),
        F.size(F.filter("delta", lambda d: d >= epsilon)).alias("n_margin"),
        (all_square - moved_square).alias("tether"),
        (F.size("__gaps") - F.size("__moved")).alias("n_tether"),
        excess.alias("excess"),
        F.size("__moved").alias("n_target"),
        bad.alias("rejected_logit"),
    ).drop("__gaps", "__moved")


def batch_metrics(rows: DataFrame, *by: str, lambda_mse: float = 0.4, lambda_target: float = 0.05) -> DataFrame:
    """Loss and metrics of each batch: means over rows of pref and chosen_win, ratios of sums of the others."""
    sums = rows.groupBy(*by).agg(
        F.avg("pref").alias("pref_loss"),
        (F.sum("tether") / F.sum("n_tether")).alias("mse_elem"),
        (F.sum("excess") / F.sum("n_target") if lambda_target else F.lit(0.0)).alias("mse_target"),
        F.avg(F.when(F.col("n_chosen") > 0, F.col("n_won") / F.col("n_chosen")).otherwise(0.0)).alias("chosen_win"),
        F.coalesce(F.try_divide(F.sum("n_margin"), F.sum("n_chosen")), F.lit(0.0)).alias("margin_win"),
        F.try_divide(F.sum(_sum(F.col("delta"))), F.sum("n_chosen")).alias("mean_delta"),
        F.try_divide(F.sum(_sum(F.col("weight"))), F.sum("n_chosen")).alias("active_weight"),
    )
    return sums.withColumn("loss", F.col("pref_loss") + lambda_mse * F.col("mse_elem") + lambda_target * F.col("mse_target"))


def median_delta(rows: DataFrame, *by: str) -> DataFrame:
    """The lower middle of all deltas of a batch, exact for a batch of any size without holding it."""
    return exact_quantiles(rows.select(*by, F.explode("delta").alias("__delta")), list(by), "__delta", {"median_delta": 0.5}, "lower")


def clipped_norm_scale(grad: Column, param: Column, clip: float = 0.01, eps: float = 1e-3) -> Column:
    """Factor that brings a gradient's norm down to clip * (norm of the parameter + eps)."""
    g, p = (F.sqrt(_sum(F.transform(x, lambda v: v * v))) for x in (grad, param))
    most = clip * (p + eps)
    return F.when(g > most, most / (g + 1e-6)).otherwise(1.0)
