"""Exact quantiles against numpy, with few and many values, ties and extreme sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.operators.quantiles import exact_quantiles

Q = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}


def plain(values, q, form):
    xs = sorted(values)
    if form == "lower":
        return xs[max(1, math.ceil(q * len(xs))) - 1]
    at = (len(xs) - 1) * q
    low, part = math.floor(at), at - math.floor(at)
    return xs[low] if not part else xs[low] * (1 - part) + xs[low + 1] * part


@pytest.mark.parametrize("cell_rows", [2, 4096])
@pytest.mark.parametrize("form", ["lower", "interpolated"])
def test_against_numpy(spark, form, cell_rows):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(0, 1, 900).tolist(),
        "ties": rng.integers(0, 4, 300).astype(float).tolist(),
        "same": [7.25] * 50,
        "close": (1 + rng.random(400) * 1e-12).tolist(),
        "sizes": (rng.choice([-1.0, 1.0], 200) * 10.0 ** rng.integers(-300, 300, 200)).tolist(),
        "tiny": [5e-324, -5e-324, 0.0, -0.0, 1.7976931348623157e308, -1.7976931348623157e308, 1.0],
        "one": [-3.0],
        "two": [1.0, 2.0],
        None: [1.0, 2.0, 4.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("normal", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", Q, form, cell_rows).collect()}
    assert set(got) == {*groups, "nothing"} and all(got["nothing"][c] is None for c in Q)
    for k, vs in groups.items():
        for c, q in Q.items():
            assert got[k][c] == pytest.approx(plain(vs, q, form), rel=1e-12, abs=1e-300), (k, c)
    whole = exact_quantiles(df, [], "v", {"m": 0.5}, form, cell_rows).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(plain([v for vs in groups.values() for v in vs], 0.5, form))


def test_nan_and_infinite_values_and_empty_tables(spark):
    df = spark.createDataFrame([("x", float(v)) for v in ("nan", "inf", "-inf", "1", "2")], "k string, v double")
    got = exact_quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}).first()
    assert [got["a"], got["b"], got["c"], got["d"]] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got["e"])
    assert exact_quantiles(df.limit(0), ["k"], "v", Q).count() == 0
    assert exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).first()["m"] is None
    with pytest.raises(ValueError):
        exact_quantiles(df, ["k"], "v", Q, "nearest")


def test_a_hot_group_is_refined_until_few_values_are_left(spark):
    """100,000 different values of one group, 4 a cell at the end: the middle one, and no sort of more than a cell."""
    df = spark.range(100_000).select(F.lit("hot").alias("k"), (F.lit(1.0) + F.col("id") / 1e9).alias("v")).repartition(8)
    got = exact_quantiles(df, ["k"], "v", {"m": 0.5}, "lower", cell_rows=4).first()
    assert got["m"] == 1.0 + 49_999 / 1e9
