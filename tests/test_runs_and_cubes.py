"""All runs of short texts against brute force, and merged cubes against counts of all rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoloom.operators import cubes, runs


def plain_runs(text, min_repeats, min_total, max_period):
    """Every part that repeats and can't be longer on either side, with its smallest period."""
    n, out = len(text or ""), []

    def repeats(a, b, p):
        return all(text[k] == text[k + p] for k in range(a, b - p))

    for a in range(n):
        for b in range(a + 1, n + 1):
            p = next((p for p in range(1, b - a + 1) if repeats(a, b, p)), None)
            if p > max_period or b - a < max(min_repeats * p, min_total):
                continue
            if (a and text[a - 1] == text[a - 1 + p]) or (b < n and text[b] == text[b - p]):
                continue
            out.append((a, b, p, (b - a) // p, text[a : a + p]))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=26) | st.text("aé𝔘", max_size=20), st.integers(2, 4), st.integers(0, 6), st.integers(1, 9))
def test_all_runs_of_short_texts(text, min_repeats, min_total, max_period):
    assert runs.all_runs(text, min_repeats, min_total, max_period) == plain_runs(text, min_repeats, min_total, max_period)


def test_runs_as_a_table_function(spark):
    rows = spark.createDataFrame([(1, "x" + "ab" * 40 + "yz " * 30), (2, None), (3, ""), (4, "no loop here"), (5, "q" * 70)], "id int, text string")
    want = sorted((i, *r) for i, t in rows.collect() for r in runs.all_runs(t))
    assert sorted((r["id"], *tuple(r)[2:]) for r in runs.with_runs(rows, "text").collect()) == want and len(want) == 3
    runs.register_runs(spark)
    rows.createOrReplaceTempView("run_texts")
    got = spark.sql("SELECT id, period, repeats FROM run_texts, LATERAL all_runs(text, 4, 60) WHERE period = 1").collect()
    assert [tuple(r) for r in got] == [(5, 1, 70)]
    assert runs.with_runs(rows.limit(0), "text").count() == 0


def test_a_long_text_of_one_letter_and_a_loop_in_noise():
    assert runs.all_runs("a" * 200_000, max_period=64) == [(0, 200_000, 1, 200_000, "a")]
    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghijklmnop ") for _ in range(20_000))
    unit = "Wait, let me reconsider. "
    assert [r[:4] for r in runs.all_runs(noise + "#" + unit * 5 + "#" + noise)] == [(20_001, 20_001 + 125, 25, 5)]


def test_merged_cubes_are_those_of_all_rows(spark):
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(4)}", rng.choice(["clean", "loop_detected"]), k % 3, f"t{min(rng.randrange(400), rng.randrange(400))}") for k in range(6000)]
    df = spark.createDataFrame(rows, "source string, status string, round int, token string")
    counts = {"n_texts": F.lit(1), "n_loops": (F.col("status") == "loop_detected").cast("int")}
    dimensions = ["source", "status", "round"]
    parts = [cubes.cube(df.filter(F.col("round") == k), dimensions, counts, "token", "token") for k in range(3)]
    whole = cubes.estimates(cubes.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), dimensions, list(counts))).collect()
    got = {(r["level"], r["source"], r["status"], r["round"]): r for r in whole}
    assert len(got) == len(whole)
    for level in range(8):
        groups = {}
        for r in rows:
            groups.setdefault(tuple(None if level >> (2 - k) & 1 else r[k] for k in range(3)), []).append(r)
        for key, held in groups.items():
            r = got.pop((level, *key))
            exact = {}
            for x in held:
                exact[x[3]] = exact.get(x[3], 0) + 1
            assert (r["n_texts"], r["n_loops"]) == (len(held), sum(x[1] == "loop_detected" for x in held))
            assert abs(r["n_distinct"] - len(exact)) <= max(2, 4 * 0.016 * len(exact))
            for item in r["top"]:
                assert 0 <= exact[item["item"]] - item["count"] <= 3.5 / 1024 * len(held) + 1 or abs(exact[item["item"]] - item["count"]) <= 3.5 / 1024 * len(held) + 1
            assert r["top"][0]["count"] >= sorted(exact.values())[-1] - 3.5 / 1024 * len(held) - 1
    assert not got


@pytest.mark.parametrize("dimensions", [["source"], ["source", "round"]])
def test_cubes_of_empty_tables(spark, dimensions):
    df = spark.createDataFrame([], "source string, round int, token string")
    made = cubes.estimates(cubes.cube(df, dimensions, {"n": F.lit(1)}, "token", "token"))
    assert made.filter("n > 0").count() == 0
