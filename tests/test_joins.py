"""As-of and interval joins against loops over all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from echoloom.config import Repetition
from echoloom.operators.joins import asof_join, interval_join
from echoloom.operators.probes import hits_by_joins
from echoloom.operators.repetition import detect


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_asof(left, right, direction, strict, tolerance):
    out = []
    for k, at, tag in left:
        found = None
        if k is not None and at is not None:
            near = [(p, t) for j, p, t in right if j == k and p is not None and (p != at or not strict) and (tolerance is None or abs(p - at) <= tolerance)]
            back = max((x for x in near if x[0] <= at), default=None)
            first = min((p for p, _ in near if p >= at), default=None)
            ahead = None if first is None else max(x for x in near if x[0] == first)
            found = back if direction == "backward" else ahead
            if direction == "nearest":
                found = back if ahead is None or (back is not None and at - back[0] <= ahead[0] - at) else ahead
        out.append((k, at, tag, None if found is None else found[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("strict,tolerance,cell", [(False, None, None), (True, None, 7), (False, 9, 5), (True, 4, None), (False, None, 3), (False, 30, 50)])
def test_asof_join(spark, direction, strict, tolerance, cell):
    rng = random.Random(repr((direction, strict, tolerance, cell)))
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])  # noqa: E731  a hot key, and null
    place = lambda: rng.choice([None, *range(-60, 60)])
    left = [(key(), place(), k) for k in range(150)] + [("only left", 1, 999)]
    right = [(key(), place(), k % 90) for k in range(100)] + [("only right", 1, 5)]
    a, b = spark.createDataFrame(left, "k string, at long, tag int"), spark.createDataFrame(right, "k string, at2 int, tag int")
    got = asof_join(a, b, ["k"], "at", "at2", direction=direction, strict=strict, tolerance=tolerance, cell=cell)
    assert got.columns == ["k", "at", "tag", "match"]
    assert rows_of(got.select("k", "at", "tag", "match.tag")) == plain_asof(left, right, direction, strict, tolerance)


def test_asof_join_of_times_empty_sides_and_clashing_names(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([(1, t(10), "x"), (1, t(59), "y")], "id int, ts timestamp, `__join_key` string")
    right = spark.createDataFrame([(1, t(5), 0.5), (1, t(9), 0.25)], "id int, ts timestamp, value double")
    got = asof_join(left, right, ["id"], "ts", "ts", tolerance=dt.timedelta(minutes=30), cell=dt.timedelta(minutes=1))
    assert rows_of(got.select("__join_key", "match.value")) == [("x", 0.25), ("y", None)]
    assert rows_of(asof_join(left, right.limit(0), ["id"], "ts", "ts").select("__join_key", "match.value")) == [("x", None), ("y", None)]
    assert asof_join(left.limit(0), right, ["id"], "ts", "ts", cell=1000).count() == 0
    floats = spark.createDataFrame([(1, 0.5), (1, float("nan"))], "id int, p double")
    assert asof_join(floats, floats, ["id"], "p", "p", strict=True).count() == 2
    with pytest.raises(ValueError):
        asof_join(left, right, ["id"], "ts", "ts", direction="sideways")


def test_cells_split_a_hot_key(spark):
    """Of 20,000 rows of one key no window group has more than a cell's, and the plan has neither a join nor Python."""
    rows = spark.range(20_000).select(F.lit(1).alias("k"), "id")
    probes = rows.filter("id % 7 = 0")
    got = asof_join(probes, rows.filter("id % 100 = 0"), ["k"], "id", "id", cell=500)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Python" not in text
    assert got.filter(F.col("match.id") != F.col("id") - F.col("id") % 100).count() == 0 and got.count() == probes.count()


def test_hits_by_joins(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, "ab" * 3000), (-2, None), (-3, ""), (-4, "x" * 17), (-5, "abcdefghij" * 400 + "end")], "doc_id long, text string"))
    for r in (Repetition(), Repetition(min_repeats=2, min_total_repeated=32, sample_len=8, sample_interval=40, max_period=200)):
        want = sorted((d["doc_id"], h["start"], h["end"], h["period"], h["repeats"], h["snippet"], h["repeat_start"]) for d in docs.collect() if (h := detect(d["text"], r)))
        assert sorted(map(tuple, hits_by_joins(docs, "doc_id", r=r, cell=300).collect())) == want and len(want) > 2


def plain_interval(points, spans, left=False):
    out = []
    for k, at, tag in points:
        met = [(a, b, s) for j, a, b, s in spans if k is not None and j == k and None not in (at, a, b) and a <= at < b]
        out += [(k, at, tag, *m) for m in met] or ([(k, at, tag, None, None, None)] if left else [])
    return sorted(out, key=repr)


@pytest.mark.parametrize("narrowest,hot_rows", [(1, 10), (64, 100_000), (7, 3), (1000, 25)])
def test_interval_join(spark, narrowest, hot_rows):
    """Spans of lengths from 0 to millions; one key has most rows, one place very many points."""
    rng = random.Random(narrowest)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    points = [(key(), rng.choice([None, 5, 5, *range(-300, 300)]), k) for k in range(300)]
    starts = [(key(), rng.randrange(-300, 300), k) for k in range(60)]
    spans = [(k, a, a + rng.choice([0, 1, 2, 3, 10, 64, 65, 500, 10**6, -4]), s) for k, a, s in starts] + [(1, None, 5, 77), (1, -(10**7), 10**7, 78)]
    p, s = spark.createDataFrame(points, "k int, at long, tag int"), spark.createDataFrame(spans, "k int, start long, stop long, span int")
    options = {"narrowest": narrowest, "hot_rows": hot_rows}
    assert rows_of(interval_join(p, s, ["k"], "at", "start", "stop", **options)) == plain_interval(points, spans)
    assert rows_of(interval_join(p, s, ["k"], "at", "start", "stop", how="left", **options)) == plain_interval(points, spans, True)


def test_interval_join_of_empty_sides(spark):
    p, s = spark.createDataFrame([(1, 5)], "k int, at long"), spark.createDataFrame([(1, 0, 9)], "k int, start long, stop long")
    assert interval_join(p, s.limit(0), ["k"], "at", "start", "stop").count() == 0
    assert rows_of(interval_join(p, s.limit(0), ["k"], "at", "start", "stop", how="left")) == [(1, 5, None, None)]
    assert interval_join(p.limit(0), s, ["k"], "at", "start", "stop").count() == 0


def test_an_interval_join_never_joins_on_the_key_alone(spark):
    """Of an id with 10,000 spans and points no task gets all: what meets is dealt by bins as well."""
    p, s = spark.range(10_000).selectExpr("1 AS k", "id AS at"), spark.range(10_000).selectExpr("1 AS k", "id AS start", "id + 1 AS stop")
    got = interval_join(p, s, ["k"], "at", "start", "stop", narrowest=64)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 10_000 and "__join_bin" in text and "BroadcastNestedLoop" not in text and "Cartesian" not in text


def test_only_places_that_a_probe_meets_are_rows(spark):
    """Every place of every text was shuffled."""
    from echoloom.operators.probes import near_places

    plain, loop = "".join(f"{k:05d};" for k in range(9000)), "a loop of words; " * 3000
    rows = spark.createDataFrame([(1, plain), (2, plain[:20_000] + "x" * 900 + plain[20_000:30_000]), (3, loop)], "id long, text string").withColumn("n", F.length("text"))
    got = near_places(rows).collect()
    assert {r["id"] for r in got} == {2, 3} and all(19_000 < r["probe"] < 22_000 for r in got if r["id"] == 2)
    assert len(got) <= 8 + len(loop) // 128 + 1 and all(0 < abs(p - r["probe"]) <= 1024 and len(r["places"]) <= 2 for r in got for p in r["places"])
    found = hits_by_joins(rows.select("id", "text"), "id").collect()
    want = [(i, detect(t)) for i, t in rows.select("id", "text").collect()]
    assert sorted((r["id"], r["start"], r["end"]) for r in found) == [(i, h["start"], h["end"]) for i, h in want if h]


def test_tokens_of_texts_without_a_loop_are_not_joined(spark, small_dir):
    from echoloom import queries as core

    text = core.queries()["loop_tokens"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 3  # the detector on both sides, before tokens become rows
