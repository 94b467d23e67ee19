"""Sampling invariants, loss against numpy, stops, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.operators import balance, loss, metrics, reports
from echoloom.streaming.detect import detect_files, until_target, windowed_rates


def pairs(spark, n=400):
    rows = [(k, "wait" if k % 3 == 0 else f"t{k % 7}", f"s{k % 5 if k % 2 else 0}") for k in range(n)]
    return spark.createDataFrame(rows, "id long, token string, source string")


def test_quotas_and_sample(spark):
    rows = pairs(spark)
    picked = balance.nested_quotas(balance.count_matrix(rows, "token", "source")[0], "token", "source", 100, 0.8).collect()
    assert sum(r["take"] for r in picked) == 100 and all(r["take"] <= r["n"] for r in picked)
    got = balance.token_ratios(rows, "token", 0.8).collect()
    assert abs(sum(r["ratio"] for r in got) - 1) < 1e-9
    counts = {r["token"]: r["cnt"] for r in got}
    middle = float(np.median(list(counts.values())))
    weight = {t: c * (1 if c <= middle else (middle / c) ** 0.8) for t, c in counts.items()}
    assert all(abs(r["ratio"] - weight[r["token"]] / sum(weight.values())) < 1e-9 for r in got)
    options = dict(token="token", source="source", key="id", strength=0.8, seed=1)
    assert balance.sample_pairs(rows, most=100, **options).count() == 100
    assert balance.sample_pairs(rows, most=None, **options).count() == 400 == balance.sample_pairs(rows, most=1000, **options).count()
    assert balance.sample_pairs(rows.limit(0), most=10, **options).count() == 0
    equal = {r["source"]: r["count"] for r in balance.sample_pairs(rows, most=None, mode="equal", **options).groupBy("source").count().collect()}
    assert max(equal.values()) <= 80
    with pytest.raises(ValueError):
        balance.sample_pairs(rows, most=None, mode="odd", **options)


def test_take_per_group_is_the_plain_top(spark):
    rows = pairs(spark, 3000).withColumn("o", balance.keyed_order(9, "id"))
    quotas = spark.createDataFrame([("s0", 700), ("s1", 3), ("s2", 10_000), ("s3", 0)], "source string, quota long")
    got = {r["id"] for r in balance.take_per_group(rows, ["source"], quotas, "o").collect()}
    want = set()
    every = rows.collect()
    for s, q in (("s0", 700), ("s1", 3), ("s2", 10_000)):
        want |= {r["id"] for r in sorted((r for r in every if r["source"] == s), key=lambda r: r["o"])[:q]}
    assert got == want


def test_loss(spark):
    rng = np.random.default_rng(0)
    rows, data = [], []
    for k in range(12):
        lg, rf = rng.normal(0, 3, 16), rng.normal(0, 3, 16)
        ch = sorted(rng.choice(15, rng.integers(1, 5), replace=False).tolist())
        data.append((lg, rf, ch))
        rows.append((k % 2, lg.tolist(), rf.tolist(), ch, 15))
    df = spark.createDataFrame(rows, "batch int, logits array<double>, ref_logits array<double>, chosen_ids array<int>, rejected_id int")
    terms = loss.with_terms(df)
    got = {r["batch"]: r for r in loss.batch_metrics(terms, "batch").collect()}
    med = {r["batch"]: r["median_delta"] for r in loss.median_delta(terms, "batch").collect()}
    for b in (0, 1):
        pref, win, ts, tn, es, en, deltas, ws = [], [], 0, 0, 0, 0, [], []
        for lg, rf, ch in data[b::2]:
            d = lg[ch] - lg[15]
            w = np.clip((2 - d) / 2, 0, 1)
            pref.append((np.logaddexp(0, 2 - d) * w).sum() / len(ch))
            win.append((d > 0).mean())
            mask = np.ones(16, bool)
            mask[[*ch, 15]] = False
            gap = lg - rf
            ts, tn = ts + (gap[mask] ** 2).sum(), tn + mask.sum()
            es, en = es + (np.maximum(abs(gap[~mask]) - 0.5, 0) ** 2).sum(), en + (~mask).sum()
            deltas += d.tolist()
            ws += w.tolist()
        want = np.mean(pref) + 0.4 * ts / tn + 0.05 * es / en
        assert got[b]["loss"] == pytest.approx(want) and got[b]["chosen_win"] == pytest.approx(np.mean(win)) and got[b]["active_weight"] == pytest.approx(np.mean(ws))
        assert got[b]["margin_win"] == pytest.approx(np.mean(np.array(deltas) >= 2)) and med[b] == pytest.approx(sorted(deltas)[(len(deltas) - 1) // 2])


def greedy(counts, ratios, target):
    """Rows picked one by one in plain loops: of the token furthest below its ratio of what is taken so far, first up to its
    quota, then beyond; of its rows one of the source furthest below its share; ties by token and source."""
    total = sum(counts.values())
    share = {s: sum(n for (_, o), n in counts.items() if o == s) / total for s in {s for _, s in counts}}
    left, seen, chosen, taken = dict(counts), dict.fromkeys(ratios, 0), dict.fromkeys(share, 0), []
    quota = {t: round(r * target) for t, r in ratios.items()}
    for capped in (True, False):
        while len(taken) < target:
            best, n = None, max(len(taken), 1)
            for t, s in sorted(counts):
                if left[t, s] and not (capped and seen[t] >= quota[t]):
                    x = (ratios[t] - seen[t] / n, share[s] - chosen[s] / n)
                    if best is None or x > best[0]:
                        best = (x, t, s)
            if best is None:
                break
            _, t, s = best
            left[t, s] -= 1
            seen[t] += 1
            chosen[s] += 1
            taken.append((t, s))
    return {k: counts[k] - left[k] for k in counts if counts[k] > left[k]}


@pytest.mark.parametrize("strength", [0.0, 0.8, 1.5])
def test_picks_are_those_of_plain_loops(spark, strength):
    """Many tokens of few rows, few of many; targets below and beyond the quotas; equal ratios in every source."""
    rng = np.random.default_rng(int(strength * 10))
    counts = {}
    for k, c in enumerate(rng.zipf(1.6, 90).clip(1, 120)):
        for s in rng.choice(["s0", "s0", "s0", "s1", "s2", "s3"], int(c)):
            counts[f"t{k}", str(s)] = counts.get((f"t{k}", str(s)), 0) + 1
    matrix = spark.createDataFrame([(*k, n) for k, n in counts.items()], "token string, source string, n long")
    totals = matrix.groupBy("token").agg(F.sum("n").alias("cnt"))
    ratios = {r["token"]: round(r["ratio"], 12) for r in balance.ratios_of(totals, "token", strength).collect()}
    every = sum(counts.values())
    for target in (1, 7, 40, every // 4, every // 2, every - 20, every):
        got = {(r["token"], r["source"]): r["take"] for r in balance.nested_quotas(matrix, "token", "source", target, strength).collect() if r["take"]}
        assert got == greedy(counts, ratios, target), target
    assert balance.nested_quotas(matrix.limit(0), "token", "source", 0, strength).count() == 0


def test_the_driver_sees_tokens_that_can_be_picked(spark, monkeypatch):
    """Of 20,000 tokens of one row a few hundred go to the driver, and the picks are those over all of them."""
    rows = spark.range(20_000).selectExpr("concat('t', id % 19990) AS token", "concat('s', id % 3) AS source", "id")
    sizes, plain = [], balance.share_picks
    monkeypatch.setattr(balance, "share_picks", lambda token, *a: (sizes.append(len(token)), plain(token, *a))[1])
    matrix, _ = balance.count_matrix(rows, "token", "source")
    got = {(r["token"], r["source"]): r["take"] for r in balance.nested_quotas(matrix, "token", "source", 60, 0.8).collect() if r["take"]}
    cells = sorted(((r["token"], r["source"], r["n"]) for r in matrix.collect()))
    names, sources = sorted({c[0] for c in cells}), ["s0", "s1", "s2"]
    ratio = {r["token"]: round(r["ratio"], 12) for r in balance.token_ratios(rows, "token", 0.8).collect()}
    share = np.array([sum(n for _, o, n in cells if o == s) / 20_000 for s in sources])
    place = {t: k for k, t in enumerate(names)}
    every = plain(np.array([place[c[0]] for c in cells]), np.array([sources.index(c[1]) for c in cells]), np.array([c[2] for c in cells]), np.array([ratio[t] for t in names]), np.array([round(ratio[t] * 60) for t in names]), share, 60)
    assert got == {c[:2]: int(n) for c, n in zip(cells, every, strict=True) if n} and sum(got.values()) == 60 and sizes[0] < 400


def test_null_tokens_and_sources_are_groups(spark):
    rows = spark.createDataFrame([(k, None if k % 2 else "a", None if k % 5 == 0 else "s") for k in range(60)], "id long, token string, source string")
    options = dict(token="token", source="source", key="id", strength=0.8, seed=1)
    assert balance.sample_pairs(rows, most=20, **options).count() == 20
    assert balance.sample_pairs(rows, most=20, mode="sqrt", **options).count() <= 20
    assert balance.sample_pairs(rows, most=None, mode="equal", **options).groupBy("source").count().count() == 2


def plain_plateau(values, patience, least):
    """The step (odd numbers) of the first log that is ``patience`` logs after the last rise."""
    best, since = None, 0
    for n, v in enumerate(values):
        if best is None or v - best > least:
            best, since = v, 0
        else:
            since += 1
        if since >= patience:
            return n * 2 + 1
    return None


def test_stops(spark):
    values = [0.1, 0.5, 0.4, 0.45, 0.3, 0.9, 0.2]
    log = spark.createDataFrame([("m", k + 1, v) for k, v in enumerate(values)], "key string, step int, value double")
    assert metrics.threshold_stop(log, "key", "step", "value", 0.45).first()["stop_step"] == 2
    assert metrics.threshold_stop(log, "key", "step", "value", 2.0).first()["stop_step"] is None
    assert metrics.plateau_stop(log, "key", "step", "value", patience=3).first()["stop_step"] == 5
    assert metrics.plateau_stop(log, "key", "step", "value", patience=3, min_delta=0.6).first()["stop_step"] == 4
    assert metrics.plateau_stop(log, "key", "step", "value", higher=False, patience=6).first()["stop_step"] == 7
    rng = np.random.default_rng(2)
    series = {k: np.cumsum(rng.normal(0.02, 1, 300)).round(2).tolist() for k in "abc"}
    many = spark.createDataFrame([(k, n * 2 + 1, v) for k, vs in series.items() for n, v in enumerate(vs)], "key string, step int, value double").repartition(5)
    for patience, least, higher in ((10, 0.0, True), (25, 1.5, True), (30, 0.5, False), (1000, 0.0, True)):
        got = metrics.plateau_stop(many, "key", "step", "value", higher=higher, patience=patience, min_delta=least, cell_steps=64)
        assert {r["key"]: r["stop_step"] for r in got.collect()} == {k: plain_plateau(vs if higher else [-v for v in vs], patience, least) for k, vs in series.items()}
    placed = metrics.numbered(many, ["key"], F.floor(F.col("step") / 40), ["step"], "n")
    assert placed.filter("n * 2 - 1 <> step").count() == 0 and placed.count() == 900
    assert {(r["key"], r["n"]) for r in metrics.records(placed, "key", "n", "value", 16).collect()} == {(k, n + 1) for k, vs in series.items() for n, v in enumerate(vs) if all(v > w for w in vs[:n])}
    assert [round(r["mean_value"], 3) for r in metrics.window_means(log, "key", "step", "value", 5).orderBy("window").collect()] == [0.35, 0.55]
    assert reports.loop_rate(log.limit(0), F.lit(True)).first()["loop_rate"] == 0


def test_stream(spark, tmp_path):
    rows = [(k, ("again and again and so on. " * 8) if k % 2 else "plain text", f"2024-01-01 00:{k:02d}:00") for k in range(10)]
    data = spark.createDataFrame(rows, "id int, text string, at string").select("id", "text", F.to_timestamp("at").alias("at"))
    data.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = detect_files(spark, str(tmp_path / "in"), data.schema)
    query = until_target(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 4)
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    for _ in range(2):  # a file a batch: the target is met in the second one, and a restart writes no more
        query = until_target(detect_files(spark, str(tmp_path / "in"), data.schema, files_at_once=1), str(tmp_path / "out2"), str(tmp_path / "ck3"), 4)
        query.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out2")).count() == 4
    query = until_target(detect_files(spark, str(tmp_path / "in"), data.schema), str(tmp_path / "out2"), str(tmp_path / "ck4"), 4)
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out2")).filter("batch > 0").count() <= 4
    rates = windowed_rates(detect_files(spark, str(tmp_path / "in"), data.schema), "at")
    q = rates.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("rates").agg(F.sum("n_loops")).first()[0] == 5
