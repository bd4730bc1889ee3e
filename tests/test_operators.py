from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.operators import curves
from orderlens.operators.hotkeys import flag_repeats
from orderlens.operators.nearest import nearest_in_time
from orderlens.operators.running import ranked_in_time, running_before, time_ranked, value_at_quantile

DAY = 86_400_000_000
EPOCH = datetime(2023, 1, 1)
SCHEMA = "key string, at timestamp, id string"


def brute_force(probes, targets, tolerance):
    found = {}
    for key, at, _ in probes:
        if key is None or at is None:
            continue
        best = None
        for k, t, i in targets:
            if k != key or t is None:
                continue
            gap = abs((at - t) // timedelta(microseconds=1))
            if gap > tolerance:
                continue
            ranked = (i is None, i or "")
            if t <= at:
                choice = (gap, 0, (not ranked[0], tuple(-ord(c) for c in ranked[1])), i)
            else:
                choice = (gap, 1, (ranked[0], tuple(map(ord, ranked[1]))), i)
            if best is None or choice[:3] < best[:3]:
                best = choice
        if best:
            found[(key, at)] = best[3]
    return found


def nearest(spark, probes, targets, tolerance, bucket):
    result = nearest_in_time(
        spark.createDataFrame(probes, SCHEMA), spark.createDataFrame(targets, SCHEMA),
        "key", "at", "id", tolerance, bucket,
    ).collect()
    return {(r["key"], r["at"]): r["id"] for r in result}, sum(r["probe_count"] for r in result)


def test_nearest_against_all_pairs(spark):
    rng = random.Random(11)
    moment = lambda: EPOCH + timedelta(hours=rng.randrange(0, 400) * 12)
    keys = ["a", "b", "c", None]
    name = lambda i: f"{i:03d}"
    targets = [(rng.choice(keys), moment(), name(i)) for i in range(80)]
    targets += [("a", moment(), None), ("a", None, "x"), ("a", targets[0][1], "dup")]
    probes = [(rng.choice(keys), moment(), None) for _ in range(250)] + [("a", None, None)]
    for tolerance, bucket in [(5 * DAY, DAY // 24), (5 * DAY, 30 * DAY), (60 * DAY, 7 * DAY), (0, DAY)]:
        got, _ = nearest(spark, probes, targets, tolerance, bucket)
        assert got == brute_force(probes, targets, tolerance)


def test_nearest_edges(spark):
    limit = timedelta(days=60)
    target = [("k", EPOCH, "t")]
    on, off = EPOCH + limit, EPOCH + limit + timedelta(microseconds=1)
    got, rows = nearest(spark, [("k", on, None), ("k", on, None), ("k", off, None)], target, 60 * DAY, DAY)
    assert got == {("k", on): "t"} and rows == 2
    both = [("k", EPOCH, "before"), ("k", EPOCH + timedelta(days=2), "after")]
    got, _ = nearest(spark, [("k", EPOCH + timedelta(days=1), None)], both, 60 * DAY, DAY)
    assert list(got.values()) == ["before"]


def test_running_before_equals_a_plain_window(spark):
    rng = random.Random(2)
    rows = [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}", rng.randrange(0, 3000), i, rng.randrange(5))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "k string, t long, i int, v long").withColumns(
        {"coarse": F.floor(F.col("t") / 500), "fine": F.floor(F.col("t") / 20)}
    )
    order = [F.col("t"), F.col("i")]
    totals = {"n": F.lit(1).cast("long"), "s": F.col("v")}
    got = running_before(df, ["k"], ["coarse", "fine"], order, totals)
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"n": F.count(F.lit(1)).over(w), "s": F.coalesce(F.sum("v").over(w), F.lit(0))})
    shape = lambda d: sorted(map(tuple, d.select("i", "n", "s").collect()))
    assert shape(got) == shape(want)


def test_quantile_and_rank(spark):
    rng = random.Random(4)
    times = [EPOCH + timedelta(minutes=rng.randrange(0, 200_000)) for _ in range(501)]
    df = spark.createDataFrame([(f"{i}", t) for i, t in enumerate(times)], "id string, t timestamp")
    for share in (0.0, 0.37, 0.8, 1.0):
        micros = [(t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in times]
        got = value_at_quantile(df, "t", share).first()["micros"]
        assert abs(got - np.quantile(micros, share)) < 1
    ranked = time_ranked(df, "t", "id", "r").orderBy("r").collect()
    assert [r["r"] for r in ranked] == list(range(501))
    assert [r["t"] for r in ranked] == sorted(times)


def test_flag_repeats_with_a_hot_null_key(spark):
    keys = [None] * 300 + ["x"] * 200 + [f"k{i}" for i in range(300)] + ["k1", "k2"]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    got = flag_repeats(df, df.select("k"), "k", "again").collect()
    assert len(got) == len(keys)
    repeated = {k for k in keys if keys.count(k) > 1}
    assert all(r["again"] == (r["k"] in repeated) for r in got)
    plan = flag_repeats(df, df.select("k"), "k", "again")._jdf.queryExecution().executedPlan()
    assert "Window" not in plan.toString()


def test_curves_against_brute_force(spark):
    rng = random.Random(8)
    cases = [(g, int(rng.random() < 0.3), round(rng.random(), 2)) for g in "ab" for _ in range(300)]
    df = spark.createDataFrame(cases, "g string, y int, s double")
    metrics = {r["g"]: r for r in curves.binary_metrics(df, "g", "y", "s", F.lit(0.5)).collect()}
    best = {r["g"]: r["threshold"] for r in curves.best_threshold(df, "g", "y", "s").collect()}
    for g in "ab":
        own = [(y, s) for k, y, s in cases if k == g]
        pos, neg = [s for y, s in own if y], [s for y, s in own if not y]
        auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
        points = []
        for t in sorted({s for _, s in own}):
            tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
            points.append((t, tp / (tp + fp), tp / len(pos)))
        recalls = [0.0] + [p[2] for p in reversed(points)]
        ap = sum((recalls[i + 1] - recalls[i]) * p[1] for i, p in enumerate(reversed(points)))
        f1 = [2 * p * r / (p + r + 1e-8) for _, p, r in points]
        assert abs(metrics[g]["roc_auc"] - auc) < 1e-9
        assert abs(metrics[g]["average_precision"] - ap) < 1e-9
        assert best[g] == points[int(np.argmax(f1))][0]


def test_one_class(spark):
    df = spark.createDataFrame([("a", 0, 0.2), ("a", 0, 0.9)], "g string, y int, s double")
    row = curves.binary_metrics(df, "g", "y", "s", F.lit(0.5)).first()
    assert row["roc_auc"] is None and row["average_precision"] is None
    assert (row["f1"], row["precision"], row["recall"]) == (0.0, 0.0, 0.0)
    assert curves.best_threshold(df, "g", "y", "s").first()["threshold"] == 0.5


def test_nearest_counts_only_probes_that_hold(spark):
    rows = [("a", "2020-01-01 10:00:00", True), ("a", "2020-01-01 10:00:00", False), ("a", "2020-01-01 11:00:00", False)]
    probes = spark.createDataFrame(rows, "k string, at string, holds boolean").withColumn("at", F.col("at").cast("timestamp"))
    targets = probes.limit(1).select("k", "at", F.lit("t").alias("id"))
    found = nearest_in_time(
        probes, targets, key="k", at="at", target_id="id", tolerance_micros=10**12, counted=F.col("holds")
    ).collect()
    assert [(r["k"], r["probe_count"], r["id"]) for r in found] == [("a", 1, "t")]


def test_rank_in_time_takes_three_levels(spark):
    rows = [("a", 1, f"{i % 7:03x}{i:05x}") for i in range(200)] + [("a", None, "x"), ("b", 1, "y"), ("a", 1, "00000000")]
    df = spark.createDataFrame(rows, "k string, s long, id string").withColumn("at", F.timestamp_seconds("s"))
    ranked = ranked_in_time(df, "k", "at", "id", "rank")
    got = {(r["k"], r["id"], r["rank"]) for r in ranked.collect()}
    ids = sorted(r[2] for r in rows if r[0] == "a" and r[1])
    want = {("a", i, ids.index(i) + 1) for i in ids} | {("a", "x", len(ids) + 1), ("b", "y", 1)}
    assert got == want
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 4
