"""Boosting on histograms against a plain version that goes over all splits of all leaves; permutation importance."""

import random

import numpy as np
import pytest
from courtside.operators import boosting, importance
from courtside.operators.boosting import UNIT, Binning, best_splits, binned, gradients, train
from pyspark.sql import functions as F
from pytest import approx


def table(seed=1, n=500, missing=0.2):
    """x0 matters, x1 matters by being missing, x2 is noise, x3 constant, x4 all missing."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x0, x1, x2 = round(rnd.gauss(0, 1), 1), rnd.randrange(4) if rnd.random() > missing else None, rnd.randrange(7)
        y = int(rnd.random() < 1 / (1 + np.exp(-(2 * x0 + (2.5 if x1 is None else 0) - 0.5))))
        rows.append((i, i % 3 == 0, y, x0, float(x1) if x1 is not None else (float("nan") if i % 2 else None), float(x2), 1.0, None))
    return rows


SCHEMA = "id long, seg boolean, y int, x0 double, x1 double, x2 double, x3 double, x4 double"
X = ["x0", "x1", "x2", "x3", "x4"]


def plain_best(bins, g, h, least, l2=0.0):
    """(gain, feature, bin, missing_left) by trying all."""
    worth = lambda m: (g[m].sum() / UNIT) ** 2 / (h[m].sum() / UNIT + l2)
    everything, best = np.ones(len(g), bool), None
    for f in range(bins.shape[1]):
        for b in sorted(set(bins[:, f].tolist()) - {0}):
            for missing_left in (False, True):
                left = np.where(bins[:, f] == 0, missing_left, bins[:, f] <= b)
                if min(left.sum(), (~left).sum()) < least:
                    continue
                gain = round(worth(left) + worth(~left) - worth(everything), 9)
                if best is None or (gain, -f, -b, -missing_left) > best:
                    best = (gain, -f, -b, -missing_left)
    return best and best[0] > 0 and (best[0], -best[1], -best[2], bool(-best[3])) or None


def plain_tree(bins, g, h, leaves, least, depth=None):
    """Best-first growth; the leaves' rows with their values."""
    grown = [(np.arange(len(g)), 0)]
    while len(grown) < leaves:
        found = [(plain_best(bins[r], g[r], h[r], least) if len(r) and d != depth else None, k) for k, (r, d) in enumerate(grown)]
        found = [(s, k) for s, k in found if s]
        if not found:
            break
        (gain, f, b, m), k = max(found, key=lambda x: x[0][0])
        rows, d = grown.pop(k)
        left = np.where(bins[rows, f] == 0, m, bins[rows, f] <= b)
        grown += [(rows[left], d + 1), (rows[~left], d + 1)]
    value = np.zeros(len(g))
    for r, _ in grown:
        value[r] = -(g[r].sum() / UNIT) / (h[r].sum() / UNIT)
    return value


def test_splits_are_the_best(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for node in range(12):
        bins = np.stack([rng.integers(0, 5, 60), rng.integers(1, 3, 60), np.where(rng.random(60) < 0.5, 0, 1)], 1)
        g, h = rng.integers(-UNIT, UNIT, 60), rng.integers(1, UNIT // 4, 60)
        want[node] = plain_best(bins, g, h, 5)
        rows += [(node, f, int(bins[i, f]), int(g[i]), int(h[i]), 1) for i in range(60) for f in range(3)]
    found = best_splits(spark.createDataFrame(rows, "node int, feature int, bin int, g long, h long, n long"), ["node"], least_rows=5).collect()
    assert len(found) == 12
    for r in found:
        s = r.split
        assert (s and (approx(s.gain), s.feature, s.bin, s.missing_left)) == want[r.node]


@pytest.mark.parametrize("depth", [None, 2])
def test_trees_grow_best_leaf_first(spark, depth):
    rows = table()
    model = train(spark.createDataFrame(rows, SCHEMA).repartition(5), X, "y", "seg", iterations=3, leaves=6, depth=depth, least_rows=15)
    assert model.keys == [False, True] and [len(t) for t in model.trees] == [3, 3]
    columns = [np.array([np.nan if r[k] is None else r[k] for r in rows], float) for k in range(3, 8)]
    bins, seg, y = model.binning.bins(columns), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for m, key in enumerate(model.keys):
        own = seg == key
        share = y[own].mean()
        score = np.full(own.sum(), np.log(share / (1 - share)))
        for _ in range(3):
            score += 0.1 * plain_tree(bins[own], *gradients(y[own], score), 6, 15, depth)
        assert boosting.scored(np.full(own.sum(), m), bins[own], model.base, model.trees) == approx(1 / (1 + np.exp(-score)))
    got = {r.id: r.p for r in spark.createDataFrame(rows, SCHEMA).select("id", model.probability(F.col("seg")).alias("p")).collect()}
    assert got == {r[0]: approx(p) for r, p in zip(rows, boosting.scored(seg.astype(int), bins, model.base, model.trees), strict=True)}
    assert model.gains[0][0] > model.gains[0][2] and model.gains[0][3] == model.gains[0][4] == 0


def test_settled_scores_and_order_change_nothing(spark, monkeypatch):
    rows = table(3, 200)
    one = train(spark.createDataFrame(rows, SCHEMA).coalesce(1), X, "y", "seg", iterations=4, leaves=4)
    monkeypatch.setattr(boosting, "SETTLE", 1)
    two = train(spark.createDataFrame(rows[::-1], SCHEMA).repartition(6), X, "y", "seg", iterations=4, leaves=4)
    for a, b in zip(sum(one.trees, []), sum(two.trees, []), strict=True):
        assert all((getattr(a, k) == getattr(b, k)).all() for k in ("feature", "bin", "missing_left", "left", "right", "value"))


def test_bins(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), None) for i in range(1000)] + [(None, float("nan"), None)], "a double, b double, c double")
    b = binned(df, ["a", "b", "c"], 10)
    assert len(b.upper[0]) == 9 and b.upper[1].tolist() == [0.5, 1.5] and len(b.upper[2]) == 0
    out = b.bins([np.array([-5, 0, 999, np.nan]), np.array([0, 1, 2, np.nan]), np.array([np.nan, 1, 2, 3])])
    assert out[:, 1].tolist() == [1, 2, 3, 0] and out[:, 2].tolist() == [0, 1, 1, 1] and out[0, 0] == out[1, 0] == 1 and out[2, 0] == 10 and out[3, 0] == 0
    counts = np.bincount(b.bins([np.arange(1000.0)] + [np.zeros(1000)] * 2)[:, 0])[1:]
    assert counts.min() > 80 and counts.max() < 120


def test_errors_and_one_class(spark):
    df = spark.createDataFrame(table(n=60), SCHEMA)
    with pytest.raises(ValueError, match="more than"):
        train(df, X, "y", "id", iterations=1)
    with pytest.raises(ValueError, match="no rows"):
        train(df.limit(0), X, "y", "seg", iterations=1)
    model = train(df.withColumn("y", F.lit(1)), X, "y", "seg", iterations=2)
    assert df.where(model.probability(F.col("seg")) < 0.99).count() == 0
    with pytest.raises(Exception, match="no model for"):
        df.select(model.probability(F.lit(None).cast("boolean"))).collect()


def test_beats_filled_trees_where_missing_means_something(spark):
    df = spark.createDataFrame(table(5, 3000, 0.4), SCHEMA).withColumn("seg", F.lit("all"))
    model = train(df.where("id % 3 > 0"), X, "y", "seg", iterations=15, leaves=8)
    right = df.where("id % 3 = 0").select(((model.probability(F.col("seg")) > 0.5) == (F.col("y") == 1)).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    without = train(df.fillna(1.5, ["x1"]).withColumn("x1", F.nanvl("x1", F.lit(1.5))).where("id % 3 > 0"), ["x0", "x2"], "y", "seg", iterations=15, leaves=8)
    other = df.where("id % 3 = 0").select(((without.probability(F.col("seg")) > 0.5) == (F.col("y") == 1)).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert right > other + 0.03 and right > 0.8


@pytest.mark.parametrize("digits", [0, 1, None])
def test_values_are_permuted_within_blocks(spark, digits):
    df = spark.range(300).select("id", F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    got = importance.permuted(df, ["a", "b"], "id", digits=digits).collect()
    assert sorted(r.permuted_a for r in got) == list(range(300)) and sum(r.permuted_a == r.a for r in got) <= 16
    assert sorted(r.permuted_b for r in got if r.permuted_b is not None) == list(range(0, 300, 2))  # missing values move as well
    assert [r.permuted_a for r in got] != [r.permuted_b for r in got]
    again = importance.permuted(df.repartition(3), ["a", "b"], "id", digits=digits).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_importance_of_what_matters(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7 > 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 7 > 3).alias("y"))
    got = {r.feature: r for r in importance.permutation_importance(df, ["a", "b"], lambda c: c["a"] == F.col("y"), "id").collect()}
    assert got["a"].accuracy == got["b"].accuracy == 1 and got["b"].importance == 0 and got["a"].importance == approx(2 * 3 / 7 * 4 / 7, abs=0.05)


def test_binning_of_unseen_values():
    b = Binning(["a"], [np.array([0.5, 1.5])])
    assert b.bins([np.array([-np.inf, 0.5, 0.50001, np.inf, np.nan])])[:, 0].tolist() == [1, 1, 2, 3, 0]
