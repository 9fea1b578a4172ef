"""Permuted features judged in one go, and what binning reads."""

import numpy as np
import pyarrow as pa
from courtside.operators import boosting, importance
from pyspark.sql import functions as F


def rows(spark, n=3000):
    x = spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 101).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.hash("id") % 1000).cast("double").alias("b"), (F.col("id") % 2).cast("double").alias("c"), (F.col("id") % 3 == 0).alias("top"))
    return x.withColumn("y", ((F.col("a") + F.col("c") * 30 + F.hash("id", F.lit(1)) % 40) > 60).cast("int"))


def test_blocks_move_as_windows_do(spark):
    x = rows(spark)
    found = {r["id"]: r for r in importance.permuted(x, ["a", "b", "c"], "id", rows=250).collect()}  # a digit is needed
    wanted = {r["id"]: r for r in importance.permuted(x, ["a", "b", "c"], "id", digits=1).collect()}
    assert found == wanted and len(found) == 3000


def test_judged_together_as_one_by_one(spark):
    x = rows(spark)
    model = boosting.train(x, ["a", "b", "c"], "y", "top", iterations=3, depth=3)
    right = lambda c: (model.probability(F.col("top"), c) > 0.5) == (F.col("y") == 1)
    each = lambda others: F.transform(model.probabilities(F.col("top"), others), lambda p: (p > 0.5) == (F.col("y") == 1))
    found, wanted = (sorted(importance.permutation_importance(x, ["a", "b", "c"], f, "id", by=["top"], correct_each=g).collect()) for f, g in ((None, each), (right, None)))
    assert found == wanted and max(r["importance"] for r in found) > 0.1


def test_binning_counts_in_few_buffers(spark):
    """Only features of many values have quantiles taken, and distinct values aren't counted in hundreds of columns each."""
    plans, x = [], rows(spark)
    agg = type(x).agg
    try:
        type(x).agg = lambda self, *c: plans.append(str(c)) or agg(self, *c)
        got = boosting.binned(x, ["a", "b", "c"], 255)
    finally:
        type(x).agg = agg
    assert [len(u) for u in got.upper][::2] == [100, 1] and len(got.upper[1]) > 200
    assert "approx_count_distinct" not in "".join(plans)
    assert "percentile" in plans[-1] and "f1" in plans[-1] and "f0" not in plans[-1] and "f2" not in plans[-1]


def test_histograms_of_sliced_batches():
    rnd = np.random.default_rng(3)
    bins = rnd.integers(0, 5, (1000, 4)).astype(np.uint16)
    table = pa.RecordBatch.from_arrays([pa.array(np.zeros(1000, np.int32)), pa.array(np.ones(1000)), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(np.zeros(1000))], names=["model", "label", "bins", "score"])
    assert (boosting._matrix(table.slice(100, 50), 4) == bins[100:150]).all()
    root = boosting._Growing().tree()
    whole, cut = (pa.Table.from_batches(list(boosting._histograms([[]], [root], [[0]], [5] * 4)(iter(b)))) for b in ([table], [table.slice(0, 7), table.slice(7, 900), table.slice(907)]))
    assert whole.equals(cut) and sum(whole.column("n").to_pylist()) == 4000
