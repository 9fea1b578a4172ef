"""Steps of the URL tree that several others read are written, so plans don't repeat each other's parts."""

from courtside.llm import url_filters as u
from pyspark.sql import functions as F


def test_inherited_branches_are_written(spark):
    rows = [(h, s, t, 4, n, n * b) for h in ("a", "b") for s, n, b in (("x", 2, 1), ("y", 2, h == "a"), ("z", 0, 0)) for t in ("p", "q")]
    counts = spark.createDataFrame([(h, s, t, u_, n, int(b)) for h, s, t, u_, n, b in rows], "host string, s string, tail string, urls long, labelled long, blocked long")
    back = u._backed(counts, [F.col("host")], F.col("s"), F.col("tail"), 0.5)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert {(r["at"]["host"], r.s) for r in back.collect()} == {("a", "z"), ("b", "z")}
    assert u._backed(counts.where("s <> 'y'"), [F.col("host")], F.col("s"), F.col("tail"), 0.5) is None  # no siblings to tell by
