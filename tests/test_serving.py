"""Serving folds the events once, however many lookups and sides read them."""

from types import SimpleNamespace

from courtside.plans import queries, serving
from pyspark.sql import functions as F


def test_events_are_folded_once(spark):
    b = queries.Base(spark, "/root/testdata/sf0.001")
    routed = SimpleNamespace(predict=lambda x: x.withColumns({"predicted": F.lit(1), "p_player1": F.col("player1_last_5_win_percentage") + F.col("head_to_head_wins_p1")}))
    pairs = queries._neighbours(b)
    out = serving.predict_matches(pairs, b.events, routed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    assert out.count() == pairs.count() > 0
