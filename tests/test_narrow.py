"""What is put in order and looked up: few columns, and only what is asked for."""

from conftest import SF
from courtside.operators import state as st
from courtside.operators import timeline as tm
from courtside.plans import queries
from courtside.sources import matches as src
from pyspark.sql import functions as F


def test_timeline_orders_few_columns(spark, monkeypatch):
    seen, with_splits = [], tm.with_splits
    monkeypatch.setattr(tm, "with_splits", lambda m: seen.append(m.columns) or with_splits(m))
    got = queries.Base(spark, SF).timeline
    assert seen == [["match_num", "tourney_date", "surface", "winner", "loser"]]
    wanted = with_splits(src.derived_matches(spark, SF))
    assert {*got.columns} == {*wanted.columns}
    assert sorted(map(str, got.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_only_asked_events_are_looked_up(spark):
    events = queries.Base(spark, SF).events
    every = st.before_match(events)
    got = st.before_match(events, asked=F.col("split") != "initial")
    later = events.where("split <> 'initial'").select("player", "rn")
    assert got.count() == later.count() < every.count()
    assert sorted(got.collect()) == sorted(every.join(later, ["player", "rn"], "left_semi").select(got.columns).collect())


def test_training_rows_leave_out_sides(spark):
    b = queries.Base(spark, SF)
    rows = queries.training_rows(b)
    assert not [c for c in rows.columns if c.startswith(("winner_", "loser_"))]
    assert rows.where("split = 'initial'").count() == 0 < rows.where("head_to_head_wins_p1 > 0 or player1_last_10_win_percentage > 0").count()
