"""What a task sorts stays bounded, whatever the rows are in all."""

from courtside.operators import parts
from courtside.operators import state as st
from test_ordered import timeline
from pyspark.sql import functions as F


def test_tasks_sort_a_bounded_number_of_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    sizes = parts.spread(df, "k", task_rows=1000).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] < 1500 and sizes[1] == 20
    assert parts.spread(df, "k").rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_frames_over_spread_players(spark):
    events = st.player_match_events(timeline(spark))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(st.before_match(events, 50)) == rows(st.before_match(events))
    spread = st.before_match(events, 50)
    assert spread.rdd.getNumPartitions() == 12


def test_last_match_of_a_date(spark):
    after = st.after_match(st.player_match_events(timeline(spark)))
    for lookup, by in (("form", ["player"]), ("surface", ["player", "surface"]), ("head_to_head", ["player", "opponent"])):
        last = after.groupBy(*by, "tourney_date").agg(F.max("rn").alias("rn"))
        got = after.where(f"last_of_{lookup}").select(*by, "tourney_date", "rn")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, last.collect()))
