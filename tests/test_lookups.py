"""Lookups of pair features: few joins, and the values of one join for each thing looked up."""

from courtside.operators import features as ft
from courtside.operators import state as st
from courtside.plans.queries import Base
from pyspark.sql import functions as F

from conftest import SF


def _rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_lookups_equal_those_of_one_join_each(spark):
    b = Base(spark, SF)
    odd = spark.createDataFrame([(-1, None, "P7"), (-2, "P8", None), (-3, "P7", "Nobody"), (-4, "P7", "P7"), (-5, None, None)], "match_num long, player1 string, player2 string")
    pairs = b.diffs.select("match_num", "player1", "player2", "surface").unionByName(odd.withColumn("surface", F.lit("Unknown")))
    wins = st.totals(b.known, "player", "opponent").select("player", "opponent", "wins")
    columns = ["match_num", "head_to_head_wins_p1", "head_to_head_wins_p2"]
    got = ft.head_to_head_lookup(pairs, b.known)
    assert _rows(got, columns) == _rows(ft.head_to_head_from(pairs, wins), columns) and got.columns == [*pairs.columns, *columns[1:]]
    columns = ["match_num", *(f"player{i}_{c}" for c in ("last_5_win_percentage", "last_10_win_percentage", "surface_last_10_win_percentage", "preferred_surface") for i in (1, 2))]
    assert _rows(ft.form_and_surface_lookup(pairs, b.known), columns) == _rows(ft.surface_lookup(ft.form_lookup(pairs, b.known), b.known), columns)


def test_pairs_are_joined_once_a_side_and_once_for_both(spark):
    b = Base(spark, SF)
    joins = lambda df: df._jdf.queryExecution().analyzed().toString().count("Join LeftOuter, ")
    assert joins(ft.pair_features(b.pairs, b.known)) - joins(b.pairs) - 2 * joins(st.player_state(b.known)) <= 5  # of which the rates' own are two
