"""Scoring of hypothetical matches from the players' latest state, by the features that training uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as ft
from ..operators import state as st
from ..operators.models import Routed
from ..sources.matches import written


def predict_matches(pairs: DataFrame, events: DataFrame, routed: Routed, as_of: str | None = None) -> DataFrame:
    """pairs: (player1, player2, surface). Returns them with predicted (1 or 2) and p_player1. An unknown player is an
    error. A pair goes to the top-10 model if either player's latest rank is in the top 10. What is missing gets the medians
    that the models learned with, so a pair's prediction doesn't depend on the others asked for. as_of: a date; the players'
    state is then that before it, and who hadn't played by then is unknown."""
    events = st.as_of(events, as_of) if as_of else events
    pairs, state = written(pairs), written(st.player_state(events))  # the state has a row a player; else each lookup's side folds all events
    x = ft.side_by_side(pairs, state)
    for i in (1, 2):
        x = x.withColumns({f"player{i}_{c}": F.col(f"p{i}_{c}") for c in ("rank", "age", "ht")} | {f"player{i}_seed": F.col(f"p{i}_seed"), f"player{i}_hand": F.lit(None).cast("string")})
    x = x.withColumn("is_top", S.is_top_10(F.col("p1_rank")) | S.is_top_10(F.col("p2_rank")))
    x = x.withColumn("asked", F.col("surface")).drop(*[c for c in x.columns if c.startswith(("p1_", "p2_"))])
    x = ft.difference_features(x)
    # Wins and rates are needed of the players asked for, against those that they are asked with and on what surface.
    both = pairs.select(F.inline(F.array(*(F.struct(F.col(f"player{i}").alias("player"), F.col(f"player{3 - i}").alias("opponent"), S.feature_surface(F.col("surface")).alias("surface")) for i in (1, 2))))).where("player is not null")
    met = written(st.totals(events.join(both.select("player", "opponent").distinct(), ["player", "opponent"], "left_semi"), "player", "opponent").select("player", "opponent", "wins"))
    rates = written(st.last_rates(events.join(both.select("player", "surface").distinct(), ["player", "surface"], "left_semi"), 10, "player", "surface", name="rate"))
    x = ft.match_preference(ft.head_to_head_from(ft.surface_from(ft.form_from(x, state), rates), met))
    return routed.predict(x).select("player1", "player2", F.col("asked").alias("surface"), "is_top", "predicted", "p_player1")
