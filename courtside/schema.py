"""Column types, vocabularies and feature lists."""

from __future__ import annotations

from pyspark.sql import types as T

_T = {"s": T.StringType(), "d": T.DoubleType(), "b": T.LongType()}
SIDE = [("name", "s"), ("hand", "s"), ("rank", "d"), ("ht", "d"), ("seed", "s"), ("age", "d")]
#: One row per match as a file holds it; dates are yyyymmdd text until typed.
MATCH_FILE = T.StructType([T.StructField("tourney_id", T.StringType()), T.StructField("tourney_date", T.StringType()), T.StructField("surface", T.StringType()), *(T.StructField(f"{side}_{c}", _T[t]) for c, t in SIDE for side in ("winner", "loser")), T.StructField("match_num", T.LongType())])
MATCH_COLUMNS = MATCH_FILE.fieldNames()

# Surfaces as player state keeps them (its order breaks ties), as features know them with their codes, the
# spellings that the feature normaliser accepts, and the values that stand for missing ones.
STATE_SURFACES = ["Hard", "Clay", "Grass", "Carpet", "Unknown"]
SURFACE_CODES = {"Clay": 0, "Grass": 1, "Hard": 2, "Unknown": 3}
SURFACE_SPELLINGS = {"Hard": "Hard", "hard": "Hard", "HARD": "Hard", "Clay": "Clay", "clay": "Clay", "CLAY": "Clay", "Grass": "Grass", "grass": "Grass", "GRASS": "Grass"}
UNRANKED, UNSEEDED, UNKNOWN = 999, -1, "Unknown"

# Model inputs in order; the categorical ones aren't scaled.
FEATURES = [
    "rank_diff", "log_rank_diff", "top_10_vs_not", "age_diff", "young_vs_old", "seed_diff", "seeded_vs_unseeded", "height_diff", "tall_vs_short",
    "player1_last_5_win_percentage", "player2_last_5_win_percentage", "player1_last_10_win_percentage", "player2_last_10_win_percentage",
    "player1_surface_last_10_win_percentage", "player2_surface_last_10_win_percentage", "player1_preferred_surface", "player2_preferred_surface",
    "player1_surface_match", "player2_surface_match", "surface_preference_diff", "head_to_head_wins_p1", "head_to_head_wins_p2", "surface", "surface_encoded",
]
CATEGORICAL = ["player1_preferred_surface", "player2_preferred_surface", "surface"]
NUMERIC = [f for f in FEATURES if f not in CATEGORICAL]
