"""Player state: the ordered fold of a player's matches, as aggregates (snapshot) and window frames (point in time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..schema import STATE_SURFACES, UNKNOWN
from . import fold
from .parts import TASK_ROWS, spread


def player_match_events(timeline: DataFrame) -> DataFrame:
    """Two rows per match, the winner's and the loser's, from one scan."""

    def side(me: str, other: str, won: int) -> Column:
        return F.struct(
            F.col(f"{me}_name").alias("player"), F.col(f"{other}_name").alias("opponent"), F.col(f"{me}_hand").alias("hand"), F.col(f"{other}_hand").alias("opp_hand"),
            F.col(f"{me}_rank").alias("rank"), F.col(f"{me}_ht").alias("ht"), F.col(f"{me}_seed").alias("seed"), F.col(f"{me}_age").alias("age"), F.lit(won).alias("won"),
        )

    keep = [c for c in ("rn", "split", "tourney_date") if c in timeline.columns]
    surface = F.coalesce("surface", F.lit(UNKNOWN)).alias("surface")
    return timeline.select(*keep, "match_num", "tourney_id", surface, F.inline(F.array(side("winner", "loser", 1), side("loser", "winner", 0))))


def as_of(events: DataFrame, date: str) -> DataFrame:
    """What was known on the morning of a date (yyyy-mm-dd): events of earlier dates."""
    return events.where(F.col("tourney_date") < F.to_date(F.lit(date)))


def totals(events: DataFrame, *by: str) -> DataFrame:
    """Matches, wins and their ratio by the given columns (player, player and surface, opponent, tournament)."""
    out = events.groupBy(*by).agg(F.count(F.lit(1)).alias("matches"), F.sum("won").cast("long").alias("wins"))
    return out.withColumn("win_pct", ratio(F.col("wins"), F.col("matches")))


def hand_counts() -> list[Column]:
    hands = (("R", "right"), ("L", "left"))
    matches = [F.count(F.when(F.col("opp_hand") == h, 1)).alias(f"matches_vs_{k}") for h, k in hands]
    return matches + [F.count(F.when((F.col("opp_hand") == h) & (F.col("won") == 1), 1)).alias(f"wins_vs_{k}") for h, k in hands]


def _hand_rates() -> dict[str, Column]:
    return {f"pct_vs_{k}": ratio(F.col(f"wins_vs_{k}"), F.col(f"matches_vs_{k}")) for k in ("right", "left")}


def versus_hands(events: DataFrame) -> DataFrame:
    return events.groupBy("player").agg(*hand_counts()).withColumns(_hand_rates())


def last_rates(events: DataFrame, n: int, *by: str, name: str) -> DataFrame:
    """Win rate over the last n matches by the given columns; Spark limits each group before the shuffle."""
    by = by or ("player",)
    recent = events.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rn")))).where(F.col("k") <= n)
    return recent.groupBy(*by).agg(F.avg("won").alias(name))


def streaks(events: DataFrame) -> DataFrame:
    """How many matches the current run of wins, or of losses, has."""
    return fold.form(events).select("player", "win_streak", "loss_streak")


def histories(events: DataFrame) -> DataFrame:
    """Each attribute's values in order, missing ones included. A player's whole career is one row: not for hot paths."""
    fields = ["rank", "ht", "hand", "seed", "age"]
    got = events.groupBy("player").agg(F.array_sort(F.collect_list(F.struct("rn", *fields))).alias("x"))
    return got.select("player", *(F.expr(f"transform(x, s -> s.{f})").alias(f"{f}s") for f in fields))


def _latest() -> list[Column]:
    return [F.max_by(c, "rn").alias(f"latest_{c}") for c in ("rank", "ht", "hand", "seed", "age")]


def latest(events: DataFrame) -> DataFrame:
    """Each attribute in the player's last match, missing if it was missing there."""
    return events.groupBy("player").agg(*_latest())


def surface_counts() -> list[Column]:
    m = [F.count(F.when(F.col("surface") == s, 1)).alias(f"matches_{s.lower()}") for s in STATE_SURFACES]
    return m + [F.count(F.when((F.col("surface") == s) & (F.col("won") == 1), 1)).alias(f"wins_{s.lower()}") for s in STATE_SURFACES]


def surface_grid(events: DataFrame) -> DataFrame:
    """One row per player: matches and wins on each of the five surfaces, 0 where never played."""
    return events.groupBy("player").agg(*surface_counts())


def preferred() -> Column:
    """The surface with the best win rate; the first of the five wins ties, and all of them at 0."""
    rates = [F.struct(ratio(F.col(f"wins_{s.lower()}"), F.col(f"matches_{s.lower()}")).alias("pct"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(STATE_SURFACES)]
    return F.array_max(F.array(*rates))["s"]


def surface_maps(events: DataFrame) -> DataFrame:
    """Matches and wins by surface as maps over all five."""
    grid = surface_grid(events)
    maps = {k: F.create_map(*(x for s in STATE_SURFACES for x in (F.lit(s), F.col(f"{k}_{s.lower()}")))).alias(f"surface_{k}") for k in ("matches", "wins")}
    return grid.select("player", *maps.values())


def check_surfaces(events: DataFrame) -> DataFrame:
    """events, or an error where a surface isn't one of the five."""
    ok = F.assert_true(F.col("surface").isin(STATE_SURFACES), "unknown surface in player state")
    return events.where(ok.isNull())


def player_state(events: DataFrame) -> DataFrame:
    """All scalars of a snapshot, one row per player, in two passes: one aggregate, combined before the shuffle, of what has
    no order, and one of slices of time that merge."""
    counted = events.groupBy("player").agg(F.count(F.lit(1)).alias("matches"), F.sum("won").cast("long").alias("wins"), *surface_counts(), *hand_counts(), *_latest())
    counted = counted.withColumns({"win_pct": ratio(F.col("wins"), F.col("matches")), "preferred_surface": preferred(), **_hand_rates()})
    return counted.join(fold.form(events), "player")


def player_profile(events: DataFrame, player: str) -> DataFrame:
    """A player's report; no row when the player never appears. The filter reaches the events."""
    s = player_state(events.where(F.col("player") == player))
    pct = [ratio(F.col(f"wins_{x}"), F.col(f"matches_{x}")).alias(f"pct_{x}") for x in ("hard", "clay", "grass")]
    return s.select("player", *pct, F.col("win_pct"), "last_5", "pct_vs_right", "pct_vs_left", F.coalesce((F.col("latest_rank") != 0) & (F.col("latest_rank") <= 10), F.lit(False)).alias("is_top_10"), "win_streak", "loss_streak", "preferred_surface")


def add_missing_players(state: DataFrame, names: DataFrame) -> DataFrame:
    """state with an empty row for each name that it lacks."""
    empty = names.select(F.col(names.columns[0]).alias("player")).where("player is not null").distinct().join(state, "player", "left_anti")
    zero = {c: F.lit(0).cast(t) for c, t in state.dtypes if c not in ("player", "preferred_surface") and not c.startswith("latest_")}
    if "preferred_surface" in state.columns:
        zero["preferred_surface"] = F.lit(STATE_SURFACES[0])
    return state.unionByName(empty.withColumns(zero), allowMissingColumns=True)


def running_totals(events: DataFrame) -> DataFrame:
    """State after each match: matches and wins so far, and both streaks."""
    return fold.running(events).select("player", "rn", "matches", "wins", "win_streak", "loss_streak")


def _frames(events: DataFrame, end: int, task_rows: int = TASK_ROWS, **more: Column) -> DataFrame:
    """events with what is known of a player in frames that end `end` rows from each match. All frames of one partitioning
    share a sort; the preferred surface comes from running counts of the same sort. A task sorts the matches of as many
    players as have about task_rows together. more: other columns of the same windows."""
    events = spread(events, "player", task_rows=task_rows)
    w = Window.partitionBy("player").orderBy("rn")
    upto = w.rowsBetween(Window.unboundedPreceding, end)
    cols = {
        "last_5": F.avg("won").over(w.rowsBetween(end - 4, end)),
        "last_10": F.avg("won").over(w.rowsBetween(end - 9, end)),
        "surface_last_10": F.avg("won").over(Window.partitionBy("player", "surface").orderBy("rn").rowsBetween(end - 9, end)),
        "h2h_wins": F.sum("won").over(Window.partitionBy("player", "opponent").orderBy("rn").rowsBetween(Window.unboundedPreceding, end)),
    }
    for s in STATE_SURFACES:
        cols[f"matches_{s.lower()}"] = F.count(F.when(F.col("surface") == s, 1)).over(upto)
        cols[f"wins_{s.lower()}"] = F.count(F.when((F.col("surface") == s) & (F.col("won") == 1), 1)).over(upto)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("last_5", "last_10", "surface_last_10")}
    return events.withColumns(cols | more).withColumn("preferred_surface", preferred()).withColumns({**zero, "h2h_wins": F.coalesce("h2h_wins", F.lit(0)).cast("long")})


def before_match(events: DataFrame, task_rows: int = TASK_ROWS, asked: Column | None = None) -> DataFrame:
    """What was known of a player before each match: frames end at the row before, so no result leaks into its features.
    asked: which of the events are returned; all are known."""
    x = _frames(events, -1, task_rows)
    return (x if asked is None else x.where(asked)).select("player", "rn", "match_num", "last_5", "last_10", "surface_last_10", "h2h_wins", "preferred_surface")


def after_match(events: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """What is known of a player after each match, with its date, opponent and surface, and whether it was the last of its
    date of the player (last_of_form), on that surface (last_of_surface), against that opponent (last_of_head_to_head)."""
    by = {"form": ["player"], "surface": ["player", "surface"], "head_to_head": ["player", "opponent"]}
    next_ = {f"last_of_{k}": ~F.lead("tourney_date").over(Window.partitionBy(*on).orderBy("rn")).eqNullSafe(F.col("tourney_date")) for k, on in by.items()}
    return _frames(events, 0, task_rows, **next_).select("player", "opponent", "surface", "tourney_date", "rn", "last_5", "last_10", "surface_last_10", "h2h_wins", "preferred_surface", *next_)
