"""Matches as unlabelled pairs, and the pairwise features of training and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import STATE_SURFACES
from ..sources.matches import written
from . import state as st
from .asof import as_of_join


def orient_pairs(matches: DataFrame, seed: int = 42) -> DataFrame:
    """Winner and loser become player1 and player2 by a keyed coin; result is 1 if player1 won, else 2."""
    x = matches.withColumn("swap", S.coin(F.col("match_num"), seed))
    pick = {}
    for c in ("name", "seed", "rank", "age", "ht", "hand"):
        to = "" if c == "name" else f"_{c}"
        pick[f"player1{to}"] = F.when(F.col("swap"), F.col(f"winner_{c}")).otherwise(F.col(f"loser_{c}"))
        pick[f"player2{to}"] = F.when(F.col("swap"), F.col(f"loser_{c}")).otherwise(F.col(f"winner_{c}"))
    return x.withColumns(pick).withColumn("result", F.when(F.col("swap"), 1).otherwise(2)).drop("swap")


def difference_features(pairs: DataFrame) -> DataFrame:
    """Features of the match row alone. Seeds become numbers; differences stay missing where a side is."""
    x = pairs.withColumns({"surface": S.feature_surface(F.col("surface")), **{f"player{i}_seed": S.lenient_double(F.col(f"player{i}_seed")) for i in (1, 2)}})
    c = lambda i, k: F.col(f"player{i}_{k}")
    rank_diff = c(1, "rank") - c(2, "rank")
    return x.withColumns(
        {
            "surface_encoded": S.surface_code(F.col("surface")),
            "rank_diff": rank_diff,
            "log_rank_diff": S.log_gap(rank_diff),
            "top_10_vs_not": S.top_10_vs_not(c(1, "rank"), c(2, "rank")),
            "age_diff": c(1, "age") - c(2, "age"),
            "young_vs_old": S.young_vs_old(c(1, "age"), c(2, "age")),
            "seed_diff": c(1, "seed") - c(2, "seed"),
            "seeded_vs_unseeded": S.seeded_vs_unseeded(c(1, "seed"), c(2, "seed")),
            "height_diff": c(1, "ht") - c(2, "ht"),
            "tall_vs_short": S.tall_vs_short(c(1, "ht"), c(2, "ht")),
            "same_hand": S.same_hand(c(1, "hand"), c(2, "hand")),
            "left_vs_right": S.left_vs_right(c(1, "hand"), c(2, "hand")),
        }
    )


def form_lookup(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Both players' form and preferred surface from a snapshot; unknown players have 0 and Hard."""
    return form_from(pairs, st.player_state(events))


def form_from(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """form_lookup from a state that is there already."""
    form = state.select("player", "last_5", "last_10", "preferred_surface")
    for i in (1, 2):
        side = form.toDF(f"player{i}", f"player{i}_last_5_win_percentage", f"player{i}_last_10_win_percentage", f"player{i}_preferred_surface")
        pairs = pairs.join(side, f"player{i}", "left").fillna(0.0, [f"player{i}_last_5_win_percentage", f"player{i}_last_10_win_percentage"]).fillna(STATE_SURFACES[0], [f"player{i}_preferred_surface"])
    return pairs


def surface_lookup(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Both players' rate over their last 10 matches on the match's surface, as features name it (a carpet match, which
    features call Unknown, so reads the history of matches without a surface); 0 if none."""
    return surface_from(pairs, st.last_rates(events, 10, "player", "surface", name="rate"))


def surface_from(pairs: DataFrame, form: DataFrame) -> DataFrame:
    """surface_lookup from rates (player, surface, rate) that are there already."""
    for i in (1, 2):
        side = form.toDF(f"player{i}", "surface", f"player{i}_surface_last_10_win_percentage")
        pairs = pairs.join(side, [f"player{i}", "surface"], "left").fillna(0.0, [f"player{i}_surface_last_10_win_percentage"])
    return pairs


def form_and_surface_lookup(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """form_lookup and surface_lookup, with one join a side: a player's rates on the surfaces (five at most) are a map."""
    rates = st.last_rates(events, 10, "player", "surface", name="rate").groupBy("player").agg(F.map_from_entries(F.collect_list(F.struct("surface", "rate"))).alias("rates"))
    state = st.player_state(events).select("player", "last_5", "last_10", "preferred_surface").join(rates, "player", "left")
    for i in (1, 2):
        names = {"last_5": f"player{i}_last_5_win_percentage", "last_10": f"player{i}_last_10_win_percentage", "preferred_surface": f"player{i}_preferred_surface"}
        pairs = pairs.join(state.withColumnsRenamed({"player": f"player{i}", "rates": "__rates", **names}), f"player{i}", "left")
        rate = f"player{i}_surface_last_10_win_percentage"
        pairs = pairs.withColumn(rate, F.col("__rates")[F.col("surface")]).drop("__rates")
        pairs = pairs.fillna(0.0, [names["last_5"], names["last_10"], rate]).fillna(STATE_SURFACES[0], [names["preferred_surface"]])
    return pairs


def head_to_head_lookup(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Wins of each player over the other; 0 if they never met. Both players' wins are one row, from the winner's event of
    each match, so pairs are joined once."""
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.array_sort(F.array(a, b)))
    won = events.where("won = 1").select("player", both("player", "opponent").alias("both")).where("both is not null").select(F.col("both")[0].alias("__low"), F.col("both")[1].alias("__high"), "player")
    met = won.groupBy("__low", "__high").agg(*(F.count(F.when(F.col("player") == F.col(k), 1)).alias(f"{k}_wins") for k in ("__low", "__high")))
    x = pairs.withColumns({"__low": both("player1", "player2")[0], "__high": both("player1", "player2")[1]}).join(met, ["__low", "__high"], "left")
    wins = {f"head_to_head_wins_p{i}": F.coalesce(F.when(F.col(f"player{i}") == F.col("__low"), F.col("__low_wins")).otherwise(F.col("__high_wins")), F.lit(0)) for i in (1, 2)}
    return x.withColumns(wins).drop(*met.columns)


def head_to_head_from(pairs: DataFrame, wins: DataFrame) -> DataFrame:
    """head_to_head_lookup from wins (player, opponent, wins) that are there already."""
    for me, other, i in (("player1", "player2", 1), ("player2", "player1", 2)):
        pairs = pairs.join(wins.toDF(me, other, f"head_to_head_wins_p{i}"), [me, other], "left").fillna(0, [f"head_to_head_wins_p{i}"])
    return pairs


#: What is looked up as of a date: keys, and the state's columns with their names as features ({p}: a side).
AS_OF = {
    "form": (["player"], {"last_5": "{p}_last_5_win_percentage", "last_10": "{p}_last_10_win_percentage", "preferred_surface": "{p}_preferred_surface"}),
    "surface": (["player", "surface"], {"surface_last_10": "{p}_surface_last_10_win_percentage"}),
    "head_to_head": (["player", "opponent"], {"h2h_wins": "head_to_head_wins_{k}"}),
}


def features_as_of(asked: DataFrame, events: DataFrame, id_col: str = "match_num", lookups: list[str] | None = None) -> DataFrame:
    """asked: (id, player1, player2, surface, date), ids distinct; any players, and any dates, whether anyone played then or
    not. Returns ids with both sides' form and preferred surface, rate on the surface and wins over the other (or what
    lookups names of these) as they were known before that date: 0 and Hard for who hadn't played by then."""
    after = written(st.after_match(events).withColumnRenamed("tourney_date", "date"))
    side = lambda i, j: F.struct(F.lit(i).alias("side"), F.col(f"player{i}").alias("player"), F.col(f"player{j}").alias("opponent"))
    x = asked.select(id_col, "date", "surface", F.inline(F.array(side(1, 2), side(2, 1))))
    out = []
    for lookup in lookups or AS_OF:
        keys, names = AS_OF[lookup]
        x = as_of_join(x, after.where(f"last_of_{lookup}").select(*keys, "date", *names), keys, "date", [*names])
        for c, name in names.items():
            value = F.coalesce(c, F.lit(STATE_SURFACES[0] if c == "preferred_surface" else 0).cast(x.schema[c].dataType))
            out += [F.max(F.when(F.col("side") == i, value)).alias(name.format(p=f"player{i}", k=f"p{i}")) for i in (1, 2)]
    return x.groupBy(id_col).agg(*out)


def match_preference(pairs: DataFrame) -> DataFrame:
    m = {f"player{i}_surface_match": F.col("surface") == F.col(f"player{i}_preferred_surface") for i in (1, 2)}
    diff = m["player1_surface_match"].cast("int") - m["player2_surface_match"].cast("int")
    return pairs.withColumns({**m, "surface_preference_diff": diff})


def pair_features(pairs: DataFrame, events: DataFrame, mode: str = "snapshot", asked: Column | None = None) -> DataFrame:
    """All features of oriented pairs. events: whose results the state knows. mode: `snapshot` reads the state after all
    of events; `point_in_time` reads it as it was before each match, which must be among events. asked: which events are those
    of pairs (all, if not given); the state knows the others too, but isn't looked up there."""
    x = pairs.withColumn("surface", S.feature_surface(F.col("surface")))
    if mode == "snapshot":
        x = head_to_head_lookup(form_and_surface_lookup(x, events), events)
    elif mode == "point_in_time":
        known = st.before_match(events, asked=asked).drop("rn")
        for i in (1, 2):
            side = known.toDF(f"player{i}", "match_num", f"player{i}_last_5_win_percentage", f"player{i}_last_10_win_percentage", f"player{i}_surface_last_10_win_percentage", f"head_to_head_wins_p{i}", f"player{i}_preferred_surface")
            x = x.join(side, [f"player{i}", "match_num"], "left")
    else:
        raise ValueError(f"mode is snapshot or point_in_time, not {mode!r}")
    return match_preference(difference_features(x))  # from the row alone, so not carried through the joins


def serving_pairs(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """(player1, player2, surface) with both players' latest state; a player that no event has is an error."""
    return side_by_side(pairs, st.player_state(events))


def side_by_side(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """serving_pairs from a state that is there already."""
    s = state.select("player", "latest_rank", "latest_age", "latest_seed", "latest_ht", "last_5", "last_10", "preferred_surface")
    x = pairs
    for i in (1, 2):
        x = x.join(s.toDF(f"player{i}", *(f"p{i}_{c}" for c in ("rank", "age", "seed", "ht", "last_5", "last_10", "preferred"))), f"player{i}", "left")
        x = x.withColumn(f"player{i}", F.when(F.col(f"p{i}_last_5").isNotNull(), F.col(f"player{i}")).otherwise(F.raise_error(F.concat(F.lit("unknown player "), F.coalesce(f"player{i}", F.lit("null")))).cast("string")))
    return x


def serving_features(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Serving features of (player1, player2, surface as text) by their own rules: flags look one way only, missing
    seeds count 999, and the preferred surface is compared as text."""
    x = serving_pairs(pairs, events)
    seed = [S.or_unranked(S.lenient_double(F.col(f"p{i}_seed"))) for i in (1, 2)]
    top = [S.is_top_10(F.col(f"p{i}_rank")) for i in (1, 2)]
    pref = [(F.col(f"p{i}_preferred") == F.col("surface")).cast("int") for i in (1, 2)]
    x = head_to_head_lookup(surface_lookup(x, events), events)
    return x.select(
        "player1", "player2",
        (F.col("p1_rank") - F.col("p2_rank")).alias("rank_diff"), F.log1p(F.abs(F.col("p1_rank") - F.col("p2_rank"))).alias("log_rank_diff"), (top[0] & ~top[1]).alias("top_10_vs_not"),
        (F.col("p1_age") - F.col("p2_age")).alias("age_diff"), S.flag(F.col("p1_age") < F.col("p2_age")).alias("young_vs_old"),
        (seed[0] - seed[1]).alias("seed_diff"), (F.col("p1_seed").isNotNull() & F.col("p2_seed").isNull()).alias("seeded_vs_unseeded"),
        (F.col("p1_ht") - F.col("p2_ht")).alias("height_diff"), S.flag(F.col("p1_ht") > F.col("p2_ht")).alias("tall_vs_short"),
        *(F.col(f"p{i}_last_{n}").alias(f"player{i}_last_{n}_win_percentage") for n in (5, 10) for i in (1, 2)),
        *(f"player{i}_surface_last_10_win_percentage" for i in (1, 2)),
        *(pref[i].alias(f"player{i + 1}_preferred_surface") for i in (0, 1)), *(pref[i].alias(f"player{i + 1}_surface_match") for i in (0, 1)),
        (pref[0] - pref[1]).alias("surface_preference_diff"), "head_to_head_wins_p1", "head_to_head_wins_p2",
        S.surface_code(F.col("surface")).alias("surface_encoded"), S.surface_code(F.col("surface")).alias("surface"),
    )


def either_side(pairs: DataFrame, player: str) -> DataFrame:
    return pairs.where((F.col("player1") == player) | (F.col("player2") == player))
