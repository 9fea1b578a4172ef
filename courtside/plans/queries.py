"""Registered queries: one for each operator, over matches derived from the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as ft
from ..operators import boosting, fold, importance, models, prep
from ..operators import state as st
from ..operators import timeline as tm
from ..operators.kept import KeptState
from ..schema import CATEGORICAL, FEATURES, MATCH_COLUMNS, STATE_SURFACES, SURFACE_CODES, UNRANKED
from ..sources import matches as src
from .oracles import FEATURE_COLUMNS, LOOKED_UP, ROUNDED, WHOLE_SPLIT

Query = Callable[[SparkSession, str], DataFrame]
#: Of p6_min_matches, to be selective there; and the reference's own limit, which keeps every row of a split here.
MIN_MATCHES = 75
REFERENCE_MIN_MATCHES = 10
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def named(name: str, f: Query) -> None:
    _QUERIES[name] = f


class Base:
    """The frames that queries start from. The timeline and the full features are computed once and written to the shared
    folder, the timeline by split; the rest is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str, min_matches: int = REFERENCE_MIN_MATCHES):
        self.spark, self.sf_dir = spark, sf_dir
        self.min_matches = min_matches
        self.matches = src.derived_matches(spark, sf_dir)

    @cached_property
    def timeline(self) -> DataFrame:
        keys = src.written(src.derived_keys(self.spark, self.sf_dir))  # read several times to be put in order; all else is told from it after that
        timeline = src.written(src.described(tm.with_splits(keys)), "split")
        src.discard(keys)
        return timeline

    @property
    def next(self) -> DataFrame:
        return self.timeline.where("split = 'next'")

    @property
    def events(self) -> DataFrame:
        return st.player_match_events(self.timeline)

    @property
    def known(self) -> DataFrame:
        """Events that the snapshot has seen: all but the final split's."""
        return st.player_match_events(self.timeline.where("split <> 'final'"))

    @property
    def active(self) -> DataFrame:
        return tm.filter_min_matches(self.next, self.min_matches)

    @property
    def pairs(self) -> DataFrame:
        return ft.orient_pairs(self.active)

    @property
    def diffs(self) -> DataFrame:
        return ft.difference_features(self.pairs)

    @property
    def full(self) -> DataFrame:
        return ft.pair_features(self.pairs, self.known)

    @cached_property
    def filled(self) -> DataFrame:
        full = self.full  # player1 and player2 have all that is winner's and loser's: written once, not twice
        return prep.fill_missing(src.written(full.drop(*(c for c in full.columns if c.startswith(("winner_", "loser_"))))))


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def picked(columns: list[str]):
    return [r6(c) if c in ROUNDED else F.col(c) for c in columns]


def simple(name: str, f: Callable[[Base], DataFrame]) -> None:
    """Registers a query that only needs the base frames; those of WHOLE_SPLIT keep their second name."""
    for n in (name, f"{name}_whole") if name in WHOLE_SPLIT else (name,):
        named(n, lambda spark, sf_dir: f(Base(spark, sf_dir)))


PLAYERS = ["match_num", "winner_name", "loser_name"]
MED = [*prep.MEDIAN_FILLED]


# -- scans and sinks
@query
def s1_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{src.scratch(spark)}/csv-{uuid.uuid4().hex}"
    return src.read_csv(spark, src.write_csv(src.derived_matches(spark, sf_dir), path))


@query
def s3_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write in ignore mode leaves the first as it is."""
    path = f"{src.scratch(spark)}/csv-{uuid.uuid4().hex}"
    m = src.derived_matches(spark, sf_dir)
    src.write_csv(m, path)
    src.write_csv(m.limit(0), path)
    return src.read_csv(spark, path)


@query
def s5_season_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = src.write_seasons(src.derived_matches(spark, sf_dir), f"{src.scratch(spark)}/seasons-{uuid.uuid4().hex}")
    return src.read_seasons(spark, path, 1993, 1996).groupBy("source_year").agg(F.count(F.lit(1)).alias("n"))


@query
def s5_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons whose files have three headers: all columns, another order without surfaces, and one with a column more."""
    m = src.derived_matches(spark, sf_dir).withColumns({"season": F.year("tourney_date"), "tourney_date": F.date_format("tourney_date", "yyyyMMdd")})
    path = f"{src.scratch(spark)}/mixed-{uuid.uuid4().hex}"
    swapped = ["loser_name", "match_num", "winner_name", "tourney_date", "tourney_id", "loser_rank", "winner_rank"]
    for years, columns in ((F.col("season") < 1994, MATCH_COLUMNS), (F.col("season").between(1994, 1995), swapped), (F.col("season") > 1995, ["minutes", *reversed(MATCH_COLUMNS)])):
        m.where(years).withColumn("minutes", F.col("match_num") % 300).select(*columns, "season").write.mode("append").partitionBy("season").option("header", True).csv(path)
    return src.read_seasons(spark, path, 1993, 1997, others=True).select("match_num", "tourney_date", "surface", "winner_name", "loser_name", "winner_rank", "minutes", "source_year")


@query
def s6_union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = src.derived_matches(spark, sf_dir)
    return src.union_by_name(m.where("match_num % 2 = 0").select(PLAYERS), m.where("match_num % 2 <> 0").select(*PLAYERS[:2]))


@query
def s7_inline_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(SURFACE_CODES.items()), "surface string, code int")


@query
def s4_ensure_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested folder that is missing, made, and then left alone."""
    path = f"{src.scratch(spark)}/made-{uuid.uuid4().hex}/inner"
    steps = [("there before", src.exists(spark, path)), ("made", src.ensure_folder(spark, path)), ("there after", src.exists(spark, path)), ("made again", src.ensure_folder(spark, path))]
    return spark.createDataFrame(steps, "step string, answer boolean")


@query
def s8_output_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.feature_values(spark, [i / 8 for i in range(len(FEATURES))])


_PROFILE = ["pct_hard", "pct_clay", "pct_grass", "win_pct", "last_5", "pct_vs_right", "pct_vs_left"]
simple("s9_profile_report", lambda b: st.player_profile(b.known, "P7").select("player", *(r6(c) for c in _PROFILE), "is_top_10", "win_streak", "loss_streak", "preferred_surface"))

# -- projections and filters
simple("p1_add_columns", lambda b: b.matches.withColumns({"rank_diff": F.col("winner_rank") - F.col("loser_rank"), "surface": F.coalesce("surface", F.lit("Unknown"))}).select("match_num", "rank_diff", "surface"))
simple("p2_side_swap", lambda b: b.pairs.select("match_num", "player1", "player2", *(f"player{i}_{c}" for c in ("seed", "rank", "age", "ht", "hand") for i in (1, 2))))
simple("p3_result_label", lambda b: b.pairs.select("match_num", "result"))
simple("p4_mask_filter", lambda b: b.matches.where(F.col("winner_rank") <= 20).select(PLAYERS))
simple("p5_membership_filter", lambda b: tm.filter_min_matches(b.next, 80).unionByName(_members(b.timeline.where("split <> 'next'"), tm.appearances(b.next))).select(PLAYERS))
simple("p6_min_matches", lambda b: tm.filter_min_matches(b.next, MIN_MATCHES).select(PLAYERS))
simple("p7_null_tests", lambda b: b.matches.agg(F.count(F.when(F.col("surface").isNull(), 1)).alias("no_surface"), F.count("winner_seed").alias("seeded")))
simple("p8_null_safe_logic", lambda b: b.matches.select("match_num", S.flag((F.col("winner_rank") <= 10) & (F.col("loser_rank") > 10)).alias("favourite_won")))
simple("p9_projection", lambda b: b.diffs.select(*picked(["match_num", "rank_diff", "log_rank_diff", "top_10_vs_not", "result"])))
simple("p10_text_columns", lambda b: b.spark.createDataFrame([(c,) for c in prep.text_columns(b.matches)], "column string"))
simple("p11_schema", lambda b: b.spark.createDataFrame([(i, c) for i, c in enumerate(b.matches.columns)], "position int, column string"))
simple("p12_row_slice", lambda b: tm.positions(b.timeline, 100, 250).select("match_num", "rn"))
simple("p13_point_lookup", lambda b: st.totals(b.known, "player").where("player = 'P7'").select("player", "matches", "wins"))
simple("p14_either_side", lambda b: ft.either_side(b.pairs, "P7").unionByName(ft.either_side(b.pairs, "P8")).select("match_num", "player1", "player2").distinct())
simple("p15_segment_routing", lambda b: models.segments(b.filled)[0].withColumn("is_top", F.lit(True)).unionByName(models.segments(b.filled)[1].withColumn("is_top", F.lit(False))).select("match_num", "is_top"))
simple("p17_list_or_unknown", lambda b: b.matches.select("match_num", S.known_or_unknown(F.col("surface"), ["Hard", "Clay", "Grass"]).alias("surface")))


def _members(matches: DataFrame, counts: DataFrame, least: int = 80) -> DataFrame:
    keys = counts.where(F.col("n") >= least).select("player")
    for c in ("winner_name", "loser_name"):
        matches = matches.join(keys, F.col(c) == F.col("player"), "left_semi")
    return matches


# -- joins
simple("j1_full_outer_counts", lambda b: tm.appearances_by_sides(b.next))
simple("j1_single_aggregate_counts", lambda b: tm.appearances(b.next))
simple("j2_form_lookup", lambda b: ft.form_lookup(b.diffs, b.known).select("match_num", *(r6(f"player{i}_last_{n}_win_percentage") for n in (5, 10) for i in (1, 2)), "player1_preferred_surface", "player2_preferred_surface"))
simple("j3_head_to_head_lookup", lambda b: ft.head_to_head_lookup(b.diffs, b.known).select("match_num", "head_to_head_wins_p1", "head_to_head_wins_p2"))
simple("j4_surface_form_lookup", lambda b: ft.surface_lookup(b.diffs, b.known).select("match_num", *(r6(f"player{i}_surface_last_10_win_percentage") for i in (1, 2))))


def _as_of(b: Base, lookup: str) -> DataFrame:
    """The next split's pairs, each asked for on a date up to 350 days from its own."""
    pairs = ft.difference_features(ft.orient_pairs(b.next)).select("match_num", "player1", "player2", "surface", F.expr("date_add(tourney_date, cast(match_num % 701 - 350 as int))").alias("date"))
    return ft.features_as_of(pairs, b.events, lookups=[lookup])


simple("j2_as_of_form", lambda b: _as_of(b, "form").select("match_num", *(r6(f"player{i}_last_{n}_win_percentage") for n in (5, 10) for i in (1, 2)), "player1_preferred_surface", "player2_preferred_surface"))
simple("j3_as_of_head_to_head", lambda b: _as_of(b, "head_to_head"))
simple("j4_as_of_surface_form", lambda b: _as_of(b, "surface").select("match_num", *(r6(f"player{i}_surface_last_10_win_percentage") for i in (1, 2))))
simple("j5_semi_join", lambda b: b.timeline.join(tm.appearances(b.next).where("n >= 80"), F.col("winner_name") == F.col("player"), "left_semi").select(PLAYERS))
simple("j6_unseen_values", lambda b: prep.unseen(b.matches.where("surface is not null"), "surface", b.spark.createDataFrame([("Clay", 0), ("Grass", 1), ("Hard", 2)], "value string, code int")))
simple("j7_value_mapping", lambda b: b.matches.select("match_num", S.surface_code(F.col("surface")).alias("code")))
simple("j8_median_broadcast", lambda b: prep.impute(b.pairs, prep.medians(b.pairs, ["player1_age"])).select("match_num", r6("player1_age")))
simple("j9_upsert_players", lambda b: st.add_missing_players(st.totals(b.known, "player"), b.spark.createDataFrame([("P7",), ("Nobody",)], "player string")).select("player", "matches", "wins"))
simple("j10_encoder_apply", lambda b: prep.encode(b.matches, "winner_hand", prep.vocabulary(b.matches, "winner_hand"), "code").select("match_num", F.col("code").cast("long").alias("code")))
simple("j11_serving_pair", lambda b: ft.serving_pairs(b.spark.createDataFrame([("P7", "P8", "Clay")], "player1 string, player2 string, surface string"), b.known).select("player1", "player2", "p1_rank", "p2_rank"))

# -- aggregates
def _kept(b: Base, buckets: int = 16) -> KeptState:
    """The state up to the final split, kept in three steps: the first split, and the next one in two."""
    kept = KeptState(b.spark, f"{src.scratch(b.spark)}/kept-{uuid.uuid4().hex}", buckets)
    kept.merge(st.player_match_events(b.timeline.where("split = 'initial'")))
    kept.merge(st.player_match_events(b.next.where("rn < n_matches * 5 div 8")))
    kept.merge(b.known)  # what was seen before is passed over
    return kept


simple("p13_point_lookup_kept", lambda b: _kept(b).lookup("P7").select("player", "matches", "wins"))
simple("j11_serving_pair_kept", lambda b: ft.side_by_side(b.spark.createDataFrame([("P7", "P8", "Clay")], "player1 string, player2 string, surface string"), _kept(b).lookup("P7", "P8")).select("player1", "player2", "p1_rank", "p2_rank"))
simple("x_state_kept", lambda b: _kept(b).all().select("player", *(r6(c) if c in ("win_pct", "last_5", "last_10") else _c(c) for c in STATE)))


def _last(n: int):
    return Window.partitionBy("player").orderBy("rn").rowsBetween(1 - n, 0)


simple("g0_events", lambda b: b.events.select("rn", "match_num", "player", "opponent", "hand", "opp_hand", "rank", "ht", "seed", "age", "surface", "tourney_id", "won"))
simple("g1_player_totals", lambda b: st.totals(b.known, "player").select("player", "matches", "wins", r6("win_pct")))
simple("g2_surface_totals", lambda b: st.totals(b.known, "player", "surface").drop("win_pct"))
simple("g2_surface_map", lambda b: st.surface_maps(b.known).select("player", F.explode("surface_matches").alias("surface", "matches"), F.col("surface_wins")).select("player", "surface", "matches", S.at_key(F.col("surface_wins"), F.col("surface"), F.lit(0)).cast("long").alias("wins")))
simple("g3_head_to_head", lambda b: st.totals(b.known, "player", "opponent").drop("win_pct"))
simple("g4_versus_hands", lambda b: st.versus_hands(b.known).drop("pct_vs_right", "pct_vs_left"))
simple("g5_tournaments", lambda b: st.totals(b.known, "player", "tourney_id").drop("win_pct"))
simple("g6_histories", lambda b: st.histories(b.known).select("player", F.posexplode(F.arrays_zip("ranks", "hts", "hands", "seeds", "ages")).alias("i", "x")).select("player", F.col("i").cast("long").alias("i"), F.col("x.ranks").alias("rank"), F.col("x.hts").alias("ht"), F.col("x.hands").alias("hand"), F.col("x.seeds").alias("seed"), F.col("x.ages").alias("age")))
simple("g7_latest", lambda b: st.latest(b.known))
simple("g8_win_pct", lambda b: st.totals(b.known, "player").select("player", r6("win_pct")))
simple("g9_surface_pct", lambda b: st.surface_grid(b.known).select("player", F.inline(F.array(*(F.struct(F.lit(s).alias("surface"), F.round(S.ratio(F.col(f"wins_{s.lower()}"), F.col(f"matches_{s.lower()}")), 6).alias("pct")) for s in STATE_SURFACES)))))
simple("g10_hand_pct", lambda b: st.versus_hands(b.known).select("player", r6("pct_vs_right"), r6("pct_vs_left")))
simple("g11_tournament_pct", lambda b: st.totals(b.known, "player", "tourney_id").select("player", "tourney_id", r6("win_pct", "pct")))
simple("g12_preferred_surface", lambda b: st.surface_grid(b.known).select("player", st.preferred().alias("preferred_surface")))
simple("g13_value_counts", lambda b: b.matches.where("surface is not null").groupBy("surface").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "surface"))
simple("g14_median", lambda b: prep.medians(b.matches, ["winner_rank", "winner_age"]).select(r6("winner_rank"), r6("winner_age")))
simple("g15_mean_std", lambda b: prep.scale_parameters(b.matches, ["winner_rank"]).select(r6("mean"), r6("std")))
simple("g16_distinct", lambda b: b.matches.select("surface").distinct())
simple("g17_count", lambda b: b.matches.agg(F.count(F.lit(1)).alias("n")))
for _name in ("g18_window_mean", "w1_last_n"):
    simple(_name, lambda b: st.last_rates(b.known, 5, name="last_5").join(st.last_rates(b.known, 10, name="last_10"), "player").select("player", r6("last_5"), r6("last_10")))
simple("g18_window_sums", lambda b: b.events.select("player", "rn", F.sum("won").over(_last(5)).cast("long").alias("won_5"), F.count("rank").over(_last(10)).alias("ranked_10")))
simple("g19_metrics", lambda b: models.evaluate(b.pairs.withColumn("predicted", F.when(F.coalesce("player1_rank", F.lit(999)) <= F.coalesce("player2_rank", F.lit(999)), 1).otherwise(2))).select(*(r6(c) for c in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1"))))

# -- windows
simple("w1_running_last_n", lambda b: fold.running(b.events).select("player", "rn", r6("last_5"), r6("last_10")))
simple("w2_surface_last_10", lambda b: st.last_rates(b.known, 10, "player", "surface", name="rate").select("player", "surface", r6("rate")))
simple("w3_streaks", lambda b: st.streaks(b.known))
simple("w4_running_totals", lambda b: st.running_totals(b.events))
for _name in ("w5_ordinal", "o2_index_reset"):
    simple(_name, lambda b: tm.ordered(b.matches).select("match_num", "rn"))
simple("o2_index_reset_split", lambda b: tm.ordered(b.next.drop("rn", "n_matches")).select("match_num", "rn", F.col("n_matches").alias("n")))
simple("w6_category_code", lambda b: prep.encode(b.matches, "winner_name", prep.vocabulary(b.matches, "winner_name"), "code").select("match_num", "code"))

# -- order and limits
simple("o1_sort_by_date", lambda b: b.matches.orderBy("tourney_date", "match_num").select("match_num", "tourney_date"))
simple("o3_splits", lambda b: b.timeline.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn")))
simple("o4_sort_desc", lambda b: st.totals(b.known, "player").select("player", "wins").orderBy(F.desc("wins"), "player"))
simple("o5_top_k", lambda b: st.totals(b.known, "player").select("player", "wins").orderBy(F.desc("wins"), "player").limit(10))
simple("o6_holdout", lambda b: tm.holdout(b.pairs).select("match_num", "is_test"))
simple("o7_resplit", lambda b: b.timeline.where("split <> 'initial'").groupBy("split").agg(F.count(F.lit(1)).alias("n")))

# -- set operations
simple("u1_union_all", lambda b: src.union_by_name(b.matches.select("match_num", F.col("winner_name").alias("player"), F.col("loser_name").alias("other")), b.matches.select("match_num", F.col("loser_name").alias("player"))))
simple("u2_union_distinct", lambda b: b.matches.select(F.col("winner_name").alias("player")).union(b.matches.select("loser_name")).distinct())
simple("u3_except", lambda b: b.matches.select("surface").where("surface is not null").subtract(b.spark.createDataFrame([("Hard",), ("Clay",), ("Grass",)], "surface string")))
simple("u4_vocabulary_extension", lambda b: b.matches.select(F.coalesce("surface", F.lit("Unknown")).alias("surface")).union(b.spark.createDataFrame([("Unknown",)], "surface string")).distinct())

# -- scalar functions
_c = F.col
simple("f1_parse_date", lambda b: b.matches.select("match_num", S.to_date_strict(F.date_format("tourney_date", "yyyyMMdd")).alias("tourney_date")))
simple("f2_differences", lambda b: b.diffs.select("match_num", "rank_diff", "age_diff", "seed_diff", "height_diff"))
simple("f3_log_gap", lambda b: b.diffs.select("match_num", r6("log_rank_diff")))
simple("f4_lenient_number", lambda b: b.matches.select("match_num", S.lenient_double(_c("winner_seed")).alias("seed")))
simple("f5_constant_fill", lambda b: b.filled.select("match_num", *(f"player{i}_{c}" for c in ("hand", "rank", "seed") for i in (1, 2)), "surface_encoded"))
simple("f6_median_fill", lambda b: b.filled.select("match_num", *(r6(c) for c in MED)))
_SPELT = "case match_num % 4 when 0 then upper(surface) when 1 then lower(surface) when 2 then surface else concat(lower(substring(surface, 1, 1)), upper(substring(surface, 2))) end as raw"
simple("f7_surface_normaliser", lambda b: b.matches.selectExpr("match_num", _SPELT).withColumn("surface", S.feature_surface(_c("raw"))))
simple("f8_surface_codes", lambda b: b.matches.select("match_num", (_c("match_num") % 6).cast("int").alias("code")).withColumn("surface", S.surface_of_code(_c("code"))))
simple("f9_casts", lambda b: b.pairs.select("match_num", (_c("player1_rank") <= 10).cast("int").alias("top"), S.text_or_nan(_c("player1_hand")).alias("hand")))
for _name, _cols in (("f10_rank_band", ["top_10_vs_not"]), ("f11_age_band", ["young_vs_old"]), ("f12_seed_xor", ["seeded_vs_unseeded"]), ("f13_height_band", ["tall_vs_short"]), ("f14_hands", ["same_hand", "left_vs_right"])):
    simple(_name, lambda b, cols=_cols: b.diffs.select("match_num", *cols))
simple("f15_surface_match", lambda b: ft.match_preference(ft.form_lookup(b.diffs, b.known)).select("match_num", "player1_surface_match", "player2_surface_match", "surface_preference_diff"))
simple("f16_is_top_10", lambda b: b.matches.select("match_num", S.is_top_10(_c("winner_rank")).alias("is_top_10")))
simple("f17_list_tail", lambda b: b.known.groupBy("player").agg(F.array_sort(F.collect_list(F.struct("rn", "won"))).alias("h")).select("player", S.last_n(_c("h"), 5).alias("h")).select("player", F.size("h").cast("long").alias("n"), F.expr("aggregate(h, 0L, (a, x) -> a + x.won)").alias("wins")))
simple("f18_map_default", lambda b: st.surface_maps(b.known).select("player", S.at_key(_c("surface_wins"), F.lit("Hard"), F.lit(0)).cast("long").alias("wins_hard"), S.at_key(_c("surface_wins"), F.lit("Ice"), F.lit(0)).cast("long").alias("wins_ice")))
for _name in ("f19_two_decimals", "f19_two_decimals_whole"):
    simple(_name, lambda b: st.totals(b.known, "player").select("player", S.shown(_c("win_pct")).cast("double").alias("shown")))
simple("f20_seeded_coin", lambda b: b.active.select("match_num", S.coin(_c("match_num"), 42).alias("swap")))
simple("f21_or_unranked", lambda b: b.matches.select("match_num", S.or_unranked(S.lenient_double(_c("winner_seed"))).alias("seed")))
simple("f23_required", lambda b: b.matches.select("match_num", S.required(_c("winner_name"), "a match without a winner").alias("winner_name")))
_SCALED = ["rank_diff", "age_diff", "player1_last_10_win_percentage"]
for _name in ("f22_z_score", "m3_standard_scaler"):
    simple(_name, lambda b: prep.scale(b.filled, _SCALED).select("match_num", *(r6(c) for c in _SCALED)))

simple("m3_scaler_parameters", lambda b: prep.scale_parameters(b.diffs, ["rank_diff", "player2_age"]).select("feature", r6("mean"), r6("std")))

# -- encoders, imputers, models
simple("m1_label_encoder", lambda b: prep.vocabulary(b.pairs, "player1_hand"))
simple("m2_median_imputer", lambda b: prep.impute(b.timeline.where("split = 'final'"), prep.medians(b.next, ["winner_rank", "winner_ht"])).select("match_num", r6("winner_rank"), r6("winner_ht")))
simple("m8_numeric_coercion", lambda b: prep.numeric_features(b.matches, ["winner_seed", "loser_seed", "winner_rank"]).select("match_num", "winner_seed", "loser_seed", "winner_rank"))


def _neighbours(b: Base) -> DataFrame:
    """Players whose numbers follow each other, on clay."""
    p = b.known.select("player").distinct()
    k = F.col("player").substr(2, 20).cast("int")
    return p.select(_c("player").alias("player1"), (k + 1).alias("k")).join(p.select(_c("player").alias("player2"), k.alias("k")), "k").select("player1", "player2", F.lit("Clay").alias("surface"))


simple("m6_metrics", lambda b: models.evaluate(b.matches.select(S.known_or_unknown(_c("surface")).alias("surface"), (_c("match_num") % 3).alias("result"), ((_c("match_num") * 7 + F.length("winner_name")) % 3).alias("predicted")), by=["surface"]).select("surface", *(r6(c) for c in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1"))))
simple("m9_serving_features", lambda b: ft.serving_features(_neighbours(b), b.known).select("player1", "player2", *(r6(c) if c in ROUNDED else _c(c) for c in FEATURES)))
simple("m11_player_profile", lambda b: st.player_profile(b.known, "P7").select("player", r6("pct_hard"), r6("pct_clay"), r6("pct_grass"), r6("win_pct"), r6("last_5"), "win_streak", "loss_streak", "preferred_surface"))


def training_rows(b: Base, mode: str = "point_in_time") -> DataFrame:
    """Pair features of the next and final splits, from what was known before each match, with is_top; not filled. Both
    splits keep only players active in them."""
    active = tm.filter_min_matches(b.next, REFERENCE_MIN_MATCHES).unionByName(tm.filter_min_matches(b.timeline.where("split = 'final'"), REFERENCE_MIN_MATCHES))
    pairs = ft.orient_pairs(active)
    sides = [c for c in pairs.columns if c.startswith(("winner_", "loser_"))]  # player1 and player2 have all that is theirs
    rows = ft.pair_features(pairs.drop(*sides), b.events, mode, F.col("split") != "initial")
    ranks = {f"player{i}_rank": F.coalesce(f"player{i}_rank", F.lit(float(UNRANKED))) for i in (1, 2)}
    return src.written(rows.withColumns(ranks).withColumn("is_top", models.is_top_segment()))


@query
def m4_train_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both segments' metrics on a fifth of the next split (held out by hash) and on the final split (held out in time).
    Medians and scales are those of the rows that train."""
    b = Base(spark, sf_dir)
    rows = training_rows(b)
    next_ = tm.holdout(rows.where("split = 'next'"), by=["is_top"])
    routed = models.train(next_.where("not is_test"))
    test = next_.where("is_test").select(*rows.columns, F.lit("holdout").alias("part")).unionByName(rows.where("split = 'final'").withColumn("part", F.lit("final")))
    return models.evaluate(routed.predict(test), by=["part", "is_top"])


def unfilled(b: Base) -> DataFrame:
    """training_rows with all features as numbers, missing ones left missing, and label (1 if player1 won)."""
    rows = training_rows(b)
    codes = {c: S.surface_code(F.col(c)) for c in CATEGORICAL}
    return rows.withColumns(codes).withColumns({c: F.col(c).cast("double") for c in FEATURES}).withColumn("label", (F.col("result") == 1).cast("int"))


#: What the queries of boosted histograms train: as many trees as m4_train_evaluate.
BOOSTED = {"iterations": 20, "depth": 5}


@query
def m4_histogram_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As m4_train_evaluate, by boosting on histograms, which needs neither filling nor scaling."""
    rows = unfilled(Base(spark, sf_dir))
    next_ = tm.holdout(rows.where("split = 'next'"), by=["is_top"])
    model = boosting.train(next_.where("not is_test"), FEATURES, "label", "is_top", **BOOSTED)
    test = next_.where("is_test").select(*rows.columns, F.lit("holdout").alias("part")).unionByName(rows.where("split = 'final'").withColumn("part", F.lit("final")))
    return models.evaluate(test.withColumn("predicted", F.when(model.probability(F.col("is_top")) > 0.5, 1).otherwise(2)), by=["part", "is_top"])


@query
def m4_first_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's best first split by each feature: its gain, the largest value that goes left, and where missing ones
    go. A bin for each value."""
    rows = unfilled(Base(spark, sf_dir)).where("split = 'next'")
    return boosting.first_splits(rows, FEATURES, "label", "is_top").select("is_top", "feature", r6("gain"), "upto", "missing_left", "n_left")


@query
def m5_histogram_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosted models' predictions of the final split, learned from the next one."""
    rows = unfilled(Base(spark, sf_dir))
    model = boosting.train(rows.where("split = 'next'"), FEATURES, "label", "is_top", **BOOSTED)
    scored = rows.where("split = 'final'").withColumn("p_player1", model.probability(F.col("is_top")))
    return scored.select("match_num", "is_top", "result", F.when(F.col("p_player1") > 0.5, 1).otherwise(2).alias("predicted"), "p_player1")


@query
def m7_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the boosted models lose on the final split when a feature is shuffled: the ten most important ones of each."""
    rows = unfilled(Base(spark, sf_dir))
    model = boosting.train(rows.where("split = 'next'"), FEATURES, "label", "is_top", **BOOSTED)
    right = lambda others: F.transform(model.probabilities(F.col("is_top"), others), lambda p: (p > 0.5) == (F.col("label") == 1))
    final = rows.where("split = 'final'").select("match_num", "is_top", "label", *FEATURES)
    found = importance.permutation_importance(final, FEATURES, None, "match_num", by=["is_top"], correct_each=right)
    place = F.row_number().over(Window.partitionBy("is_top").orderBy(F.desc("importance"), "feature"))
    return found.withColumn("place", place).where("place <= 10")


_RULE = ["rank_diff", "age_diff", "height_diff"]


def _by_rule(c: dict) -> Column:
    """Whether a fixed score, in place of a model, names the winner; what is missing counts 0."""
    score = F.coalesce(-c["rank_diff"], F.lit(0)) + 3 * F.coalesce(-c["age_diff"], F.lit(0)) + F.coalesce(c["height_diff"], F.lit(0))
    return (score > 0) == (F.col("result") == 1)


simple("m7_permuted_accuracy", lambda b: importance.permutation_importance(ft.difference_features(ft.orient_pairs(b.next)), _RULE, _by_rule, "match_num", by=["surface"], digits=1).select("surface", "feature", r6("accuracy"), r6("permuted_accuracy"), r6("importance")))


@query
def m5_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(Base(spark, sf_dir))
    routed = models.train(rows.where("split = 'next'"))
    return routed.predict(rows.where("split = 'final'")).select("match_num", "is_top", "predicted", "p_player1")


@query
def m7_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = models.train(training_rows(Base(spark, sf_dir)).where("split = 'next'"))
    parts = [models.top_importances(models.importances(spark, m)).withColumn("model", F.lit(k)) for k, m in (("top", routed.top), ("other", routed.other))]
    return parts[0].unionByName(parts[1])


@query
def m10_predict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .serving import predict_matches

    b = Base(spark, sf_dir)
    routed = models.train(training_rows(b).where("split = 'next'"))
    return predict_matches(_neighbours(b), b.events, routed)


# -- whole frames
STATE = ["matches", "wins", "win_pct", "last_5", "last_10", "win_streak", "loss_streak", "preferred_surface", "matches_vs_right", "wins_vs_right", "matches_vs_left", "wins_vs_left", "latest_rank", "latest_ht", "latest_hand", "latest_seed", "latest_age"]
simple("x_state_snapshot", lambda b: st.player_state(b.known).select("player", *(r6(c) if c in ("win_pct", "last_5", "last_10") else _c(c) for c in STATE)))
simple("x_pair_features_snapshot", lambda b: b.full.select(*picked([*FEATURE_COLUMNS, *LOOKED_UP])))
simple("x_filled_features", lambda b: b.filled.select(*picked([*FEATURE_COLUMNS, *LOOKED_UP, "player1_rank", "player2_rank", "player1_seed", "player1_hand", "player1_age", "player2_ht"])))
simple("e1_before_match", lambda b: st.before_match(b.events).select("player", "rn", r6("last_5"), r6("last_10"), r6("surface_last_10"), "h2h_wins", "preferred_surface"))
simple("e1_pair_features_point_in_time", lambda b: ft.pair_features(b.pairs, b.events, "point_in_time").select(*picked([*FEATURE_COLUMNS, *LOOKED_UP])))


STREAMED = ["matches", "wins", "last_5", "last_10", "win_streak", "loss_streak", "preferred_surface", "matches_vs_right", "wins_vs_right", "matches_vs_left", "wins_vs_left", "latest_rank", "latest_ht", "latest_hand", "latest_seed", "latest_age"]


def _ordered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What matches follow from, in order of time: all else is told from it as it arrives."""
    keys = src.written(src.derived_keys(spark, sf_dir))
    ordered = src.written(tm.ordered(keys))
    src.discard(keys)
    return ordered


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.described(_ordered_keys(spark, sf_dir))


@query
def e2_streaming_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each player, of a stream of the matches that arrives in four steps of time."""
    from ..streaming.run import final_state

    return final_state(spark, _arriving(spark, sf_dir)).select("player", *(r6(c) if c in ("last_5", "last_10") else _c(c) for c in STREAMED))


@query
def e2_streaming_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each player from a stream in which matches come up to two months late, a fifth of them twice, and
    last of all one match of nobody, years later, which moves the watermark on."""
    from ..streaming.late import late_streaming_state
    from ..streaming.run import emitted, last

    t = _ordered_keys(spark, sf_dir)
    bounds = t.agg(F.min("tourney_date").alias("first"), F.max("tourney_date").alias("last"))
    comes = F.datediff(F.expr("date_add(tourney_date, cast(match_num * 37 % 60 as int))"), F.col("first"))
    once = t.crossJoin(F.broadcast(bounds)).withColumn("step", F.floor(comes * 4 / (F.datediff("last", "first") + 60)))
    again = once.where("match_num % 5 = 0").withColumn("step", F.least(F.col("step") + F.col("match_num") % 2, F.lit(3)))
    end = src.described(once.limit(1)).withColumns({"step": F.lit(4).cast("long"), "rn": F.col("n_matches"), "tourney_date": F.expr("date_add(last, 5000)"), "winner_name": F.lit(""), "loser_name": F.lit("")})
    arrivals = src.described(src.written(once.unionByName(again).drop("first", "last"), "step")).unionByName(end.drop("first", "last"))
    states = emitted(spark, src.described(t), 5, arrivals, late_streaming_state)
    return last(states, "player").where("player <> ''").select("player", *(r6(c) if c in ("last_5", "last_10") else _c(c) for c in STREAMED))


@query
def e2_streaming_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head-to-head and tournament counts, and the last ten on each surface, of the same stream."""
    from ..streaming.fold import streaming_tallies
    from ..streaming.run import emitted, final_state, final_tallies

    t = _arriving(spark, sf_dir)
    tallies = final_tallies(emitted(spark, t, 4, fold=streaming_tallies)).withColumn("rate", F.lit(None).cast("double"))
    surfaces = final_state(spark, t).select("player", F.lit("surfaces").alias("of"), F.explode("surface_last_10").alias("name", "rate"))
    return tallies.unionByName(surfaces.withColumn("rate", F.round("rate", 6)), allowMissingColumns=True)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


