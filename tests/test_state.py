"""Player state against hand fixtures and a plain Python fold."""

import datetime
import random
from collections import defaultdict

import pytest
from courtside.operators import features as ft
from courtside.operators import models, prep
from courtside.operators import state as st
from courtside.operators import timeline as tm
from courtside.schema import MATCH_FILE, STATE_SURFACES
from courtside.sources.matches import typed
from pyspark.sql import functions as F
from pytest import approx

HANDS = {"Ann": "R", "Bob": "L", "Cy": "R", "Dee": "U"}
ROWS = [("T1", "Hard", "Ann", "Bob"), ("T1", "Hard", "Ann", "Cy"), ("T2", "Clay", "Bob", "Ann"), ("T2", None, "Ann", "Bob"), ("T3", "Carpet", "Cy", "Ann"), ("T3", "Grass", "Ann", "Dee"), ("T1", "Hard", "Ann", "Bob"), ("T1", "Hard", "Bob", "Cy")]


def frame(spark, rows):
    """Matches (tourney, surface, winner, loser), one a day."""
    out = []
    for i, (t, s, w, x) in enumerate(rows):
        day = (datetime.date(2020, 1, 1) + datetime.timedelta(i)).strftime("%Y%m%d")
        out.append({"tourney_id": t, "tourney_date": day, "surface": s, "winner_name": w, "loser_name": x, "winner_hand": HANDS.get(w), "loser_hand": HANDS.get(x), "match_num": i})
    return typed(spark.createDataFrame([tuple(r.get(c) for c in MATCH_FILE.fieldNames()) for r in out], MATCH_FILE))


def by_player(df):
    return {r.player: r.asDict() for r in df.collect()}


def test_hand_fixture(spark):
    events = st.player_match_events(tm.with_splits(frame(spark, ROWS)))
    got = by_player(st.player_state(events))
    want = {
        "Ann": (7, 5, 0.6, 5 / 7, 2, 0, "Hard", 2, 1, 4, 3),
        "Bob": (5, 2, 0.4, 0.4, 1, 0, "Clay", 5, 2, 0, 0),
        "Cy": (3, 1, 1 / 3, 1 / 3, 0, 1, "Carpet", 2, 1, 1, 0),
        "Dee": (1, 0, 0, 0, 0, 1, "Hard", 1, 0, 0, 0),
    }
    for p, w in want.items():
        g = got[p]
        assert (g["matches"], g["wins"], g["win_streak"], g["loss_streak"], g["preferred_surface"], g["matches_vs_right"], g["wins_vs_right"], g["matches_vs_left"], g["wins_vs_left"]) == (*w[:2], *w[4:]), p
        assert (g["last_5"], g["last_10"]) == approx(w[2:4])
    h = {(r.player, r.opponent): (r.wins, r.matches) for r in st.totals(events, "player", "opponent").collect()}
    assert h["Ann", "Bob"] == (3, 4) and h["Cy", "Bob"] == (0, 1)
    empty = by_player(st.add_missing_players(st.player_state(events), spark.createDataFrame([("Eve",), ("Ann",)], "p string")))
    assert empty["Eve"]["matches"] == 0 and empty["Eve"]["preferred_surface"] == "Hard" and empty["Eve"]["latest_rank"] is None and len(empty) == 5
    before = {(r.player, r.match_num): r for r in st.before_match(events).collect()}
    assert before["Ann", 6].last_5 == approx(0.6) and before["Ann", 6].h2h_wins == 2


def fold(rows):
    """A plain fold of (surface, winner, loser) rows into counters and lists."""
    s = defaultdict(lambda: {"matches": 0, "wins": 0, "recent": [], "win_streak": 0, "loss_streak": 0, "surface": {k: [0, 0] for k in STATE_SURFACES}})
    for _, surface, w, x in rows:
        for p, won in ((w, 1), (x, 0)):
            q = s[p]
            q["matches"] += 1
            q["wins"] += won
            q["recent"].append(won)
            q["win_streak"], q["loss_streak"] = (q["win_streak"] + 1, 0) if won else (0, q["loss_streak"] + 1)
            q["surface"][surface or "Unknown"][0] += won
            q["surface"][surface or "Unknown"][1] += 1
    return s


def test_fold_equivalence_and_invariants(spark):
    rnd = random.Random(7)
    names = [f"P{i}" for i in range(9)] + ["Once"]
    rows = [("T", rnd.choice([*STATE_SURFACES[:4], None]), *rnd.sample(names[:9], 2)) for _ in range(150)] + [("T", "Clay", "P0", "Once")]
    events = st.player_match_events(tm.with_splits(frame(spark, rows)))
    got, want = by_player(st.player_state(events)), fold(rows)
    assert got.keys() == want.keys()
    for p, w in want.items():
        g = got[p]
        assert all(g[k] == w[k] for k in ("matches", "wins", "win_streak", "loss_streak")), p
        assert g["last_5"] == approx(sum(w["recent"][-5:]) / len(w["recent"][-5:])) and g["last_10"] == approx(sum(w["recent"][-10:]) / len(w["recent"][-10:]))
        assert g["preferred_surface"] == max(STATE_SURFACES, key=lambda s: ((w["surface"][s][0] / w["surface"][s][1]) if w["surface"][s][1] else 0, -STATE_SURFACES.index(s)))
        assert (g["win_streak"] > 0) != (g["loss_streak"] > 0)
    assert sum(g["wins"] for g in got.values()) == len(rows)
    last = {r.player: r for r in st.running_totals(events).groupBy("player").agg(F.max_by(F.struct("matches", "wins", "win_streak", "loss_streak"), "rn").alias("x")).select("player", "x.*").collect()}
    assert all((last[p].matches, last[p].wins, last[p].win_streak, last[p].loss_streak) == (w["matches"], w["wins"], w["win_streak"], w["loss_streak"]) for p, w in want.items())
    # no result leaks backwards: turning the last match round changes nothing known before any match
    turned = rows[:-1] + [("T", "Clay", "Once", "P0")]
    a, b = (sorted(map(tuple, st.before_match(st.player_match_events(tm.with_splits(frame(spark, r)))).select("match_num", "player", "last_5", "last_10", "h2h_wins").collect())) for r in (rows, turned))
    assert a == b


@pytest.mark.parametrize("n,sizes", [(10, (5, 2, 3)), (7, (3, 2, 2)), (5, (2, 1, 2)), (4, (2, 1, 1)), (1, (0, 0, 1))])
def test_split_sizes(spark, n, sizes):
    c = {r.split: r["count"] for r in tm.with_splits(frame(spark, [("T", "Hard", "a", "b")] * n)).groupBy("split").count().collect()}
    assert tuple(c.get(k, 0) for k in ("initial", "next", "final")) == sizes


def test_min_matches_is_one_pass(spark):
    m = tm.filter_min_matches(frame(spark, [("T", "Hard", *x) for x in ("ab", "ac", "bd", "ca")]), 2)
    assert sorted((r.winner_name, r.loser_name) for r in m.collect()) == [("a", "b"), ("a", "c"), ("c", "a")]


def test_difference_features(spark):
    cols = ["r1", "r2", "a1", "a2", "s1", "s2", "h1", "h2", "x1", "x2"]
    rows = [(10.0, 11.0, 24.0, 31.0, "1", "WC", 191.0, 179.0, "L", "R"), (10.0, 10.0, 25.0, 31.0, "1", "2", 190.0, 179.0, "R", "R"), (None, 5.0, 24.9, 30.0, None, None, None, 175.0, None, None), (200.0, 3.0, 31.0, 24.0, "Q", "4", 179.0, 191.0, "R", "L")]
    df = spark.createDataFrame(rows, "r1 double, r2 double, a1 double, a2 double, s1 string, s2 string, h1 double, h2 double, x1 string, x2 string")
    df = df.select(F.lit("hard").alias("surface"), *(F.col(c).alias(f"player{c[1]}_{dict(r='rank', a='age', s='seed', h='ht', x='hand')[c[0]]}") for c in cols))
    got = [(r.rank_diff, r.top_10_vs_not, r.young_vs_old, r.seed_diff, r.seeded_vs_unseeded, r.tall_vs_short, r.same_hand, r.left_vs_right, r.surface) for r in ft.difference_features(df).collect()]
    assert got == [(-1, True, True, None, True, True, False, True, "Hard"), (0, False, False, -1, False, False, True, False, "Hard"), (None, False, False, None, False, False, False, False, "Hard"), (197, True, True, None, True, True, False, True, "Hard")]


def test_orientation(spark):
    p = {r.match_num: r for r in ft.orient_pairs(frame(spark, ROWS + [("T", "Hard", "x", "y")])).collect()}
    assert [p[i].result == 1 for i in range(1, 9)] == [False, False, True, True, True, True, False, False]
    assert all((p[i].player1 == p[i].winner_name) == (p[i].result == 1) for i in p)


def test_fill_encode_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (3.0, 13.0), (10.0, 10.0)], "player1_rank double, player2_rank double").withColumn("rank_diff", F.col("player1_rank") - F.col("player2_rank"))
    got = sorted((r.player1_rank, r.player2_rank, r.rank_diff) for r in prep.fill_missing(df).collect())
    assert got == [(1, 5, -4), (2, 999, -4), (3, 13, -10), (10, 10, 0)]
    t = spark.createDataFrame([("b",), ("b",), ("a",), (None,)], "h string")
    assert sorted(r.c for r in prep.encode(t, "h", prep.vocabulary(t, "h"), "c").collect()) == [0, 1, 1, 2]
    with pytest.raises(Exception, match="unseen"):
        prep.encode(t, "h", prep.vocabulary(t.where("h = 'a'"), "h")).collect()
    with pytest.raises(ValueError, match="unseen"):
        prep.require_seen(t, "h", prep.vocabulary(t.where("h = 'a'"), "h"))
    z = prep.scale(spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0)], "x double, k double"), ["x", "k"]).collect()
    assert [r.x for r in z] == approx([-1.069045, -0.267261, 1.336306], abs=1e-6) and all(r.k == 0 for r in z)


def test_metrics_and_histories(spark):
    r = models.evaluate(spark.createDataFrame([(1, 1), (0, 1), (0, 0), (0, 0), (1, 1)], "result int, predicted int")).head()
    assert (r.accuracy, r.weighted_precision, r.weighted_recall, r.weighted_f1) == approx((0.8, 0.866667, 0.8, 0.8), abs=1e-6)
    e = spark.createDataFrame([("p", 0, 5.0), ("p", 1, None), ("p", 2, 7.0)], "player string, rn int, rank double").selectExpr("*", "0d as ht", "'R' as hand", "'1' as seed", "1d as age")
    assert st.histories(e).head().ranks == [5, None, 7] and st.latest(e.where("rn < 2")).head().latest_rank is None


def test_unknown_player_is_an_error(spark):
    events = st.player_match_events(tm.with_splits(frame(spark, ROWS)))
    assert st.player_profile(events, "Nobody").count() == 0
    with pytest.raises(Exception, match="unknown player Nobody"):
        ft.serving_pairs(spark.createDataFrame([("Ann", "Nobody", "Clay")], "player1 string, player2 string, surface string"), events).collect()
