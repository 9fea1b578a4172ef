"""The mergeable fold, as-of lookups and kept state against plain Python, with a player or date that holds a third of all rows."""

import bisect
import datetime
import random
from collections import defaultdict

import pytest
from courtside.operators import asof, fold, parts
from courtside.operators import features as ft
from courtside.operators import state as st
from courtside.operators import timeline as tm
from courtside.operators.kept import KeptState
from courtside.schema import STATE_SURFACES
from pyspark.sql import functions as F
from pytest import approx

DAY = datetime.date(2020, 1, 1)


def results(n=600, seed=1):
    """(player, rn, won), one player in a third of all rows and in runs that last over slices."""
    rnd = random.Random(seed)
    out, streak = [], 1
    for i in range(n):
        streak = streak if rnd.random() < 0.97 else 1 - streak
        out.append(("hot", i, streak))
        out += [(f"p{rnd.randrange(9)}", i, rnd.randrange(2)) for _ in range(rnd.randrange(1, 4))] if i % 2 else []
    return [*{(p, i): (p, i, w) for p, i, w in out}.values()]


def folded(rows):
    s = defaultdict(lambda: {"won": [], "win": 0, "loss": 0})
    out = {}
    for p, i, w in sorted(rows, key=lambda r: r[1]):
        x = s[p]
        x["won"].append(w)
        x["win"], x["loss"] = (x["win"] + 1, 0) if w else (0, x["loss"] + 1)
        five, ten = x["won"][-5:], x["won"][-10:]
        out[p, i] = (len(x["won"]), sum(x["won"]), x["win"], x["loss"], approx(sum(five) / len(five)), approx(sum(ten) / len(ten)))
    return out


@pytest.mark.parametrize("width", [3, 50, 1 << 20])
def test_fold_by_slices(spark, width, monkeypatch):
    monkeypatch.setattr(fold, "MANY", 4)  # several eras
    rows = results()
    events = spark.createDataFrame(rows, "player string, rn long, won int").repartition(7)
    want = folded(rows)
    got = {(r.player, r.rn): (r.matches, r.wins, r.win_streak, r.loss_streak, r.last_5, r.last_10) for r in fold.running(events, width).collect()}
    assert got == want
    last = {p: want[p, max(i for q, i in want if q == p)] for p in {p for p, _ in want}}
    got = {r.player: (r.s.n, r.s.wins, r.s.win_tail, r.s.loss_tail) for r in fold.whole(events, width).collect()}
    assert got == {p: w[:4] for p, w in last.items()}
    assert {r.player: (r.win_streak, r.loss_streak, r.last_5, r.last_10) for r in fold.form(events, width).collect()} == {p: w[2:] for p, w in last.items()}


def test_fold_of_nothing(spark):
    none = spark.createDataFrame([], "player string, rn long, won int")
    assert fold.running(none).collect() == fold.form(none).collect() == []


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_as_of_join(spark, hot_rows):
    rnd = random.Random(2)
    key = lambda: rnd.choice(["hot"] * 3 + ["a", "b", "c"])
    events = {(key(), DAY + datetime.timedelta(rnd.randrange(400))): rnd.randrange(99) for _ in range(700)}
    probes = [(i, key(), DAY + datetime.timedelta(rnd.randrange(-20, 430))) for i in range(500)] + [(900 + i, "hot", DAY + datetime.timedelta(77)) for i in range(200)]
    probes += [(2000, None, DAY), (2001, "hot", None), (2002, "nobody", DAY), (2003, None, None)]
    e = spark.createDataFrame([(k, t, v if v % 5 else None, "x") for (k, t), v in events.items()] + [(None, DAY, 1, "x")], "k string, t date, v int, id string")
    p = spark.createDataFrame(probes, "id long, k string, t date")
    got = {r.id: r.v for r in asof.as_of_join(p, e, ["k"], "t", ["v"], hot_rows).collect()}
    want = {}
    for i, k, t in probes:
        times = sorted(u for q, u in events if q == k)
        at = bisect.bisect_left(times, t) - 1 if t else -1
        v = events[k, times[at]] if k and at >= 0 else None
        want[i] = v if v is None or v % 5 else None  # the last event's value counts, even if it is missing
    assert got == want and len(got) == len(probes)


def test_last_of_a_time(spark):
    e = spark.createDataFrame([("a", 1, 5, None), ("a", 1, 7, 2), ("a", 1, 6, 3), ("a", 2, 1, 4)], "k string, t int, o int, v int")
    assert sorted(tuple(r) for r in asof.last_of(e, ["k"], "t", "o", ["v", "o"]).collect()) == [("a", 1, 2, 7), ("a", 2, 4, 1)]


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_places_with_a_crowded_date(spark, hot_rows):
    rnd = random.Random(3)
    rows = [(DAY if rnd.random() < 0.5 else DAY + datetime.timedelta(rnd.randrange(-5, 6)), m) for m in rnd.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "tourney_date date, match_num long").repartition(5)
    got = {r.match_num: (r.rn, r.n_matches) for r in tm.ordered(df, hot_rows).collect()}
    assert got == {m: (i, 500) for i, (_, m) in enumerate(sorted(rows))}
    cut = parts.with_parts(df, ["tourney_date"], "match_num", parts.hot_keys(df, ["tourney_date"], 10)).groupBy("tourney_date", "__part").count().where(F.col("tourney_date") == DAY)
    assert cut.count() > 30 and cut.agg(F.max("count")).first()[0] < 40  # half of all rows, but no part has many


def timeline(spark, n=300, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.sample(["hot", "hot", "p1", "p2", "p3", "p4"], 2)
        if a == b:
            b = "p1"
        rows.append((i, n, DAY + datetime.timedelta(i // 3), i, "T", rnd.choice([*STATE_SURFACES[:3], None]), a, b, "R", "L", 1.0 + i, None, 180.0, 181.0, None, str(i), 20.0, 21.0))
    return spark.createDataFrame(rows, "rn long, n_matches long, tourney_date date, match_num long, tourney_id string, surface string, winner_name string, loser_name string, winner_hand string, loser_hand string, winner_rank double, loser_rank double, winner_ht double, loser_ht double, winner_seed string, loser_seed string, winner_age double, loser_age double")


def test_features_as_of_any_date(spark):
    """As of a date they equal those of a snapshot of all earlier matches, for players and dates without matches too."""
    t = timeline(spark)
    events = st.player_match_events(t)
    asked = spark.createDataFrame([(1, "hot", "p1", "Clay", DAY), (2, "hot", "p2", "Hard", DAY + datetime.timedelta(50)), (3, "p3", "hot", "Grass", DAY + datetime.timedelta(5000)), (4, "p4", "nobody", "Unknown", DAY + datetime.timedelta(33))], "match_num long, player1 string, player2 string, surface string, date date")
    got = {r.match_num: r for r in ft.features_as_of(asked, events).collect()}
    for r in asked.collect():
        before = st.as_of(events, r.date.isoformat())
        one = asked.where(F.col("match_num") == r.match_num)
        want = ft.head_to_head_lookup(ft.surface_lookup(ft.form_lookup(one, before), before), before).first()
        for c in set(got[r.match_num].asDict()) - {"match_num"}:
            assert got[r.match_num][c] == (approx(want[c]) if isinstance(want[c], float) else want[c]), (r, c)


def test_kept_state_after_merges(spark, tmp_path):
    t = timeline(spark)
    events = st.player_match_events(t)
    kept = KeptState(spark, str(tmp_path / "kept"), buckets=4)
    assert kept.all().count() == kept.lookup("hot").count() == 0 and kept.version() == (-1, -1)
    assert kept.merge(events.where("rn < 100")) == 0
    assert kept.merge(events.where("rn < 100")) == 0  # nothing new
    assert kept.merge(events.where("rn < 200 and player in ('hot', 'p1')")) == 1  # touches their buckets only
    kept = KeptState(spark, str(tmp_path / "kept"), buckets=4)
    assert kept.merge(events.where("rn >= 150")) == 2  # overlaps with what is known
    seen = events.where("rn < 100 or rn >= 200 or player in ('hot', 'p1')")
    want = {r.player: r for r in st.player_state(seen).collect()}
    got = {r.player: r for r in kept.all().collect()}
    assert set(got) == set(want)
    for p, w in want.items():
        assert all(got[p][c] == w[c] for c in set(got[p].asDict()) & set(w.asDict())), p
    one = kept.lookup("hot")
    assert one.count() == 1 and one.first().matches == want["hot"].matches and len(one.inputFiles()) == 1  # one file is opened
    assert kept.lookup("nobody").count() == 0


def test_kept_state_survives_a_broken_merge(spark, tmp_path):
    events = st.player_match_events(timeline(spark, 60))
    kept = KeptState(spark, str(tmp_path), buckets=4)
    kept.merge(events.where("rn < 30"))
    (tmp_path / "v1_59" / "bucket=0").mkdir(parents=True)  # a write that was never complete
    before = {r.player: r.matches for r in kept.all().collect()}
    assert sum(before.values()) == 60 and kept.version() == (0, 29)
    assert kept.merge(events) == 1 and sum(r.matches for r in kept.all().collect()) == 120
    assert kept.discard_old() > 0 and sum(r.matches for r in kept.all().collect()) == 120
