"""How often the streaming fold asks the state store: a call a batch, however many matches and opponents a player has."""

from collections import Counter

from courtside.streaming.fold import LATEST, PlayerFold, streaming_tallies
from courtside.streaming.late import DAY_MS, LateFold
from courtside.streaming.run import emitted, final_tallies
from courtside.operators import state as st
from courtside.sources.matches import written
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_ordered import timeline


class Kept:
    def __init__(self, calls, empty):
        self.calls, self.empty, self.held = calls, empty, empty

    def __getattr__(self, name):
        def call(*args):
            self.calls[name] += 1
            if name in ("update", "put"):
                self.held = args[0]
            elif name == "appendList":
                self.held = [*self.held, *args[0]]
            elif name == "clear":
                self.held = self.empty
            return self.held

        return call


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), []
        self.getValueState = lambda *_: Kept(self.calls, None)
        self.getListState = lambda *_: Kept(self.calls, [])
        self.getMapState = lambda *_: Kept(self.calls, {})
        self.registerTimer = self.timers.append


class At:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = lambda: now


def rows(n, **more):
    return [Row(player="a", rn=i, won=i % 2, surface="Clay", opp_hand="R", **dict.fromkeys(LATEST), **{k: f(i) for k, f in more.items()}) for i in range(n)]


def test_a_batch_takes_few_calls():
    handle, fold = Handle(), PlayerFold()
    fold.init(handle)
    (got,) = fold.handleInputRows(("a",), iter(rows(1000)), None)
    assert (got.matches, got.wins, got.win_streak) == (1000, 500, 1) and handle.calls.total() <= 4


def test_waiting_matches_take_few_calls_and_timers():
    handle, fold = Handle(), LateFold()
    fold.init(handle)
    assert not list(fold.handleInputRows(("a",), iter(rows(1000, ms=lambda i: i * DAY_MS)), At(-1)))
    (got,) = fold.handleExpiredTimer(("a",), At(499 * DAY_MS), None)
    assert got.matches == 500 and handle.calls.total() <= 12 and handle.timers == [0, 500 * DAY_MS]
    assert not list(fold.handleInputRows(("a",), iter(rows(1000, ms=lambda i: i * DAY_MS)), At(499 * DAY_MS)))  # all known
    (got,) = fold.handleExpiredTimer(("a",), At(2000 * DAY_MS), None)
    assert got.matches == 1000


def test_tallies_of_repeated_matches(spark):
    t = timeline(spark, 40)
    comes = t.withColumn("step", F.expr("rn div 20"))
    both = written(comes.unionByName(comes.where("rn % 4 = 0")))
    got = final_tallies(emitted(spark, t, 2, both, lambda df: streaming_tallies(df, "60 days")))
    events = st.player_match_events(t)
    want = {(r.player, of, r[1], r.matches, r.wins) for of, c in (("opponents", "opponent"), ("tournaments", "tourney_id")) for r in st.totals(events, "player", c).collect()}
    assert {tuple(r) for r in got.select("player", "of", "name", "matches", "wins").collect()} == want
    plain = final_tallies(emitted(spark, t, 2, fold=streaming_tallies))
    assert {tuple(r) for r in plain.select("player", "of", "name", "matches", "wins").collect()} == want
