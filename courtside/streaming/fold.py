"""Player state over a stream of matches: keyed state for each player, advanced in order of rn.

Rows of a micro-batch are sorted by rn within each player; a row at or below the last one applied is late and dropped.
A player's state is one typed value, read and written once a batch: counters, latest values, the last ten results, and the
record on each surface. Opponents and tournaments, of which a player may have very many, have no order: they are tallied by
a streaming aggregate of their own (streaming_tallies), whose state has an entry for each, so a batch touches only its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import player_match_events
from ..schema import STATE_SURFACES

COUNTERS = ["rn", "matches", "wins", "win_streak", "loss_streak", "matches_vs_right", "wins_vs_right", "matches_vs_left", "wins_vs_left"]
LATEST = {"rank": "double", "ht": "double", "hand": "string", "seed": "string", "age": "double"}
#: What the fold reads of a match.
ROW = {"rn": "long", "won": "long", "surface": "string", "opp_hand": "string", **LATEST}
_SURFACES = "array<struct<surface:string,matches:long,wins:long,recent:string>>"
_VALUE = ", ".join([*(f"{c} long" for c in COUNTERS), *(f"{c} {t}" for c, t in LATEST.items()), "recent string", f"surfaces {_SURFACES}"])
OUTPUT = ", ".join(["player string", *(f"{c} long" for c in COUNTERS), *(f"latest_{c} {t}" for c, t in LATEST.items()), "last_5 double", "last_10 double", "preferred_surface string", "surface_last_10 map<string,double>"])
_SHOWN = Row("player", *COUNTERS, *(f"latest_{c}" for c in LATEST), "last_5", "last_10", "preferred_surface", "surface_last_10")
#: Where the counters against a hand begin, among those against hands.
_SIDES = {"R": 0, "L": 2}


def _share(wins: float, matches: float) -> float:
    return wins / matches if matches else 0.0


def _rate(results: str) -> float:
    return _share(results.count("1"), len(results))


def _known(row: Row) -> tuple:
    """A row's columns of ROW, which come after the player."""
    return tuple(row)[1 : 1 + len(ROW)]


#: The state before the first match.
_NOTHING = (-1, *[0] * (len(COUNTERS) - 1), *[None] * len(LATEST), "", ())


def folded(old: tuple | None, rows: list[tuple]) -> tuple:
    """The state after the rows of ROW, which are in order; those that it has seen are passed over. old: the state before."""
    rn, matches, wins, win_streak, loss_streak, *hands = (old or _NOTHING)[: len(COUNTERS)]
    *latest, recent, surfaces = (old or _NOTHING)[len(COUNTERS) :]
    by_surface = {k: list(v) for k, *v in surfaces}
    for row in rows:
        if row[0] <= rn:
            continue
        rn, won, surface, opp_hand, *latest = row
        matches += 1
        wins += won
        win_streak, loss_streak = (win_streak + 1, 0) if won else (0, loss_streak + 1)
        if opp_hand in _SIDES:
            side = _SIDES[opp_hand]
            hands[side] += 1
            hands[side + 1] += won
        recent = f"{recent[-9:]}{won}"
        if (at := by_surface.get(surface)) is None:
            at = by_surface[surface] = [0, 0, ""]
        at[0] += 1
        at[1] += won
        at[2] = f"{at[2][-9:]}{won}"
    return rn, matches, wins, win_streak, loss_streak, *hands, *latest, recent, [(k, *v) for k, v in by_surface.items()]


def shown(player: str, state: tuple) -> Row:
    """A state as a row of OUTPUT."""
    *values, recent, surfaces = state
    by_surface = {k: v for k, *v in surfaces}
    best = max(STATE_SURFACES, key=lambda k: (_share(by_surface[k][1], by_surface[k][0]) if k in by_surface else 0.0, -STATE_SURFACES.index(k)))
    return _SHOWN(player, *values, _rate(recent[-5:]), _rate(recent), best, {k: _rate(v[2]) for k, v in by_surface.items()})


class PlayerFold(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", _VALUE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.value.get()
        new = folded(old, sorted(map(_known, rows), key=lambda r: r[0]))
        if new[0] > (old or _NOTHING)[0]:
            self.value.update(new)
        yield shown(key[0], new)

    def close(self) -> None:
        pass


def streaming_state(matches: DataFrame) -> DataFrame:
    """matches: a streaming frame with rn. Emits each touched player's state after every micro-batch (update mode). Needs the
    RocksDB state store (see run.STATE_STORE)."""
    events = player_match_events(matches).select("player", *ROW)
    return events.groupBy("player").transformWithState(PlayerFold(), OUTPUT, "update", "none")


def streaming_tallies(matches: DataFrame, delay: str | None = None) -> DataFrame:
    """matches: a streaming frame with rn. Emits after every micro-batch, for what it touched, a player's matches and wins so
    far against each opponent and at each tournament (update mode): player, of (opponents or tournaments), name, matches, wins.
    The order doesn't matter, so late matches count. delay: a match that arrives again within so long counts once, and later
    ones than that are dropped; without it every row counts."""
    events = player_match_events(matches)
    if delay:
        events = events.withColumn("at", F.col("tourney_date").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["player", "rn"])
    names = F.inline(F.array(*(F.struct(F.lit(of).alias("of"), F.col(c).alias("name")) for of, c in (("opponents", "opponent"), ("tournaments", "tourney_id")))))
    return events.select("player", "won", names).groupBy("player", "of", "name").agg(F.count(F.lit(1)).alias("matches"), F.sum("won").cast("long").alias("wins"))
