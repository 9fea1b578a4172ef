"""The streaming fold where matches arrive late, out of order and more than once.

Players are dealt out to buckets, whose state is kept as one packed value. A bucket's matches wait in keyed state until the
watermark has passed their date; an event-time timer wakes the bucket at the first of these dates, and what the watermark has
passed is applied, a player at a time, in order of rn. A match that arrives again is known by its player and rn, whether it still
waits or was applied. What waits is a list of packed chunks, read once a call and bounded by the delay. Matches later than the
watermark allows are dropped by Spark. A player who was idle for longer than `idle_days` of event time may be forgotten,
which bounds the state; by default nobody is.

A row costs Spark's stateful processor in Python many times what the fold takes, for each of its cells, and so does a row of a
list state. So the matches of a bucket and date are bundled where they are read, before the shuffle, and wait in chunks."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..operators.state import player_match_events
from .fold import OUTPUT, ROW, PlayerFold, folded, shown

#: What waits of a match: the player, ROW and its date in milliseconds.
_WIDTH = 2 + len(ROW)
_PACKED = "packed binary"
DAY_MS = 86_400_000
#: Events that a task holds while it bundles, and matches of a waiting chunk.
BUNDLED, CHUNK = 1 << 17, 1 << 14


class LateFold(PlayerFold):
    def __init__(self, idle_days: int | None = None):
        self.idle_ms = idle_days * DAY_MS if idle_days is not None else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", _PACKED)  # by player: the fold's state, and when the last match was
        self.waiting = handle.getListState("waiting", _PACKED)

    def arrived(self, rows: Iterator[Row]) -> Iterable[tuple]:
        """The matches that rows hold."""
        return (tuple(r)[:_WIDTH] for r in rows)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs(), self.arrived(rows))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs(), (), forget=True)

    def _advance(self, now: int, arrived: Iterable[tuple], forget: bool = False) -> Iterator[Row]:
        """Applies what the watermark has passed of what waits and of what arrived. forget: then forgets who is idle."""
        kept = self.states.get()
        states = pickle.loads(kept[0]) if kept else {}
        waits = [r for (chunk,) in self.waiting.get() for r in pickle.loads(chunk)]
        known, new = {r[:2] for r in waits}, []
        for r in arrived:
            if r[:2] not in known and (r[0] not in states or r[1] > states[r[0]][0][0]):
                known.add(r[:2])
                new.append(r)
        ready: dict[str, list[tuple]] = defaultdict(list)
        later = []
        for r in [*waits, *new]:
            if r[-1] <= now:
                ready[r[0]].append(r)
            else:
                later.append(r)
        for player, rows in ready.items():
            yield from self._apply(states, player, rows)
        gone = [p for p, (_, played) in states.items() if now - played > self.idle_ms] if forget and self.idle_ms is not None else []
        for player in gone:
            del states[player]
        if ready or gone:
            self.states.update((pickle.dumps(states, 5),)) if states else self.states.clear()
            if self.idle_ms is not None and states:
                self.handle.registerTimer(min(played for _, played in states.values()) + self.idle_ms + 1)
        if ready:
            self.waiting.put(_chunks(later)) if later else self.waiting.clear()
        elif new:
            self.waiting.appendList(_chunks(new))
        if later and (ready or new):
            self.handle.registerTimer(min(r[-1] for r in later))

    def _apply(self, states: dict[str, tuple], player: str, rows: list[tuple]) -> Iterator[Row]:
        """A player's matches in order, in runs between pauses that forget."""
        rows.sort(key=lambda r: r[1])
        state, played = states.get(player, (None, None))
        while rows:
            n = len(rows)
            if self.idle_ms is not None:
                if played is not None and rows[0][-1] - played > self.idle_ms:
                    state = None
                n = next((i for i in range(1, n) if rows[i][-1] - rows[i - 1][-1] > self.idle_ms), n)
            state, played = folded(state, [r[1:-1] for r in rows[:n]]), rows[n - 1][-1]
            yield shown(player, state)
            rows = rows[n:]
        states[player] = state, played


class BundledFold(LateFold):
    """Its rows are bundles."""

    def arrived(self, rows: Iterator[Row]) -> Iterable[tuple]:
        return (match for r in rows for match in pickle.loads(r.bundle))


def _chunks(rows: list[tuple]) -> list[tuple]:
    return [(pickle.dumps(rows[i : i + CHUNK], 5),) for i in range(0, len(rows), CHUNK)]


def _plain(column: pa.Array) -> list:
    """A column's values, None where they are missing."""
    if not column.null_count or pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not pa.types.is_floating(column.type):
        return column.to_pylist()
    values = column.to_numpy(zero_copy_only=False).astype(object)
    values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


def bundles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, ms, player, ROW) to (bucket, ms, bundle): the matches of a bucket and date, up to BUNDLED of a task at a time."""
    held: dict[tuple, list[tuple]] = defaultdict(list)
    n = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int64()), pa.array([pickle.dumps(v, 5) for v in held.values()], pa.binary())], names=["bucket", "ms", "bundle"])

    for batch in batches:
        bucket, ms, *match = map(_plain, batch.columns)
        for key, row in zip(zip(bucket, ms, strict=True), zip(*match, ms, strict=True), strict=True):
            held[key].append(row)
        n += batch.num_rows
        if n >= BUNDLED:
            yield out()
            held.clear()
            n = 0
    if held:
        yield out()


def late_streaming_state(matches: DataFrame, delay: str = "100 days", idle_days: int | None = None, buckets: int = 512) -> DataFrame:
    """As fold.streaming_state, for a stream whose matches come in any order within `delay` of the newest date, or again."""
    bucket, ms = F.expr(f"pmod(hash(player), {buckets})").alias("bucket"), F.unix_millis(F.col("tourney_date").cast("timestamp")).alias("ms")
    events = player_match_events(matches).select(bucket, ms, "player", *(F.col(c).cast(t).alias(c) for c, t in ROW.items()))
    found = events.mapInArrow(bundles, "bucket int, ms long, bundle binary").select("bucket", F.timestamp_millis("ms").alias("at"), "bundle").withWatermark("at", delay)
    return found.groupBy("bucket").transformWithState(BundledFold(idle_days), OUTPUT, "update", "eventtime")
