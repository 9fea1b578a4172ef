"""Late matches reach the state in bundles, and a bucket of players takes as few calls as one of them."""

import pyarrow as pa
from courtside.operators import timeline as tm
from courtside.plans import queries as q
from courtside.sources import matches as src
from courtside.streaming import late
from courtside.streaming.fold import LATEST, ROW, folded, shown
from pyspark.sql import Row

from conftest import SF
from test_round_trips import At, Handle

COLUMNS = ["bucket", "ms", "player", *ROW]
TYPES = [pa.int32(), pa.int64(), pa.string(), *({"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t] for t in ROW.values())]


def matches():
    """Twenty of each of 300 players in five buckets, some values missing, on ten dates."""
    some = lambda i, k, v: None if i % k == 0 else v
    return [(i % 5, i // 600 * late.DAY_MS, f"p{i % 300}", i, i % 7 % 2, some(i, 3, "Clay"), some(i, 4, "R"), some(i, 5, 1.5 * i), some(i, 6, 180.0), None, some(i, 7, "WC"), some(i, 8, 20.0)) for i in range(6000)]


def batches(rows, size=1000):
    return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), TYPES, strict=True)], names=COLUMNS) for i in range(0, len(rows), size)]


def arriving(rows):
    return [Row(**r) for b in late.bundles(batches(rows)) for r in b.to_pylist()]


def test_bundles_hold_every_match(monkeypatch):
    rows, fold = matches(), late.BundledFold()
    got = arriving(rows)
    assert len(got) == 50 and {(r.bucket, r.ms) for r in got} == {r[:2] for r in rows}
    assert all(m[-1] == r.ms and int(m[0][1:]) % 5 == r.bucket for r in got for m in fold.arrived([r]))
    want = sorted((*r[2:], r[1]) for r in rows)
    assert sorted(fold.arrived(got), key=lambda m: m[:2]) == want
    monkeypatch.setattr(late, "BUNDLED", 2000)
    assert sorted(fold.arrived(arriving(rows)), key=lambda m: m[:2]) == want and not list(late.bundles(batches([])))


def test_a_bucket_takes_few_calls():
    rows = [r for r in matches() if r[0] == 2]
    handle, fold = Handle(), late.BundledFold()
    fold.init(handle)
    assert not list(fold.handleInputRows((2,), iter(arriving(rows[600:] + rows[:900])), At(-1)))
    assert not list(fold.handleInputRows((2,), iter(arriving(rows[::3])), At(-1)))  # all known
    half = list(fold.handleExpiredTimer((2,), At(4 * late.DAY_MS), None))
    assert len(half) == 60 and sum(r.matches for r in half) == 600 and handle.timers == [0, 5 * late.DAY_MS]
    got = list(fold.handleExpiredTimer((2,), At(20 * late.DAY_MS), None))
    assert handle.calls.total() <= 16
    by_player = {}
    for r in rows:
        by_player.setdefault(r[2], []).append(r[3:])
    assert {r.player: r for r in got} == {p: shown(p, folded(None, x)) for p, x in by_player.items()} and set(LATEST) <= set(ROW)


def test_streams_order_narrow_keys(spark, monkeypatch):
    ordered, seen = tm.ordered, []
    monkeypatch.setattr(tm, "ordered", lambda df: seen.append(df.columns) or ordered(df))
    t = q._arriving(spark, SF)
    assert seen == [["match_num", "tourney_date", "surface", "winner", "loser"]]
    assert set(t.columns) == {*src.derived_matches(spark, SF).columns, "rn", "n_matches"}
