"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from courtside.llm import negatives
from courtside.llm.negatives import hard_negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, uid long, score string"  # the last two clash


def brute(rows, every, positives=5, n_negatives=3):
    good = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int).tolist(), label) for i, v, label in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in good), default=0)
    good = [(i, v + [0] * (width - len(v)), label) for i, v, label in good]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (a, va, la) in enumerate(good):
        if a is None or a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v, strict=True)), last(i), j) for j, (i, v, _) in enumerate(good) if j != k))
        same = [(-s, good[j][0]) for s, _, j in scored if good[j][2] == la][:positives]
        for ps, p in same:
            fits = [(-s, good[j][0]) for s, _, j in scored if good[j][2] != la and 50 * ps <= -100 * s <= 95 * ps][:n_negatives]
            out += [(a, p, r, i, ps, s) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out, key=str)


def got(spark, rows, every=10, **options):
    df = hard_negatives(spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA), F.col("vec_id") % every == 0, **options)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(rnd, n, dims=12, labels=3, spread=0.6):
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(labels * 2)]
    out = []
    for i in range(n):
        c = rnd.randrange(len(centres))
        out.append((i, [x + rnd.gauss(0, spread) for x in centres[c]], c % labels))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, small, monkeypatch):
    if small:  # many groups, shards and chunks
        for name, value in (("GROUP", 8), ("CHUNK", 16), ("SHARD", 64), ("POOL", 200)):
            monkeypatch.setattr(negatives, name, value)
    rows = vectors(random.Random(5), 400)
    assert (want := brute(rows, 10)) and got(spark, rows) == want


def test_awkward_rows(spark):
    rnd = random.Random(6)
    rows = vectors(rnd, 120, dims=4)
    rows += [(200, None, 1), (210, [1.0, None, 0.0, 0.0], 1), (220, [float("nan")] * 4, 1), (230, [float("inf"), 0.0, 0.0, 0.0], 0), (240, [0.5, 0.5], 2), (250, [], 2), (260, [0.0] * 4, 1), (270, [1.0] * 4, None), (None, [0.7] * 4, 1), (None, [0.7] * 4, 0)]
    rows += [(i, [0.5, 0.25, -0.5, 1.0], i % 3) for i in range(300, 400)]  # one vector, ties by id
    rows += [(20, rows[20][1], rows[20][2])] * 2 + [(-30, [0.1, 0.9, 0.3, 0.2], 0)]  # repeated rows, an anchor below 0
    assert got(spark, rows) == brute(rows, 10)


def test_few_rows_and_none(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, None, 1)]) == got(spark, [(0, [], 1), (1, [], 1)]) == [] == got(spark, [(0, [1.0], 1)])
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.7], 2), (3, [0.3], 2), (4, [0.95], 3)]
    assert got(spark, rows) == brute(rows, 10)
    assert [r[2:4] for r in got(spark, rows)] == [(1, 4), (2, 2)]
    opposite = [(0, [1.0], 1), (1, [-1.0], 1), (2, [0.0], 2)]  # a positive below 0 has no band, one at 0 only 0
    assert got(spark, opposite) == brute(opposite, 10) == []


def test_brackets_hold_the_score():
    """Whatever the pivots are, no score lies outside its bracket."""
    rnd = np.random.default_rng(7)
    x = rnd.integers(-300, 300, (200, 8))
    pivots = negatives.pivots_of(x[:50], 6)
    largest, norms = int((x**2).sum(1).max()), (pivots**2).sum(1)
    q = x[:20]
    from_q = np.sqrt((q**2).sum(1)[:, None] + norms - 2 * q @ pivots.T)
    from_x = np.sqrt(largest + norms - 2 * x @ pivots.T)
    least = np.abs(from_q[:, None, :] - from_x[None]).max(2)
    most = (from_q[:, None, :] + from_x[None]).min(2)
    score = lambda d: ((q**2).sum(1)[:, None] + largest - d**2) / 2
    assert (score(most) - 1 <= q @ x.T).all() and (q @ x.T <= score(least) + 1).all() and (score(least) < largest).mean() > 0.2
