"""Queries over the whole split: every match, and equal to their SQL."""

import pytest
from courtside.functions import scalars as S
from courtside.plans import oracles, queries
from pyspark.sql import functions as F
from test_queries import SF, con, plain  # noqa: F401

NAMES = [*(f"{k}_whole" for k in oracles.WHOLE_SPLIT), "f19_two_decimals_whole"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_split_equals_sql(spark, con, name):  # noqa: F811
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    r = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want and got


def test_whole_split_keeps_every_match(spark, con):  # noqa: F811
    n = con.execute("SELECT count(*) * 3 // 4 - count(*) // 2 FROM orders").fetchone()[0]
    ids = {r.match_num for r in queries.Base(spark, SF).next.select("match_num").collect()}
    for name in ("p2_side_swap", "o6_holdout", "x_filled_features", "f20_seeded_coin"):
        rows = [r.match_num for r in queries.queries()[name](spark, SF).select("match_num").collect()]
        assert len(rows) == len(ids) == n and set(rows) == ids


def test_two_decimals_of_every_ratio(spark):
    pairs = [(w, m) for m in range(1, 401) for w in range(m + 1)]
    df = spark.createDataFrame(pairs, "wins long, matches long").select("wins", "matches", S.shown(F.col("wins") / F.col("matches")).alias("shown"))
    up = {(w, m): (200 * w + m) // (2 * m) for w, m in pairs}
    assert all(r.shown == f"{up[r.wins, r.matches] // 100}.{up[r.wins, r.matches] % 100:02d}" for r in df.collect())
    assert up[1, 8] == 13 and up[57, 200] == 29


def test_two_decimals_shows_every_player(spark):
    run = queries.queries()
    names = lambda q: {r.player for r in run[q](spark, SF).collect()}
    assert names("f19_two_decimals_whole") == names("g1_player_totals")
