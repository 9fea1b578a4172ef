"""The streaming fold over matches that come late, twice, too late, and after a long pause."""

import datetime

from courtside.operators import state as st
from courtside.sources.matches import written
from courtside.streaming.late import late_streaming_state
from courtside.streaming.run import emitted
from pyspark.sql import functions as F
from test_ordered import DAY, timeline


def test_late_repeated_and_idle(spark):
    day = lambda n: F.lit(DAY + datetime.timedelta(n))
    t = timeline(spark, 90)  # 30 days
    comes = t.withColumn("step", F.expr("cast((rn + (rn * 7919) % 40) div 50 as long)"))
    twice = comes.where("rn % 4 = 0").withColumn("step", F.expr("step + rn % 2"))
    p = lambda rn, date, step, who: comes.limit(1).withColumns({"rn": F.lit(rn).cast("long"), "tourney_date": date, "step": F.lit(step).cast("long"), "winner_name": F.lit(who), "loser_name": F.lit("sparring")})
    more = [p(1000, day(200), 4, "other"), p(500, day(31), 5, "hot"), p(1001, day(401), 5, "hot"), p(1002, day(3000), 6, "")]  # 500 is too late by then, 1001 comes after a pause
    rows = comes.unionByName(twice)
    for x in more:
        rows = rows.unionByName(x)
    states = emitted(spark, t, 7, written(rows), lambda df: late_streaming_state(df, "60 days", idle_days=150)).collect()
    newest = {}
    for r in states:
        if r.rn < 1000:
            newest[r.player] = max(newest.get(r.player, r), r, key=lambda x: x.rn)
    want = {r.player: r for r in st.player_state(st.player_match_events(t)).collect()}
    assert set(want) == set(newest) - {"", "sparring", "other"}
    for who, w in want.items():
        assert all(newest[who][c] == w[c] for c in ("matches", "wins", "last_5", "last_10", "win_streak", "loss_streak", "preferred_surface")), who
    back = [r for r in states if r.player == "hot" and r.rn == 1001]
    assert [(r.matches, r.wins) for r in back] == [(1, 1)]  # forgotten after 150 days without a match
