"""The ordered fold of a player's matches as a monoid: summaries of slices of time that merge, so that no task has to put a
whole career in order.

A summary holds matches (n), wins, the run of wins and of losses at its end (win_tail, loss_tail), and its last ten results.
Two that follow each other merge: a run at the end goes on in the earlier one if the later one has no other result. Merging
is associative, so slices merge in groups of MANY, groups of groups then into a player's whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Matches of a slice (of all players, in order), results kept, and summaries merged at a time.
SLICE, KEPT, MANY = 1 << 20, 10, 1024
_FIELDS = ["n", "wins", "win_tail", "loss_tail", "last"]
_NOTHING = "named_struct('n', 0L, 'wins', 0L, 'win_tail', 0L, 'loss_tail', 0L, 'last', cast(array() as array<int>))"


def _merged(a: str, b: str) -> str:
    """The summary of a followed by b."""
    last = f"concat({a}.last, {b}.last)"
    return (
        f"named_struct('n', {a}.n + {b}.n, 'wins', {a}.wins + {b}.wins, 'win_tail', if({b}.win_tail = {b}.n, {a}.win_tail, 0L) + {b}.win_tail, "
        f"'loss_tail', if({b}.loss_tail = {b}.n, {a}.loss_tail, 0L) + {b}.loss_tail, 'last', slice({last}, greatest(1, size({last}) - {KEPT - 1}), {KEPT}))"
    )


def sliced(events: DataFrame, width: int = SLICE) -> DataFrame:
    """events with the slice of time that they belong to, and a group of MANY slices."""
    return events.withColumn("slice", F.expr(f"rn div {width}")).withColumn("era", F.expr(f"slice div {MANY}"))


def summaries(events: DataFrame) -> DataFrame:
    """(player, era, slice, s): a summary of each player's matches in a slice."""
    by = ("player", "era", "slice")
    back = events.select(*by, "rn", "won").withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rn"))))
    tail = lambda won: F.coalesce(F.min(F.when(F.col("won") != won, F.col("k"))) - 1, F.count(F.lit(1))).cast("long")
    last = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= KEPT, F.struct("rn", "won")))), lambda x: x["won"].cast("int"))
    parts = back.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("won").cast("long").alias("wins"), tail(1).alias("win_tail"), tail(0).alias("loss_tail"), last.alias("last"))
    return parts.select(*by, F.struct(*_FIELDS).alias("s"))


def _together(parts: DataFrame, order: str, *by: str) -> DataFrame:
    """Summaries merged in order, one for each group of MANY at most."""
    rows = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "s"))).alias("x"))
    return rows.select(*by, F.expr(f"aggregate(x, {_NOTHING}, (a, b) -> {_merged('a', 'b.s')})").alias("s"))


def _before(parts: DataFrame, order: str, *by: str) -> DataFrame:
    """For each summary of a group of MANY at most, what those before it merge to."""
    rows = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "s"))).alias("x"))
    kind = parts.schema["s"].dataType.simpleString()
    state = f"named_struct('now', {_NOTHING}, 'out', cast(array() as array<{kind}>))"
    step = f"(a, b) -> named_struct('now', {_merged('a.now', 'b.s')}, 'out', array_append(a.out, a.now))"
    got = rows.select(*by, "x", F.expr(f"aggregate(x, {state}, {step}).out").alias("before"))
    return got.select(*by, F.explode(F.arrays_zip("x", "before")).alias("z")).select(*by, F.col("z.x")[order].alias(order), F.col("z.before").alias("s"))


def rate(last: Column, n: int) -> Column:
    """The mean of the last n results; null of none."""
    few = F.slice(last, F.greatest(F.lit(1), F.size(last) - (n - 1)), n)
    return F.try_divide(F.aggregate(few, F.lit(0.0), lambda a, x: a + x), F.size(few))


def followed(a: str, b: str) -> Column:
    """The summary column a followed by b, either of which may be missing."""
    return F.expr(f"case when {a} is null then {b} when {b} is null then {a} else {_merged(a, b)} end")


def whole(events: DataFrame, width: int = SLICE) -> DataFrame:
    """(player, s): the summary of each player's career."""
    return _together(_together(summaries(sliced(events, width)), "slice", "player", "era"), "era", "player")


def form(events: DataFrame, width: int = SLICE) -> DataFrame:
    """Each player's last_5, last_10, win_streak and loss_streak."""
    return whole(events, width).select("player", rate(F.col("s.last"), 5).alias("last_5"), rate(F.col("s.last"), 10).alias("last_10"), F.col("s.win_tail").alias("win_streak"), F.col("s.loss_tail").alias("loss_streak"))


def running(events: DataFrame, width: int = SLICE) -> DataFrame:
    """The state after each match: player, rn, matches, wins, win_streak, loss_streak, last_5, last_10. Within a slice frames
    of one sort tell it; what was before the slice is carried in."""
    x = sliced(events.select("player", "rn", "won"), width)
    parts = summaries(x)
    eras = _before(_together(parts, "slice", "player", "era"), "era", "player").withColumnRenamed("s", "a")
    carried = _before(parts, "slice", "player", "era").withColumnRenamed("s", "b").join(eras, ["player", "era"]).select("player", "era", "slice", F.expr(_merged("a", "b")).alias("s"))
    w = Window.partitionBy("player", "era", "slice").orderBy("rn")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("k", F.row_number().over(w).cast("long")).withColumns(
        {"w": F.sum("won").over(so_far), "lost_at": F.max(F.when(F.col("won") == 0, F.col("k"))).over(so_far), "won_at": F.max(F.when(F.col("won") == 1, F.col("k"))).over(so_far), "here": F.collect_list(F.col("won").cast("int")).over(w.rowsBetween(1 - KEPT, 0))}
    )
    x = x.join(carried, ["player", "era", "slice"])
    last = F.concat("s.last", "here")
    run = lambda at, tail: F.when(F.col(at).isNull(), F.col("k") + F.col(f"s.{tail}")).otherwise(F.col("k") - F.col(at))
    return x.select("player", "rn", (F.col("k") + F.col("s.n")).alias("matches"), (F.col("w") + F.col("s.wins")).cast("long").alias("wins"), run("lost_at", "win_tail").alias("win_streak"), run("won_at", "loss_tail").alias("loss_streak"), rate(last, 5).alias("last_5"), rate(last, 10).alias("last_10"))
