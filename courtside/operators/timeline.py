"""Order in time, positions, chronological splits, and who takes part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .parts import HOT_ROWS, hot_keys, with_parts


def ordered(matches: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """matches with rn, the 0-based place in (tourney_date, match_num) order, and n_matches. Places are counted within each
    date, and within a part of a date of more than hot_rows matches, and shifted by the rows of what comes earlier: no task
    sorts the whole table or a crowded date, and only dates and their parts meet in one."""
    x = with_parts(matches, ["tourney_date"], "match_num", hot_keys(matches, ["tourney_date"], hot_rows))
    per_part = x.groupBy("tourney_date", "__part").agg(F.count(F.lit(1)).alias("rows"))
    dates = Window.orderBy("tourney_date", "__part")
    before = per_part.select("tourney_date", "__part", (F.sum("rows").over(dates) - F.col("rows")).alias("before"), F.sum("rows").over(dates.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_matches"))
    place = F.row_number().over(Window.partitionBy("tourney_date", "__part").orderBy("match_num")) - 1
    return x.withColumn("place", place).join(before, ["tourney_date", "__part"]).withColumn("rn", F.col("before") + F.col("place")).drop("place", "before", "__part")


def with_splits(matches: DataFrame) -> DataFrame:
    """ordered() with split: initial is the first half, next the third quarter, final the rest."""
    n = F.col("n_matches")
    half, three = F.floor(n / 2), F.floor(n * 3 / 4)
    split = F.when(F.col("rn") < half, "initial").when(F.col("rn") < three, "next").otherwise("final")
    return ordered(matches).withColumn("split", split)


def positions(timeline: DataFrame, start: int, stop: int) -> DataFrame:
    return timeline.where((F.col("rn") >= start) & (F.col("rn") < stop))


def appearances(matches: DataFrame) -> DataFrame:
    """(player, n): how often a player takes part, on either side, in one aggregate."""
    return matches.select(F.explode(F.array("winner_name", "loser_name")).alias("player")).where("player is not null").groupBy("player").agg(F.count(F.lit(1)).alias("n"))


def appearances_by_sides(matches: DataFrame) -> DataFrame:
    """The same counts as a full outer join of both sides' counts."""
    w, x = (matches.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("player")).agg(F.count(F.lit(1)).alias(k)) for c, k in (("winner_name", "w"), ("loser_name", "l")))
    return w.join(x, "player", "full_outer").select("player", (F.coalesce("w", F.lit(0)) + F.coalesce("l", F.lit(0))).alias("n"))


def filter_min_matches(matches: DataFrame, min_matches: int = 10) -> DataFrame:
    """Matches of which both players appear at least min_matches times in the given rows; counted once, not again."""
    active = appearances(matches).where(F.col("n") >= min_matches).select("player")
    for c in ("winner_name", "loser_name"):
        matches = matches.join(active, F.col(c) == F.col("player"), "left_semi")
    return matches


def holdout(df: DataFrame, share: float = 0.2, seed: int = 42, id_col: str = "match_num", by: list[str] | None = None) -> DataFrame:
    """df with is_test: exactly the rounded-up share of the rows (of each group of `by`), in the order of a keyed
    hash (another one than the coin's, which decides the label)."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}:holdout")))
    by = by or []
    x = df.withColumn("__key", key).withColumn("__lead", F.substring("__key", 1, 4))
    # How many rows come before those that share a key's first four digits, and how many a group has: 65,536 rows a group.
    leads = x.groupBy(*by, "__lead").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*by).orderBy("__lead") if by else Window.orderBy("__lead")
    before, size = F.sum("__n").over(order) - F.col("__n"), F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    leads = leads.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__lead").alias("__l"), before.alias("__before"), F.ceil(size * F.lit(share)).alias("__cut"))
    place = F.row_number().over(Window.partitionBy(*by, "__lead").orderBy("__key", id_col))
    same = F.col("__lead") == F.col("__l")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return x.withColumn("__place", place).join(leads, same).withColumn("is_test", F.col("__before") + F.col("__place") <= F.col("__cut")).select(*df.columns, "is_test")
