"""Hot keys cut into ordered parts, so that no task has to sort all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key beyond which it is cut, parts that it is cut into, and hot keys at most (they are broadcast).
HOT_ROWS, PARTS, HOT_KEYS = 1_000_000, 64, 10_000
#: Rows that a task sorts, about.
TASK_ROWS = 500_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than hot_rows rows and over one in HOT_KEYS of all: HOT_KEYS rows at most."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    least = counts.agg(F.greatest(F.lit(float(hot_rows)), F.sum("__n") / HOT_KEYS).alias("__least"))  # one row
    return counts.crossJoin(F.broadcast(least)).where("__n > __least").select(*keys)


def with_parts(df: DataFrame, keys: list[str], order: str, hot: DataFrame, name: str = "__part") -> DataFrame:
    """df with a part number, 0 for keys that aren't hot. Parts follow each other in `order` (a number, date or time), hold
    about equally many rows, and rows that tie in it share a part."""
    shares = [i / PARTS for i in range(1, PARTS)]
    cuts = df.join(F.broadcast(hot), keys, "left_semi").groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, shares, 1000)).alias("__cuts"))
    part = F.coalesce(F.size(F.filter("__cuts", lambda x: x < F.col(order))), F.lit(0))
    return df.join(F.broadcast(cuts), keys, "left").withColumn(name, part).drop("__cuts")


def spread(df: DataFrame, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """df dealt out by keys so that a task has about task_rows rows, however many there are in all: what it sorts then doesn't
    grow with the table. As it is where Spark's own number of partitions does for that."""
    n = -(-df.count() // task_rows)
    return df if n <= 1 else df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
