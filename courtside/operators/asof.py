"""As-of lookups: what was last known of a key before a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.matches import written
from .parts import HOT_ROWS, hot_keys, spread, with_parts


def last_of(events: DataFrame, keys: list[str], time: str, order: str, values: list[str]) -> DataFrame:
    """One event a key and time: the last by `order`. Combined before the shuffle, so a time of very many rows is no hot key."""
    got = events.groupBy(*keys, time).agg(F.max_by(F.struct(*values), order).alias("__v"))
    return got.select(*keys, time, "__v.*")


def as_of_join(probes: DataFrame, events: DataFrame, keys: list[str], time: str, values: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """probes with the values of the last event of the same keys before (not at) the probe's time; null where there is none,
    or where a key or time is missing. events: one a key and time at most, see last_of.

    Distinct probes and events are united and sorted by key and time once; the values come from a frame that ends at the
    row. A key with over hot_rows of them is cut by time into parts that are sorted apart;
    what the parts before it knew last is carried into each. The answers then join the probes by key and time."""
    own, at = [f"__{c}" for c in keys], f"__{time}"
    asked = probes.select(*(F.col(c).alias(k) for c, k in zip([*keys, time], [*own, at], strict=True))).dropna().distinct().withColumn("__is_event", F.lit(False))
    known = events.select(*(F.col(c).alias(k) for c, k in zip([*keys, time], [*own, at], strict=True)), F.struct(*values).alias("__v")).dropna(subset=[*own, at]).withColumn("__is_event", F.lit(True))
    both = written(asked.unionByName(known, allowMissingColumns=True))

    hot = hot_keys(both, own, hot_rows)
    rows = spread(with_parts(both, own, at, hot), *own, "__part")

    # At the same time the probe comes before the event.
    upto = Window.partitionBy(*own, "__part").orderBy(at, "__is_event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = rows.withColumn("__v", F.last("__v", ignorenulls=True).over(upto)).where("not __is_event").drop("__is_event")
    ends = rows.join(F.broadcast(hot), own, "left_semi").where("__is_event").groupBy(*own, "__part").agg(F.max_by("__v", at).alias("__end"))
    later = ends.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("__part", "__end"))).alias("__ends"))  # PARTS entries a hot key at most
    answered = answered.join(F.broadcast(later), own, "left")
    carried = F.element_at(F.filter("__ends", lambda x: x["__part"] < F.col("__part")), -1)["__end"]
    answered = answered.select(*own, at, F.coalesce("__v", F.when(F.size(F.filter("__ends", lambda x: x["__part"] < F.col("__part"))) > 0, carried)).alias("__v"))
    same = [F.col(c) == F.col(k) for c, k in zip([*keys, time], [*own, at], strict=True)]
    on = same[0]
    for x in same[1:]:
        on &= x
    return probes.join(answered, on, "left").select(*(F.col(c) for c in probes.columns), *(F.col("__v")[v].alias(v) for v in values))
