"""Runs the streaming fold over a finite set of matches, for tests and for catching up."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.matches import scratch
from .fold import streaming_state

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def emitted(spark: SparkSession, timeline: DataFrame, steps: int = 4, arrivals: DataFrame | None = None, fold: Callable[[DataFrame], DataFrame] = streaming_state) -> DataFrame:
    """timeline (with rn and n_matches; computed before, since each step reads it) arrives in so many steps of time, or as
    arrivals says, which has its columns and step. After each, a stream takes in what is new and ends, and the next one goes on from its state. All that it emits. Each batch has a
    folder of its own, so one that is tried again replaces what it wrote."""
    root = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    rows = timeline.withColumn("step", F.floor(F.col("rn") * steps / F.col("n_matches"))) if arrivals is None else arrivals
    before = spark.conf.get(*STATE_STORE)
    spark.conf.set(*STATE_STORE)
    try:
        for k in range(steps):
            rows.where(F.col("step") == k).drop("step").write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(timeline.schema).parquet(f"{root}/in")
            q = fold(stream).writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{root}/out/batch={k}")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before)
    return spark.read.parquet(f"{root}/out").drop("batch")


def last(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rn")))).where("k = 1").drop("k")


def final_state(spark: SparkSession, timeline: DataFrame, steps: int = 4) -> DataFrame:
    """Of each player's emitted states the last."""
    return last(emitted(spark, timeline, steps), "player")


def final_tallies(tallies: DataFrame) -> DataFrame:
    """(player, of, name, matches, wins): each emitted entry's last; counts only grow."""
    return tallies.groupBy("player", "of", "name").agg(F.max("matches").alias("matches"), F.max("wins").alias("wins"))
