"""Permutation importance: how much worse a model does when one input at a time is shuffled among rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _moved(columns: list[str], seed: int):
    """A mapper of a block, with each row's id as text in __id, that adds the columns moved around their circles."""

    def run(block: pa.Table) -> pa.Table:
        ids = [None if i is None else i.encode() for i in block.column("__id").to_pylist()]
        out = block.drop_columns(["__block", "__id"])
        for c in columns:
            tail = f":{seed}:{c}".encode()
            digest = b"".join(bytes(16) if i is None else hashlib.md5(i + tail, usedforsecurity=False).digest() for i in ids)
            high, low = np.frombuffer(digest, ">u8").reshape(-1, 2).T
            order = np.lexsort((low, high))
            from_ = np.empty(len(order), np.int64)
            from_[order] = np.roll(order, -1)
            out = out.append_column(f"permuted_{c}", block.column(c).take(pa.array(from_)))
        return out

    return run


def permuted(df: DataFrame, columns: list[str], id_col: str, seed: int = 42, digits: int | None = None, rows: int = 50_000) -> DataFrame:
    """df with permuted_{column} for each column: its values moved among rows by a keyed cycle. Rows are dealt to blocks by
    a keyed hash of their ids (unique), so that a block is as mixed as the whole and no task has to order all rows; in each
    block a second hash, another one for each column, puts rows into a circle, and every value moves on by one row.
    digits: hexadecimal digits of the hash that name a block; else as many as blocks of about `rows` rows need, and each
    block is moved as a whole, so df should have no columns beyond those needed."""
    key = lambda what: F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}:{what}")))
    if digits is None:
        digits, n = 0, df.count()
        while n > rows * 16**digits:
            digits += 1
        x = df.withColumns({"__block": F.substring(key("block"), 1, digits), "__id": F.col(id_col).cast("string")})
        out = T.StructType([*df.schema, *(T.StructField(f"permuted_{c}", df.schema[c].dataType) for c in columns)])
        return x.groupBy("__block").applyInArrow(_moved(columns, seed), out)
    x = df.withColumn("__block", F.substring(key("block"), 1, digits))

    def moved(c: str) -> Column:
        circle = Window.partitionBy("__block").orderBy(key(c), id_col)
        around = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        is_last = F.row_number().over(circle) == F.count(F.lit(1)).over(around)
        return F.when(is_last, F.first(c).over(around)).otherwise(F.lead(c).over(circle))

    return x.select("*", *(moved(c).alias(f"permuted_{c}") for c in columns)).drop("__block")


def permutation_importance(df: DataFrame, columns: list[str], correct: Callable[[dict[str, Column]], Column] | None, id_col: str, by: list[str] | None = None, seed: int = 42, digits: int | None = None, correct_each: Callable[[dict[str, Column]], Column] | None = None) -> DataFrame:
    """(by..., feature, accuracy, permuted_accuracy, importance): importance is what the accuracy loses. correct: from each
    column's expression whether a prediction by these is right. correct_each, in its place, for models that judge all at
    once: from each column's permuted expression an array, whether the row's own prediction is right, then those with one
    column permuted. All columns are judged in one pass over the rows."""
    by = by or []
    x = permuted(df, columns, id_col, seed, digits)
    own, moved = ({c: F.col(f"{prefix}{c}") for c in columns} for prefix in ("", "permuted_"))
    if correct_each:
        each = x.select(*by, correct_each(moved).alias("each"))
        judged = each.select(*by, *(F.get("each", F.lit(i)).cast("int").alias(f"right_{i - 1}" if i else "right") for i in range(len(columns) + 1)))
    else:
        judged = x.select(*by, correct(own).cast("int").alias("right"), *(correct(own | {c: moved[c]}).cast("int").alias(f"right_{i}") for i, c in enumerate(columns)))
    sums = judged.groupBy(*by).agg(F.avg("right").alias("accuracy"), *(F.avg(f"right_{i}").alias(f"r{i}") for i in range(len(columns))))
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("permuted_accuracy")) for i, c in enumerate(columns))))
    return sums.select(*by, "accuracy", each).withColumn("importance", F.col("accuracy") - F.col("permuted_accuracy"))
