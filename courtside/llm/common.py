"""What the corpus operators share: reading, text patterns, cutting lineage, Arrow byte views."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts define it (Java and RE2 syntax agree on it).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's own checkpoint folder. Where neither is
    set, a local one serves a session of a single machine; on a cluster that is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="courtside-"))
    return context._jsc.sc().getCheckpointDir().get()


#: While a table is written or collected: shuffle files go once it is there, and Arrow batches stay small, since each task's
#: lie outside the heap, once more while they grow, and in the Python worker.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within has the settings of _WRITING. Session settings are afterwards as they were."""
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table in the shared folder and reads it back, so a lost executor costs
    a reread and never a recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsettle(df: DataFrame) -> None:
    """Deletes a settled table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        if path.getName().startswith("settled-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys with more than this many rows, and more than this share of all, are dealt out in parts by join_one.
HOT_ROWS, HOT_SHARE = 5000, 10_000


def join_one(rows: DataFrame, one: DataFrame, on: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with a settled table that has one row a key and, in n, how many of the rows have that key. Keys that
    have over HOT_ROWS rows and over one in HOT_SHARE of all (so HOT_SHARE keys at most, which are broadcast) are dealt
    out by `spread`, a hash of what tells rows apart; their row of `one` is repeated for each part."""
    per = one.agg(F.greatest(F.lit(float(HOT_ROWS)), F.sum("n") / HOT_SHARE).alias("__per"))
    hot = one.crossJoin(F.broadcast(per)).where("n > __per").select(*on, F.ceil(F.col("n") / F.col("__per")).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    many = rows.join(F.broadcast(hot), on, "left").withColumn("__part", F.pmod(spread, parts).cast("int")).drop("__parts")
    repeated = one.join(F.broadcast(hot), on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return many.join(repeated.hint("merge"), [*on, "__part"], how).drop("__part")


def hashed_sample(rows: DataFrame, by: str, tell_apart: list[str], size: int, counts: dict) -> DataFrame:
    """At most `size` rows of each value of `by`, with `order`, a hash of what tells rows apart: those of the smallest hashes.
    Rows that are equal in it count as one, so repeated or missing ids neither fill the sample nor empty it. counts: how many
    rows each value has. Hashes are looked at up to a bound that leaves about eight times as many as needed; only if repeated
    rows leave too few, all are."""
    whole = 1 << 40
    hashed = rows.withColumn("order", F.pmod(F.xxhash64(F.lit("sample"), *tell_apart), F.lit(whole)))
    bound = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 8 * size / n) * whole)))), F.col(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy("order"))
    for some in (hashed.where(F.col("order") <= bound), hashed):
        cuts = some.select(by, "order").distinct().withColumn("place", place).where(F.col("place") <= size).groupBy(by).agg(F.max("order").alias("cut"), F.count(F.lit(1)).alias("n")).collect()  # a row a value
        if {r[by]: r.n for r in cuts if r.n >= min(size, counts[r[by]])}.keys() == counts.keys():
            break
    cut = F.element_at(F.create_map(*(F.lit(x) for r in cuts for x in (r[by], r.cut))), F.col(by))
    return hashed.where(F.col("order") <= cut).dropDuplicates([by, "order"])


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of an id written in decimal, modulo m."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(m))


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's UTF-8 bytes and its n+1 offsets into them; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds at most `most` bytes of the column (or one row, which may be longer)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), float))
        end, start, held = 0, 0, 0.0
        for end in range(n):
            if held and held + sizes[end] > most:
                yield batch.slice(start, end - start)
                start, held = end, 0.0
            held += sizes[end]
        yield batch.slice(start, n - start)

