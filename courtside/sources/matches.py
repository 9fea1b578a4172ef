"""Where matches come from and go to: yearly CSV files, and a match set derived from the driver's order tables."""

from __future__ import annotations

import csv
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import to_date_strict
from ..schema import MATCH_COLUMNS, MATCH_FILE, SIDE


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session of a single machine gets a
    local one; on a cluster that is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="courtside-")


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, partitioned by the given columns: computed once, however often it is read."""
    path = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f[: f.index("/", f.index("/table-") + 1)] for f in table.inputFiles() if "/table-" in f}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ensure_folder(spark: SparkSession, path: str) -> bool:
    """Makes a folder and those above it where they are missing; whether it had to."""
    if exists(spark, path):
        return False
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files with a header and the declared columns, typed; a malformed date is an error. URLs aren't fetched."""
    for p in [paths] if isinstance(paths, str) else paths:
        if p.startswith(("http://", "https://")):
            raise ValueError(f"{p}: fetch the file first; only file systems are read")
    return typed(spark.read.schema(MATCH_FILE).option("header", True).option("enforceSchema", False).csv(paths))


def typed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("tourney_date", to_date_strict(F.col("tourney_date")))


def write_csv(matches: DataFrame, path: str, mode: str = "ignore") -> str:
    """A sink that leaves existing output alone; missing folders are made."""
    matches.withColumn("tourney_date", F.date_format("tourney_date", "yyyyMMdd")).select(MATCH_COLUMNS).write.mode(mode).option("header", True).csv(path)
    return path


def write_seasons(matches: DataFrame, path: str, mode: str = "ignore") -> str:
    """One folder of CSV files for each year."""
    out = matches.withColumn("season", F.year("tourney_date")).withColumn("tourney_date", F.date_format("tourney_date", "yyyyMMdd"))
    out.select(*MATCH_COLUMNS, "season").write.mode(mode).partitionBy("season").option("header", True).csv(path)
    return path


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names in a CSV file's first line, whatever its file system and compression; none if it is empty."""
    at, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    stream = at.getFileSystem(conf).open(at)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return next(csv.reader([line.removeprefix("\ufeff")])) if line else []


def read_by_header(spark: SparkSession, files: list[str], base: str | None = None, partitions: T.StructType | None = None, others: bool = False) -> DataFrame:
    """CSV files whose headers may differ, united by name: one scan for all files of one header. Declared columns that a file
    lacks are missing; others: undeclared columns too, as text, else they are left unread. A header that repeats a name is an
    error. base, partitions: a folder whose subfolders name columns of these types."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        if names := tuple(header_of(spark, file)):
            by_header.setdefault(names, []).append(file)
    declared, extra = {f.name: f for f in MATCH_FILE.fields}, list(partitions.fields) if partitions else []
    frames = []
    for names, some in by_header.items():
        if len(set(names)) < len(names):
            raise ValueError(f"{some[0]}: its header repeats a name")
        schema = T.StructType([*(declared.get(n, T.StructField(n, T.StringType())) for n in names), *extra])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        kept = [n for n in names if others or n in declared] + [f.name for f in extra]
        frames.append((reader.option("basePath", base) if base else reader).csv(some).select(*kept))
    frames.append(spark.createDataFrame([], T.StructType([*MATCH_FILE.fields, *extra])))
    out = union_by_name(*frames)
    return typed(out.select(*MATCH_COLUMNS, *(c for c in out.columns if c not in MATCH_COLUMNS)))


def read_seasons(spark: SparkSession, path: str, first: int = 2000, last: int = 2024, others: bool = False) -> DataFrame:
    """The seasons first..last with their source_year, read from the folder's name; others aren't opened. Files are read by
    their own headers."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/season=*/*.csv*")
    files = [f.getPath().toString() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]
    files = [f for f in files if first <= int(re.search(r"/season=(-?\d+)/[^/]*$", f)[1]) <= last]
    return read_by_header(spark, files, path, T.StructType([T.StructField("season", T.IntegerType())]), others).withColumnRenamed("season", "source_year")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows, columns matched by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def derived_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a match between two suppliers; the rules are stated in FIXTURES.md."""
    return described(derived_keys(spark, sf_dir))


def derived_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What derived matches follow from, in few bytes: match_num, tourney_date, surface, and the numbers of winner and loser."""
    orders, suppliers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "supplier"))
    n = suppliers.agg(F.count(F.lit(1)).alias("n"))
    x = orders.crossJoin(F.broadcast(n))  # a single row
    x = x.withColumn("a", F.expr("(o_orderkey * 7919 + o_custkey) % n"))
    x = x.withColumns({"b": F.expr("(a + 1 + (o_custkey * 31 + o_orderkey) % (n - 1)) % n"), "cents": F.round(F.col("o_totalprice") * 100).cast("bigint")})
    worth = suppliers.select("s_suppkey", "s_acctbal")
    x = x.join(worth.toDF("a", "worth_a"), "a").join(worth.toDF("b", "worth_b"), "b")
    same = (F.col("worth_a") >= F.col("worth_b")) == (F.col("cents") % 10 < 7)
    x = x.withColumns({"winner": F.when(same, F.col("a")).otherwise(F.col("b")), "loser": F.when(same, F.col("b")).otherwise(F.col("a"))})
    surface = F.expr("case o_orderpriority when '1-URGENT' then 'Hard' when '2-HIGH' then 'Clay' when '3-MEDIUM' then 'Grass' when '4-NOT SPECIFIED' then 'Carpet' end")
    return x.select(F.col("o_orderkey").alias("match_num"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("tourney_date"), surface.alias("surface"), "winner", "loser")


def described(keys: DataFrame) -> DataFrame:
    """derived_keys as matches; other columns stay behind them."""
    date = F.col("tourney_date")
    side = {
        "name": "concat('P', cast({k} as string))",
        "hand": "case when {k} % 10 < 7 then 'R' when {k} % 10 < 9 then 'L' end",
        "rank": "case when {k} % 17 <> 5 then cast(1 + ({k} * 13 + month(tourney_date)) % 200 as double) end",
        "ht": "case when {k} % 11 <> 0 then cast(165 + ({k} * 7) % 40 as double) end",
        "seed": "case ({k} + match_num) % 4 when 0 then cast(1 + ({k} + match_num) % 32 as string) when 1 then 'WC' end",
        "age": "case when {k} % 23 <> 0 then cast(18 + {k} % 15 + year(tourney_date) - 1995 as double) end",
    }
    return keys.select(
        F.concat(F.year(date).cast("string"), F.lit("-"), F.lpad(F.month(date).cast("string"), 2, "0")).alias("tourney_id"),
        "tourney_date",
        "surface",
        *(F.expr(side[c].format(k=k)).alias(f"{k}_{c}") for c, _ in SIDE for k in ("winner", "loser")),
        "match_num",
        *(c for c in keys.columns if c not in ("match_num", "tourney_date", "surface", "winner", "loser")),
    )
