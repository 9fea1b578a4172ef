"""Players' state as a kept table that new matches are merged into, so that a lookup opens one file and folds nothing.

State is made of what merges: counts, the latest match's values, and the fold's summary. The table's players are dealt to
buckets by a hash of their names, a file a bucket, sorted by player. A merge folds the new matches only, joins them to the
buckets that they touch, and writes these as a new version; other buckets stay where they are. A version counts once its
write is complete, and its name tells up to which match it goes, so a merge that is repeated, or that died midway, neither
loses nor doubles a match."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..schema import STATE_SURFACES
from . import fold
from . import state as st

BUCKETS = 64
_LATEST = ["rank", "ht", "hand", "seed", "age"]
_COUNTS = [f"{k}_{s.lower()}" for s in STATE_SURFACES for k in ("matches", "wins")] + [f"{k}_vs_{h}" for h in ("right", "left") for k in ("matches", "wins")]


def mergeable(events: DataFrame) -> DataFrame:
    """One row a player: s (the fold's summary), counts by surface and hand, latest (a struct that begins with rn)."""
    counted = events.groupBy("player").agg(*st.surface_counts(), *st.hand_counts(), F.max_by(F.struct("rn", *_LATEST), "rn").alias("latest"))
    return counted.join(fold.whole(events), "player").select("player", "s", *_COUNTS, "latest")


def merged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both tables' players; matches of `after` follow those of `before`."""
    both = before.withColumn("__new", F.lit(0)).unionByName(after.withColumn("__new", F.lit(1)))
    of = lambda new: F.max(F.when(F.col("__new") == new, F.col("s")))
    got = both.groupBy("player").agg(of(0).alias("a"), of(1).alias("b"), *(F.sum(c).alias(c) for c in _COUNTS), F.max_by("latest", "latest.rn").alias("latest"))
    return got.select("player", fold.followed("a", "b").alias("s"), *_COUNTS, "latest")


def readable(state: DataFrame) -> DataFrame:
    """The scalars that state.player_state has, from the mergeable form."""
    own = {
        "matches": F.col("s.n"), "wins": F.col("s.wins"), "win_pct": ratio(F.col("s.wins"), F.col("s.n")), "last_5": fold.rate(F.col("s.last"), 5), "last_10": fold.rate(F.col("s.last"), 10),
        "win_streak": F.col("s.win_tail"), "loss_streak": F.col("s.loss_tail"), "preferred_surface": st.preferred(), **{f"latest_{c}": F.col(f"latest.{c}") for c in _LATEST},
    }
    return state.withColumns(own).drop("s", "latest")


class KeptState:
    """The table under a path. All methods see the last complete version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _glob(self, pattern: str) -> list[str]:
        return [x.getPath().toString() for x in self._files.globStatus(self._hadoop(f"{self.path}/{pattern}")) or []]

    def version(self) -> tuple[int, int]:
        """The last version's number, and the place of the last match in it; -1 each if there is none."""
        found = [re.search(r"/v(\d+)_(-?\d+)/_SUCCESS$", x) for x in self._glob("v*/_SUCCESS")]
        return max((tuple(map(int, m.groups())) for m in found if m), default=(-1, -1))

    def _current(self) -> dict[int, str]:
        """Where each bucket's last complete version is."""
        complete = {x.rpartition("/")[0] for x in self._glob("v*/_SUCCESS")}
        found: dict[int, tuple[int, str]] = {}
        for folder in self._glob("v*/bucket=*"):
            top, _, bucket = folder.rpartition("/bucket=")
            if top in complete:
                place = int(re.search(r"/v(\d+)_", folder)[1])
                found[int(bucket)] = max(found.get(int(bucket), (-1, "")), (place, folder))
        return {b: folder for b, (_, folder) in found.items()}

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, player: Column) -> Column:
        return F.pmod(F.crc32(player), F.lit(self.buckets)).cast("int")

    def merge(self, events: DataFrame) -> int:
        """Takes in events (those with an rn that the table has not seen); the number of the version that has them."""
        number, seen = self.version()
        new = events.where(F.col("rn") > seen)
        upto = new.agg(F.max("rn")).first()[0]
        if upto is None:
            return number
        fresh = mergeable(new)
        touched = sorted(r[0] for r in new.select(self._bucket(F.col("player"))).distinct().collect())  # `buckets` numbers at most
        current = self._current()
        before = self._read([current[b] for b in touched if b in current], fresh.schema)
        rows = merged(before, fresh).withColumn("bucket", self._bucket(F.col("player")))
        out = f"{self.path}/v{number + 1}_{upto}"
        rows.repartition("bucket").sortWithinPartitions("bucket", "player").write.mode("overwrite").partitionBy("bucket").parquet(out)
        return number + 1

    def lookup(self, *players: str) -> DataFrame:
        """The players' state; no row for one without a match. Opens the files of their buckets only."""
        current = self._current()
        wanted = {zlib.crc32(p.encode()) % self.buckets for p in players}
        return readable(self._read([current[b] for b in sorted(wanted) if b in current], self._schema()).where(F.col("player").isin(*players)))

    def all(self) -> DataFrame:
        return readable(self._read([*self._current().values()], self._schema()))

    def _schema(self) -> str:
        counts = ", ".join(f"{c} bigint" for c in _COUNTS)
        return f"player string, s struct<n: bigint, wins: bigint, win_tail: bigint, loss_tail: bigint, last: array<int>>, {counts}, latest struct<rn: bigint, rank: double, ht: double, hand: string, seed: string, age: double>"

    def discard_old(self) -> int:
        """Deletes buckets that a later version has replaced, and writes that never were complete; how many folders went."""
        kept, gone = set(self._current().values()), 0
        complete = {x.rpartition("/")[0] for x in self._glob("v*/_SUCCESS")}
        for folder in [*(x for x in self._glob("v*/bucket=*") if x not in kept), *(x for x in self._glob("v*") if x not in complete)]:
            gone += self._files.delete(self._hadoop(folder), True)
        return gone
