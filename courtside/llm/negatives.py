"""Operator 12, hard-negative mining over integer inner products, by a pivot table.

Method. A component x becomes floor(256 x), so scores are exact integers. With M the largest norm, a stored vector v gets
one more coordinate sqrt(M^2 - |v|^2) and an anchor q gets 0: then d(q, v)^2 = |q|^2 + M^2 - 2 q.v, and a higher inner
product is a smaller Euclidean distance. The index stores each row's inner products with PIVOTS pivots, which also lie at
0 there, hence its exact squared distances from them. By the triangle inequality every pivot brackets d(q, v) between
|d(q, p) - d(p, v)| and d(q, p) + d(p, v), and so the score. Rows whose bracket can't reach what an anchor still looks for
are passed over; survivors are scored exactly.

Anchors are searched in groups against shards of all rows: an anchor group stays in a worker, the shard's rows stream by,
sorted by their nearest pivot, in chunks whose ranges of pivot distances first bracket whole chunks. Each anchor keeps the
best k that it has seen, which raises its bar; Spark ranks the shards' bests once more. Labels are compared inside, so a
label of a third of all rows is no hot key. First the positives are searched, then, within the bands of scores that they
allow, the negatives. The pivots come from SAMPLE rows picked by hash, by farthest-first choice; all rows are indexed, the
result is exact whatever the pivots are.

Defined cases: rows with a null label or vector, or a component that is null, not finite or beyond 32,768 in size (its
scores could leave 64 bits) take no part; shorter vectors count as padded with zeros; rows that repeat an id are rows of
their own, each with its own searches, and an anchor's other rows are all but itself; a null id comes after all others and
is never an anchor; anchors without a positive, and positives without a fitting negative, give no rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table, unsettle

SCALE, MOST, PIVOTS, SAMPLE = 256, 32_768, 16, 1024
#: Anchors that a worker holds, rows of a chunk, rows of a shard at least, candidates held before they are cut to the best.
GROUP, CHUNK, SHARD, POOL = 4096, 512, 1024, 1 << 20
LOW_PERCENT, HIGH_PERCENT = 50, 95
_LAST = (1 << 63) - 1  # stands for a null id
_NONE = -(1 << 62)
_SLACK = 1e-6  # by which brackets of scores are widened: far above what rounding of square roots can do


def pivots_of(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of a sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, gap = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(k, len(sample)):
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(gap.argmax()))
    return sample[chosen]


def _indexed(pivots: np.ndarray, dims: int):
    """Pads vectors, and adds norms, inner products with the pivots, the nearest pivot and its distance."""
    norms = (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = batch.column("vec"), batch.num_rows
            if not n:
                continue
            sizes = np.diff(x.offsets.to_numpy())
            full = np.zeros((n, dims), np.int64)
            full[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x.flatten().to_numpy()
            dots, norm = full @ pivots.T, (full**2).sum(1)
            apart = norm[:, None] + norms[None, :] - 2 * dots
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel(), t)) for v, t in ((full, pa.int32()), (dots, pa.int64()))]
            kept = [batch.column(c) for c in ("uid", "id", "label", "anchor")]
            yield pa.RecordBatch.from_arrays([*kept, lists[0], pa.array(norm), lists[1], pa.array(apart.argmin(1).astype(np.int32)), pa.array(apart.min(1))], names=["uid", "id", "label", "anchor", "vec", "norm", "dots", "cell", "near"])

    return run


def _matrix(column: pa.Array, width: int, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, width)


class _Search:
    """An anchor group's search over the rows that stream by: for each anchor and band of scores, the best k."""

    def __init__(self, dims: int, pivots: np.ndarray, largest: int, k: int, same: bool):
        self.dims, self.k, self.same, self.largest = dims, k, same, largest
        self.norms, self.exact = (pivots**2).sum(1), np.float64 if largest < 1 << 52 else np.int64  # no product or sum of a score is beyond the largest norm
        self.parts: list[tuple] = []
        self.ready = False
        self.held, self.pool = 0, []

    def anchors(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        flat = [np.asarray(batch.column(c).flatten()) for c in ("low", "high")]
        self.parts.append((batch.column("uid").to_numpy(), batch.column("label").to_numpy(), batch.column("norm").to_numpy(), _matrix(batch.column("vec"), self.dims, n), _matrix(batch.column("dots"), len(self.norms), n), np.diff(batch.column("low").offsets.to_numpy()), *flat))

    def _start(self) -> None:
        uid, label, norm, vec, dots, bands, low, high = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.ready = [], True
        self.uid, self.label, self.norm, self.vec = uid, label, norm.astype(float), vec.astype(self.exact)
        self.from_pivots = np.sqrt(np.maximum(0, norm[:, None] + self.norms[None, :] - 2 * dots).astype(float))
        self.width = int(bands.max(initial=1))
        shape = (len(uid), self.width)
        self.low, self.high = np.full(shape, 1), np.full(shape, 0)  # no score fits an unused band
        at = (np.repeat(np.arange(len(uid)), bands), np.arange(len(low)) - np.repeat(np.cumsum(bands) - bands, bands))
        self.low[at], self.high[at] = low, high
        self.bar = self.low.copy()

    def rows(self, batch: pa.RecordBatch) -> None:
        if not self.ready:
            self._start()
        for at in range(0, batch.num_rows, CHUNK):
            self._chunk(batch.slice(at, CHUNK))

    def _chunk(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        dots = _matrix(batch.column("dots"), len(self.norms), n)
        apart = np.sqrt((self.largest + self.norms[None, :] - 2 * dots).astype(float))
        near = np.maximum(apart.min(0) - self.from_pivots, self.from_pivots - apart.max(0)).max(1, initial=0)
        some = np.flatnonzero(((self._score(near) >= self.bar) & (self.high >= self.low)).any(1))
        if not len(some):
            return
        least, most = np.zeros((len(some), n)), np.full((len(some), n), np.inf)
        for p in range(len(self.norms)):
            a, b = self.from_pivots[some, p][:, None], apart[None, :, p]
            np.maximum(least, np.abs(a - b), out=least)
            np.minimum(most, a + b, out=most)
        upper, lower = self._score(least, some), self._score(most, some, -1)
        open_ = np.zeros(upper.shape, bool)
        for k in range(self.width):
            open_ |= (upper >= self.bar[some, k][:, None]) & (lower <= self.high[some, k][:, None])
        label, uid, id_ = (batch.column(c).to_numpy() for c in ("label", "uid", "id"))
        open_ &= (self.label[some][:, None] == label[None, :]) == self.same
        if self.same:
            open_ &= self.uid[some][:, None] != uid[None, :]
        r, c = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(r):
            return
        score = self.vec[some[r]] @ _matrix(batch.column("vec"), self.dims, n)[c].astype(self.exact).T
        open_ = open_[np.ix_(r, c)]
        for k in range(self.width):
            i, j = np.nonzero(open_ & (score >= self.bar[some[r], k][:, None]) & (score <= self.high[some[r], k][:, None]))
            if len(i):
                self.pool.append((some[r[i]] * self.width + k, score[i, j].astype(np.int64), id_[c[j]], uid[c[j]]))
                self.held += len(i)
        if self.held > POOL or self.pool and (self.bar == self.low).any():
            self._cut()

    def _score(self, apart: np.ndarray, some: np.ndarray | slice = slice(None), sign: int = 1) -> np.ndarray:
        """The score at a distance, widened upwards (sign 1) or downwards."""
        norm = self.norm[some][:, None]
        apart = apart[:, None] if apart.ndim == 1 else apart
        return (norm + self.largest - apart**2) / 2 + sign * _SLACK * (1 + norm + self.largest)

    def _cut(self) -> None:
        q, score, id_, uid = (np.concatenate(x) for x in zip(*self.pool, strict=True))
        order = np.lexsort((uid, id_, -score, q))
        first = np.searchsorted(q[order], q[order])
        kept = order[np.arange(len(order)) - first < self.k]
        self.pool, self.held = [(q[kept], score[kept], id_[kept], uid[kept])], len(kept)
        names, start, many = np.unique(q[kept], return_index=True, return_counts=True)
        full = many >= self.k
        self.bar.reshape(-1)[names[full]] = score[kept][start[full] + self.k - 1]

    def found(self) -> pa.RecordBatch:
        if self.pool:
            self._cut()
        q, score, id_, uid = self.pool[0] if self.pool else [np.zeros(0, np.int64)] * 4
        who = self.uid[q // self.width] if len(q) else q
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, t)) for x, t in ((who, np.int64), (q % self.width if len(q) else q, np.int32), (score, np.int64), (id_, np.int64), (uid, np.int64))], names=["uid", "band", "score", "other_id", "other_uid"])


def _searched(dims: int, pivots: np.ndarray, largest: int, k: int, same: bool):
    """A mapper over rows sorted by (grp, shard, kind): kind 0 are anchors, kind 1 the rows of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, search = None, None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("grp", "shard", "kind")])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                if (now := (*marks[:2, start],)) != key:
                    if search:
                        yield search.found()
                    key, search = now, _Search(dims, pivots, largest, k, same)
                part = batch.slice(start, end - start)
                (search.rows if marks[2, start] else search.anchors)(part)
        if search:
            yield search.found()

    return run


def _best(anchors: DataFrame, index: DataFrame, size: tuple[int, int, int, np.ndarray], k: int, same: bool) -> DataFrame:
    """(uid, band, score, other_id, other_uid, place): for each anchor and band, the best k rows of the same label, or of
    other labels. anchors: rows of the index with low and high, arrays of bounds of scores."""
    n, dims, largest, pivots = size
    groups = max(1, -(-anchors.count() // GROUP))
    tasks = 2 * int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(-(-n // SHARD), -(-tasks // groups)))
    columns = ["uid", "id", "label", "vec", "norm", "dots", "cell", "near"]
    left = anchors.select(*columns, "low", "high", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("kind"))
    right = index.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"))
    rows = left.unionByName(right, allowMissingColumns=True).repartition("grp", "shard").sortWithinPartitions("grp", "shard", "kind", "cell", "near")
    found = rows.mapInArrow(_searched(dims, pivots, largest, k, same), "uid long, band int, score long, other_id long, other_uid long")
    place = F.row_number().over(Window.partitionBy("uid", "band").orderBy(F.desc("score"), "other_id", "other_uid"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = LOW_PERCENT, high: int = HIGH_PERCENT, pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of which `anchor` (a
    condition on the ids) is true, its best `positives` other rows of the same label, and for each of these the best
    `negatives` rows of other labels that score between `low` and `high` percent of it."""
    whole = f"forall(`{vector_col}`, x -> x is not null and not isnan(x) and abs(x) <= {MOST})"
    usable = rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.expr(whole))
    vec = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    plain = usable.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vec.alias("vec"))
    dims = plain.agg(F.max(F.size("vec"))).first()[0] or 0
    sample = plain.select("vec").orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE).collect() if dims else []
    padded = np.zeros((len(sample), dims), np.int64)
    for i, r in enumerate(sample):
        padded[i, : len(r.vec)] = r.vec
    centres = pivots_of(padded, pivots)
    index = settle(plain.mapInArrow(_indexed(centres, dims), "uid long, id long, label long, anchor boolean, vec array<int>, norm long, dots array<long>, cell int, near long") if dims else plain.selectExpr("uid", "id", "label", "anchor", "vec", "0L as norm", "cast(array() as array<bigint>) as dots", "0 as cell", "0L as near"))
    n, largest = index.agg(F.count(F.lit(1)), F.coalesce(F.max("norm"), F.lit(0))).first()
    size = (n, dims, largest, centres)

    anchors = index.where("anchor")
    all_scores = anchors.withColumns({"low": F.array(F.lit(_NONE)), "high": F.array(F.lit(-_NONE))})
    best = settle(_best(all_scores, index, size, positives, same=True).withColumn("at", (F.col("place") - 1).cast("int")))
    part = lambda percent: F.col("score").cast("decimal(20,0)") * percent / 100
    bounds = F.struct("at", F.ceil(part(low)).cast("long").alias("low"), F.floor(part(high)).cast("long").alias("high"))
    bands = best.groupBy("uid").agg(F.array_sort(F.collect_list(bounds)).alias("b")).select(F.col("uid").alias("__uid"), F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    banded = settle(anchors.join(bands, F.col("uid") == F.col("__uid")).drop("__uid"))
    worst = _best(banded, index, size, negatives, same=False)
    pairs = best.select(F.col("uid").alias("u"), "at", F.col("other_id").alias("positive"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("uid").alias("v"), F.col("id").alias("anchor_id"))
    shown = lambda c: F.nullif(F.col(c), F.lit(_LAST))
    out = worst.join(pairs, (F.col("uid") == F.col("u")) & (F.col("band") == F.col("at"))).join(ids, F.col("uid") == F.col("v"))
    return out.select("anchor_id", shown("positive").alias("positive_id"), F.col("place").cast("int").alias("rank"), shown("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, cast(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, cast(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
