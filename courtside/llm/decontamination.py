"""Operator 10, benchmark decontamination by winnowing.

Method. Words of documents and items are hashed; of the k-grams (k = 5) in each window of 10 words only the smallest hash
is kept, so every shared span of 10 words shares at least one kept fingerprint. Items shorter than 10 words are one
window each and have the hash of all their words as fingerprint. Document and item fingerprints are joined, and each hit
is extended word by word in both directions over the words around it, which proves the match; a match of 10 words or more
(or of a whole short item) marks its words.

Scale. A bitmap of 512 bits for each fingerprint of the benchmark (2**27 bits, 16 MB, at most; combined by a distributed
aggregate) lets a document's fingerprints through that some item may have; the rest never leave the scan. Equal
surroundings of a fingerprint in several items are one row of the index, whose items are attached after the extension. Of
the 5 words by which a match goes beyond its k-gram at least 3 lie on one side, so the join's key is the fingerprint and the
3 words before it, or after it: a k-gram that thousands of items and documents have meets only those that go on alike. The
join is a shuffle join, so the benchmark may grow. Documents are read once, and what survives is written to the shared
folder.

Defined cases: null or wordless texts have no words and hit nothing; null and wordless items match nothing; repeated
documents are judged row by row; repeated item ids count once; very long texts are read whole; empty tables work; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, slices, string_bytes, table, unsettle
from .words import ALPHANUMERIC, gram_hashes, whole, word_bounds, word_hashes

WINDOW, GRAM = 10, 5
#: Bits of the bitmap for each fingerprint, and the least and the most that it has, as powers of two.
SPARSE, FEWEST, MOST = 512, 20, 27
_MAPPED = "uid long, n_words long, hits array<struct<fp:long,n:int,at:array<int>,around:string,lead:int>>"


def _lowered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> str:
    """Words a..b-1, lower-cased and joined by spaces."""
    return b" ".join(raw[s:e].tobytes().lower() for s, e in zip(starts[a:b], ends[a:b], strict=True)).decode()


def _fingerprints(window: int, gram: int, short: list[int], known: Broadcast | None, items: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper from (uid, text) to each text's word count and fingerprints with the words around them. With a known
    bitmap, only fingerprints in it are returned. items: a text of fewer words than a window is itself a window; documents look
    for those of each length in `short` at every place instead."""
    spread = window - gram + 1
    schema = pa.schema([("uid", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("fp", pa.int64()), ("n", pa.int32()), ("at", pa.list_(pa.int32())), ("around", pa.string()), ("lead", pa.int32())])))])

    def passes(g: np.ndarray) -> np.ndarray:
        if known is None:
            return np.ones(len(g), bool)
        bitmap = known.value
        place = g >> np.uint64(65 - (8 * len(bitmap)).bit_length())
        return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = string_bytes(batch.column("text"))
        starts, ends, wo = word_bounds(raw, off, ALPHANUMERIC)
        h, counts = word_hashes(raw, starts, ends), np.diff(wo)
        found: list[list[dict]] = [[] for _ in range(batch.num_rows)]

        g = gram_hashes(h, gram)
        hits = np.flatnonzero(passes(g) & whole(wo, len(g), gram))
        if len(hits):
            text = np.searchsorted(wo, hits, "right") - 1
            low, high = wo[text], wo[text + 1]
            kept = np.zeros(len(hits), bool)
            for first in range(spread):  # windows of k-grams that hold this one; it stays if it is the least of any
                a = hits - first
                fits = (a >= low) & (a + window <= high)
                least = fits.copy()
                for i in range(spread):
                    at = np.minimum(a + i, len(g) - 1)
                    least &= g[np.maximum(at, 0)] >= g[hits]
                kept |= least
            for p, t, lo, hi in zip(hits[kept].tolist(), text[kept].tolist(), low[kept].tolist(), high[kept].tolist(), strict=True):
                a, b = max(lo, p - (window - gram)), min(hi, p + window)
                found[t].append({"fp": int(g[p].astype(np.int64)), "n": window, "at": [p - lo], "around": _lowered(raw, starts, ends, a, b), "lead": p - a})
        for n in range(1, window) if items else short:
            g = gram_hashes(h, n)
            ok = passes(g) & whole(wo, len(g), n)
            if items:
                ok[np.setdiff1d(np.arange(len(g)), wo[:-1][counts == n])] = False
            hits = np.flatnonzero(ok)
            if not len(hits):
                continue
            text = np.searchsorted(wo, hits, "right") - 1
            order = np.lexsort((g[hits], text))
            hits, text = hits[order], text[order]
            cut = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (g[hits][1:] != g[hits][:-1])])
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(hits)], strict=True):
                p, t = int(hits[x]), int(text[x])
                found[t].append({"fp": int(g[p].astype(np.int64)), "n": n, "at": (hits[x:y] - wo[t]).tolist(), "around": _lowered(raw, starts, ends, p, p + n), "lead": 0})
        return pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(counts, pa.int64()), pa.array(found, schema.field("hits").type)], schema=schema)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield of(batch)

    return mapper


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, and items (their ids)."""
    spark = docs.sparkSession
    tests = settle(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).withColumn("uid", F.monotonically_increasing_id()))
    found = settle(tests.select("uid", "text").mapInArrow(_fingerprints(window, gram, [], None, True), _MAPPED).select("uid", F.explode("hits").alias("x")).select("uid", "x.fp", "x.n", "x.around", "x.lead"))
    index = settle(found.select("fp", "n", "around", "lead").distinct().withColumn("place", F.monotonically_increasing_id()))
    owners = settle(found.join(index, ["fp", "n", "around", "lead"]).join(tests.select("uid", "item"), "uid").select("place", "item").distinct())
    short = sorted(r.n for r in index.where(F.col("n") < window).select("n").distinct().collect())  # window - 1 lengths at most
    # The fingerprints' leading bits, gathered into bytes where they are.
    bits = min(MOST, max(FEWEST, (SPARSE * index.count()).bit_length()))
    lead = F.shiftrightunsigned("fp", 64 - bits)
    bytes_ = index.groupBy(F.shiftright(lead, 3).alias("i")).agg(F.bit_or(F.expr(f"cast(shiftleft(1, cast(shiftrightunsigned(fp, {64 - bits}) & 7 as int)) as int)")).alias("b")).toArrow()  # 2**(MOST-3) rows at most
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    bitmap[bytes_.column("i").to_numpy()] = bytes_.column("b").to_numpy()
    bitmap_ = spark.sparkContext.broadcast(bitmap)

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"))
    mapped = settle(_with_id(rows, _fingerprints(window, gram, short, bitmap_, False)))
    hits = mapped.where(F.size("hits") > 0).select("uid", F.explode("hits").alias("x")).select("uid", "x.*")
    half = -(-(window - gram) // 2)

    def keyed(df: DataFrame, words: str) -> DataFrame:
        """df's fingerprints with what goes on alike: the words before, the words after, or nothing for a short item."""
        before = f"if(lead >= {half}, struct('before' as side, concat_ws(' ', slice({words}, lead - {half - 1}, {half})) as next), null)"
        after = f"if(size({words}) - lead - {gram} >= {half}, struct('after' as side, concat_ws(' ', slice({words}, lead + {gram + 1}, {half})) as next), null)"
        df = df.withColumn(words, F.split("around", " ")).drop("around")
        return df.withColumn("key", F.explode(F.expr(f"if(n < {window}, array(struct('' as side, '' as next)), array_compact(array({before}, {after})))"))).select("*", "key.side", "key.next").drop("key")

    pairs = keyed(hits, "a").withColumnRenamed("lead", "i").join(keyed(index, "b").withColumnRenamed("lead", "j"), ["fp", "n", "side", "next"])
    # Extension: how many words before and after the k-gram agree; the k-gram itself is compared too.
    pairs = pairs.withColumn("left", F.expr("aggregate(sequence(0, least(i, j)), 0, (s, x) -> if(x > 0 and s = x - 1 and a[i - x] = b[j - x], x, s))"))
    pairs = pairs.withColumn("right", F.expr("aggregate(sequence(0, least(size(a) - i, size(b) - j)), 0, (s, x) -> if(x > 0 and s = x - 1 and a[i + x - 1] = b[j + x - 1], x, s))"))
    matched = settle(pairs.where("left + right >= n").select("uid", "place", F.expr("transform(at, p -> struct(p - left as lo, p + right as hi))").alias("spans")).distinct())
    for done in (tests, found, index):
        unsettle(done)
    spans = matched.select("uid", F.explode("spans").alias("span")).groupBy("uid").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    items = matched.select("uid", "place").distinct().join(owners, "place").groupBy("uid").agg(F.collect_set("item").alias("items"))
    per = spans.join(items, "uid").select(
        "uid",
        F.expr("aggregate(spans, struct(0 as stop, 0L as total), (s, x) -> struct(greatest(s.stop, x.hi) as stop, s.total + greatest(0, x.hi - greatest(x.lo, s.stop)) as total), s -> s.total)").alias("n_hit"),
        F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"),
    )
    none = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return mapped.select("uid", "id", "n_words").join(per, "uid", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(none).cast("long").alias("n_items"),
        F.sha2(F.array_join(none, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        none.alias("items"),
    )


def _with_id(rows: DataFrame, mapper: Callable) -> DataFrame:
    """The mapper over (uid, text), with the id column carried through."""
    kind = rows.schema["id"].dataType.simpleString()

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for out in mapper(iter([batch.select(["uid", "text"])])):
                yield pa.RecordBatch.from_arrays([batch.column("id"), *out.columns], names=["id", *out.schema.names])

    return rows.mapInArrow(carried, f"id {kind}, {_MAPPED}")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') for i in range(1, len(w) - least(10, len(w)) + 2)]) AS win FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS win FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
