"""Operator 9, near-duplicate groups by fast similarity sketching, banding and exact verification.

Method. A document's set is its distinct shingles of 5 lower-cased words. Equal sets are one class, which stands for its
smallest id in links and components. A class's sketch has t coordinates filled in rounds: in the first t rounds each element is thrown into a random
coordinate, in the next t rounds every element goes into coordinate (round - t); a coordinate keeps the least
(round, hash), so all are full after 2t rounds at the latest and a sketch costs about n + t log t steps instead of n * t.
Coordinates agree with probability equal to the Jaccard similarity. 40 bands of 4 coordinates miss a pair at similarity
0.75 with probability 3e-7.

Verification. A class is first compared, on full sets, with two leaders: the smallest member of all its buckets and the
largest. Links found are joined to components. A pair within a component needs no test, so a group of near copies costs
two comparisons a member. Buckets in which several components still meet are joined with themselves, across components
only and each pair in the first bucket that it shares; members of a large bucket are dealt out in blocks of about BLOCK,
and each pair of blocks is a key of its own, so that no task meets more than two blocks. Before texts are fetched, sketch bits are compared: two bits of each of
the 160 coordinates, and for what meets across components also of 1024 coordinates, computed for those classes alone. By
the sketch's concentration a pair at similarity 0.75 disagrees in 30 and 192 places, and one in ten million in more than
56 and 262; those are passed over. sift=False compares every candidate pair instead. What this cannot avoid: dissimilar
texts that fill one bucket without being linked (texts at 0.5 to 0.75 of each other) are compared by bits pair by pair.

Defined cases: null, empty and blank texts have an empty set (n_shingles 0) and stand alone; a text of fewer than 5 words
is one shingle; rows with the same id are one document, whose links are those of all its texts; rows with a null id are
never linked and stay; empty tables work; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_one, settle, slices, string_bytes, table, unsettle
from .components import components
from .words import NOT_SPACE, gram_hashes, mixed, whole, word_bounds, word_hashes

SHINGLE, PERCENT, BANDS, ROWS = 5, 75, 40, 4
PER_SALT, BLOCK = 2000, 1000
SLICE = 256 << 10  # bytes of text that a worker holds as arrays at a time
#: Longs of sketch bits, 32 coordinates each: of every class, and of those that meet across components; with how many
#: places may differ.
LONGS, MISMATCHES = 5, 56
FINE_LONGS, FINE_MISMATCHES = 32, 262
_BITS, _FINE = [f"s{i}" for i in range(LONGS)], [f"f{i}" for i in range(FINE_LONGS)]


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the offsets of each text's."""
    starts, ends, wo = word_bounds(raw, off, NOT_SPACE)
    h = word_hashes(raw, starts, ends)
    g = gram_hashes(h, n)
    at = np.flatnonzero(whole(wo, len(g), n))
    text, value = np.searchsorted(wo, at, "right") - 1, g[at]
    counts = np.diff(wo)
    for short in range(1, n):  # the whole sequence of a text with fewer words
        which = np.flatnonzero(counts == short)
        if len(which):
            text = np.concatenate([text, which])
            value = np.concatenate([value, gram_hashes(h, short)[wo[which]]])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))


def sketches(value: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates for each non-empty set."""
    sizes = np.diff(offsets)
    sizes = sizes[sizes > 0]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.full((len(sizes), t), np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << 40) - 1)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            v = mixed(value + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            bin_ = ((v >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else np.full(len(v), i - t)
            np.minimum.at(out.reshape(-1), owner * t + bin_, np.uint64(i) << np.uint64(40) | (v & low))
            open_ = (out == np.iinfo(np.uint64).max).any(1)
            if not open_.any():
                break
            keep = open_[owner]
            if not keep.all():  # full sketches take no further rounds
                value, owner = value[keep], owner[keep]
    return out


def _two_bits(sketch: np.ndarray, longs: int) -> np.ndarray:
    """Two bits of each of a sketch's first coordinates, packed into `longs` rows of 64-bit numbers."""
    two = np.zeros((len(sketch), longs * 32), np.uint64)
    two[:, : min(sketch.shape[1], longs * 32)] = (mixed(sketch) >> np.uint64(62))[:, : longs * 32]
    return np.bitwise_or.reduce(two.reshape(-1, longs, 32) << np.arange(0, 64, 2, dtype=np.uint64), axis=2).T.view(np.int64)


def _described(bands: int, rows: int):
    """A mapper from (uid, id, text) to these and the set's size, two keys, sketch bits and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            value, off = shingle_sets(*string_bytes(batch.column("text")))
            n = np.diff(off)
            full = np.flatnonzero(n)
            keys = np.zeros((2, len(n)), np.int64)
            band = np.zeros((len(full), bands), np.uint64)
            bits = np.zeros((LONGS, len(n)), np.int64)
            if len(full):
                with np.errstate(over="ignore"):
                    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7)):
                        keys[k, full] = np.add.reduceat(mixed(value ^ np.uint64(salt)), off[:-1][full]).view(np.int64)
                    sketch = sketches(value, off, bands * rows)
                    bits[:, full] = _two_bits(sketch, LONGS)
                    sketch = sketch.reshape(len(full), bands, rows)
                    for r in range(rows):
                        band = mixed(band * np.uint64(0xD6E8FEB86659FD93) + sketch[:, :, r])
                    band = mixed(band + np.arange(bands, dtype=np.uint64))
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "id", "text")), pa.array(n, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), *map(pa.array, bits), lists], names=["uid", "id", "text", "n", "k1", "k2", *_BITS, "bands"])

    return run


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bits of a longer sketch to rows; every text has a word."""
    for batch in slices(batches, "text", SLICE):
        sketch = sketches(*shingle_sets(*string_bytes(batch.column("text"))), FINE_LONGS * 32)
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, _two_bits(sketch, FINE_LONGS))], names=[*batch.schema.names, *_FINE])


def _compared(percent: int):
    """A mapper from rows sorted by (centre, salt, kind) to links between ids: kind 0 is the centre's own text, kind 1 a
    member's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, name, own = None, None, None
        for batch in slices(batches, "text", SLICE):
            value, off = shingle_sets(*string_bytes(batch.column("text")))
            found = []
            for i, (c, least, kind) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("c", "least", "kind")), strict=True)):
                s = value[off[i] : off[i + 1]]
                if kind == 0:
                    centre, name, own = c, least, s
                    continue
                assert c == centre, "a member came without its centre"
                both = len(np.intersect1d(s, own, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(own) - both):
                    found.append((name, least))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], batch.schema.field("least").type) for i in (0, 1)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (c, x) whose full sets are similar enough, as links (a, b) between the nodes' least ids. texts: (node,
    least, text). Members of a centre with over PER_SALT of them and over one in HOT_SHARE of all pairs are dealt out in
    parts; such centres, HOT_SHARE at most, are broadcast, so no pair is shuffled by its centre alone."""
    pairs = settle(pairs)
    part = max(PER_SALT, pairs.count() // HOT_SHARE)
    centres = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(centres.where(F.col("n") > part).select("c", F.ceil(F.col("n") / part).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    members = pairs.join(hot, "c", "left").select("c", F.col("x").alias("node"), F.pmod(F.xxhash64("x"), salts).cast("int").alias("salt"))
    members = members.join(texts, "node").select("c", "salt", F.lit(1).alias("kind"), "least", "text")
    own = centres.join(hot, "c", "left").select(F.col("c").alias("node"), salts.alias("salts")).join(texts, "node")
    own = own.select(F.col("node").alias("c"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("kind"), "least", "text")
    rows = members.unionByName(own).repartition("c", "salt").sortWithinPartitions("c", "salt", "kind")
    kind = texts.schema["least"].dataType.simpleString()
    links = settle(rows.mapInArrow(_compared(percent), f"a {kind}, b {kind}"))
    unsettle(pairs)
    return links


def _apart(bits: list[str], a: str = "a", b: str = "b") -> Column:
    """In how many places the sketch bits of sides a and b differ."""
    found = None
    for c in bits:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        found = n if found is None else found + n
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, sift: bool = True) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable over links), kept. sift: pass over
    candidate pairs whose sketch bits differ in too many places (one in ten million of the similar ones at most)."""
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    described = settle(source.mapInArrow(_described(bands, rows), f"uid long, id {kind}, text string, n long, k1 long, k2 long, {', '.join(f'{b} long' for b in _BITS)}, bands array<long>"))
    linkable = described.where("n > 0 and id is not null")
    classes = settle(linkable.groupBy("k1", "k2").agg(F.min("uid").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))

    own = linkable.join(classes.select(F.col("node").alias("uid"), "least"), "uid").withColumnRenamed("uid", "node")
    buckets = own.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = settle(buckets.join(shared, "bucket"))
    leaders = members.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    info = settle(own.join(leaders, "node").select("node", "least", "n", *_BITS, "text", "low", "high"))
    texts = info.select("node", "least", "text")

    def may_link() -> Column:
        """Whether sides a and b can be similar enough by their sizes and, with sift, by their sketches' bits."""
        fits = percent * F.greatest("a.n", "b.n") <= 100 * F.least("a.n", "b.n")
        return fits & (_apart(_BITS) <= MISMATCHES) if sift else fits

    sketched = info.select("node", "n", *_BITS)
    stars = info.select("node", F.explode(F.array_distinct(F.array("low", "high"))).alias("c"), "n", *_BITS).where("node <> c")
    stars = stars.alias("a").join(sketched.alias("b"), (F.col("a.c") == F.col("b.node")) & may_link()).select("a.c", F.col("a.node").alias("x"))
    links = verified(stars, texts, percent)
    # Texts of one document are linked, however different.
    edges = links
    repeated = linkable.groupBy("id").agg(F.min("k1").alias("k1"), F.max("k1").alias("other")).where("k1 <> other").select("id")
    if not repeated.isEmpty():
        classes_of = linkable.join(repeated, "id", "left_semi").select("id", "k1", "k2").distinct().join(classes, ["k1", "k2"])
        edges = links.unionByName(classes_of.select(F.col("id").alias("a"), F.col("least").alias("b")))
    first = settle(components(edges))

    # Buckets that hold several components: members of different ones are compared, each pair in one bucket.
    named = info.select("node", "least").join(first.withColumnRenamed("node", "least"), "least", "left").select("node", F.coalesce("root", "least").alias("root"))
    at = members.join(named, "node").select("bucket", "node", "root")
    several = at.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("r0 <> r1")
    open_ = settle(at.join(several.select("bucket", "blocks"), "bucket"))
    places = open_.groupBy("node").agg(F.array_sort(F.collect_set("bucket")).alias("all"), F.first("root").alias("least"))
    fine = info.drop("least").join(places, "node").select("node", "least", "n", *_BITS, "all", "text")
    if sift:
        fine = fine.mapInArrow(_fine, ", ".join([*(f"{c} {t}" for c, t in fine.dtypes), *(f"{f} long" for f in _FINE)]))
    fine = settle(fine)
    met = open_.join(fine.drop("least", "text"), "node")
    own_block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    a = met.withColumn("i", own_block).withColumn("j", F.explode(F.expr("sequence(i, blocks - 1)"))).alias("a")
    b = met.withColumn("j", own_block).withColumn("i", F.explode(F.expr("sequence(0, j)"))).alias("b")
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    on &= ((F.col("a.i") < F.col("a.j")) | (F.col("a.node") < F.col("b.node"))) & (F.col("a.root") != F.col("b.root")) & may_link()
    if sift:
        on &= _apart(_FINE) <= FINE_MISMATCHES
    on &= F.element_at(F.array_intersect("a.all", "b.all"), 1) == F.col("a.bucket")
    # What is found here links components: roots stand for their members.
    more = verified(a.join(b, on).select(F.least("a.node", "b.node").alias("c"), F.greatest("a.node", "b.node").alias("x")), fine.select("node", "least", "text"), percent)
    above = settle(components(more)).withColumnRenamed("root", "top")
    roots = first.join(above.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    roots = settle(roots.unionByName(above.withColumnRenamed("top", "root")))
    for done in (members, info, links, first, open_, fine, more, above):
        unsettle(done)

    final = settle(classes.join(roots.withColumnRenamed("node", "least"), "least", "left").select("k1", "k2", "n", F.coalesce("root", "least").alias("component")))
    for done in (classes, roots):
        unsettle(done)
    in_class = join_one(linkable.select("uid", "id", F.col("n").alias("size"), "k1", "k2"), final, ["k1", "k2"], F.xxhash64("uid")).select("id", "size", "component")
    alone = described.where("not (n > 0 and id is not null)").select("id", F.col("n").alias("size"), F.col("id").alias("component"))
    kept = F.col("id").eqNullSafe(F.col("component")).alias("kept")
    return in_class.unionByName(alone).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), kept)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
