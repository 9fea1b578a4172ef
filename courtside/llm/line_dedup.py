"""Operator 6, line dedup by winnowing over line hashes, native Spark only.

What is removed. Lines without a word don't count in comparisons. A run is a stretch of consecutive lines with words; it
is repeated if an equal run of at least `least` words starts earlier, in order of (id, place). Every line of such a later
run is removed, and wordless lines between two lines that one shortest window removes, since they belong to the passage;
the first occurrence stays. Within one document an occurrence that overlaps the first one is not a repetition.

Method. The window of a line is the shortest run from it, and the shortest run up to it, that has `least` words. The
smallest line hash in a window is its fingerprint, kept with its position, so any two equal runs of `least` words keep
equal fingerprints. Positions are joined over their fingerprints: those that no second position shares are done, and with
them their windows. Around the others a match is extended both ways, forward from each line and backward from each line, as
far as windows still hold a shared position: equal windows are those whose fingerprint and SHA-256 digest (its first 128
bits) of all their lines agree, and the first of them, in order, is what the later ones repeat. Together these windows cover each repeated run
from its first line to its last. All is one row per line and direction at most, combined by hash; no pairs are made, however
many documents share a run, and the rows of a run that very many share are dealt out in parts.

Defined cases: null text stays null and takes no part; empty texts stay; rows with the same id and text are one document
and are treated alike; null ids come first; very long texts are read whole; empty tables work; other columns are returned as
they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_one, settle, table, unsettle

LEAST = 50
_WORD = r"[^\\x20\\x09-\\x0D]+"


def removed_runs(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, th, cuts): for documents that lose lines, ranges of line numbers. th: a hash of the text."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.expr(f"split(`{text_col}`, '\\n', -1)").alias("x"))
    numbered = lines.select("id", "th", F.expr(f"filter(transform(x, (l, i) -> struct(i as at, l as l, regexp_count(l, '{_WORD}') as w)), s -> s.w > 0)").alias("x"))
    narrow = numbered.select(
        "id",
        "th",
        F.expr("transform(x, s -> s.at)").alias("at"),
        F.expr(f"transform(x, s -> least(s.w, {least}))").alias("w"),
        F.expr("transform(x, s -> xxhash64(s.l))").alias("h"),
        F.expr("transform(x, s -> substring(unhex(sha2(s.l, 256)), 1, 16))").alias("d"),
    )
    step = f"struct(0 as s, 0 as n), (a, v) -> if(a.s >= {least}, a, struct(a.s + v as s, a.n + 1 as n)), a -> if(a.s >= {least}, a.n, 0)"
    ahead = f"transform(w, (v, i) -> aggregate(slice(w, i + 1, {least}), {step}))"
    back = f"transform(transform(w, (v, i) -> struct(i as b, aggregate(reverse(slice(w, greatest(i - {least - 1}, 0) + 1, least({least}, i + 1))), {step}) as n)), s -> struct(s.b - s.n + 1 as a, s.n as n))"
    # A window up to a line that is also the one from its first line counts once.
    spans = f"concat(filter(transform(ahead, (n, i) -> struct(i as a, n as n)), s -> s.n > 0), filter({back}, s -> s.n > 0 and get(ahead, s.a) <> s.n))"
    # Each window with its fingerprint, where that stands, and the digest of its lines; a window of one line has its own.
    window = "transform(spans, s -> struct(s.a as a, s.a + s.n - 1 as b, at[s.a] as lo, at[s.a + s.n - 1] as hi, array_min(slice(h, s.a + 1, s.n)) as fp, if(s.n = 1, d[s.a], substring(unhex(sha2(concat_ws('', transform(slice(d, s.a + 1, s.n), x -> hex(x))), 256)), 1, 16)) as k, slice(h, s.a + 1, s.n) as hs))"
    placed = "transform(windows, s -> struct(s.a as a, s.b as b, s.lo as lo, s.hi as hi, s.fp as fp, s.k as k, s.a + cast(array_position(s.hs, s.fp) as int) - 1 as p))"
    windows = narrow.withColumn("ahead", F.expr(ahead)).withColumn("spans", F.expr(spans)).select("id", "th", F.expr(window).alias("windows")).select("id", "th", F.inline(F.expr(placed)))
    windows = settle(windows)

    positions = windows.select("fp", "id", "th", "p").distinct()
    shared = settle(positions.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = settle(join_one(windows, shared, ["fp"], F.xxhash64("id", "a")).drop("n").distinct())
    first = settle(met.groupBy("fp", "k").agg(F.min(F.struct("id", "th", "a", "b")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    later = join_one(met, first, ["fp", "k"], F.xxhash64("id", "a")).where(~same | (F.col("a") > F.col("first.b")))
    cuts = settle(later.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("cuts")))
    for done in (windows, shared, met, first):
        unsettle(done)
    return cuts


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, counts: bool = False) -> DataFrame:
    """docs with later repeated runs of lines cut out of the text. counts: adds n_lines and n_removed."""
    cuts = removed_runs(docs, id_col, text_col, least).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("cuts").alias("__cuts"))
    rows = docs.withColumn("__hash", F.xxhash64(text_col))
    both = rows.join(cuts.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left")
    both = both.withColumn("__lines", F.expr(f"split(`{text_col}`, '\\n', -1)"))
    # Of shortest windows, one that begins later never ends earlier, so what is kept lies between a cut and the one before it.
    between = "transform(__cuts, (c, i) -> struct(coalesce(get(__cuts, i - 1).hi + 1, 0) as lo, c.lo as up))"
    tail = "array(struct(element_at(__cuts, -1).hi + 1 as lo, size(__lines) as up))"
    parts = f"transform(filter(concat({between}, {tail}), k -> k.up > k.lo), k -> struct(k.lo as lo, k.up - k.lo as n))"
    kept = F.expr(f"flatten(transform({parts}, k -> slice(__lines, k.lo + 1, k.n)))")
    both = both.withColumn("__kept", F.when(F.col("__cuts").isNotNull(), kept))
    text = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    extra = []
    if counts:
        n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines")).cast("long")
        extra = [n.alias("n_lines"), (n - F.when(F.col("__cuts").isNull(), n).otherwise(F.size("__kept"))).cast("long").alias("n_removed")]
    return both.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *extra)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
counted AS (SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w FROM raw),
x AS (SELECT doc_id, pos, l, w, row_number() OVER d AS i, sum(w) OVER (d ROWS UNBOUNDED PRECEDING) AS cum FROM counted WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
ahead AS (SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.cum - a.cum + a.w >= 50 GROUP BY ALL),
back AS (SELECT b.doc_id, max(a.i) AS a, b.i AS b FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.cum - a.cum + a.w >= 50 GROUP BY b.doc_id, b.i),
runs AS (SELECT doc_id, a, b FROM ahead UNION SELECT doc_id, a, b FROM back),
content AS (SELECT r.doc_id, r.a, r.b, min(x.pos) AS lo, max(x.pos) AS hi, string_agg(x.l, chr(10) ORDER BY x.i) AS k FROM runs r JOIN x ON x.doc_id = r.doc_id AND x.i BETWEEN r.a AND r.b GROUP BY ALL),
first AS (SELECT k, arg_min({'d': doc_id, 'b': b}, (doc_id, a, b)) AS f FROM content GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM content JOIN first USING (k) WHERE doc_id <> f.d OR a > f.b),
kept AS (SELECT doc_id, count(*) AS n, string_agg(l, chr(10) ORDER BY pos) AS text FROM raw ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n FROM raw GROUP BY doc_id)
SELECT d.doc_id, coalesce(kept.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text, coalesce(total.n, 0) AS n_lines, coalesce(total.n, 0) - coalesce(kept.n, 0) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""
