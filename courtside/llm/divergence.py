"""Operator 11, source divergence audit: how far the word use of a language's sources lies apart.

Method, by term-block dense matrices. One scan counts terms of HELD bytes of text together, as arrays, and sends (lang, source, term) with its
occurrences and documents. Terms that enough documents of a language hold are dealt out to blocks of about BLOCK terms, and
a language's sources to tiles of about TILE. A task gets one block of two tiles as dense int64 matrices, source by term,
absent terms included. It compares all pairs of sources of the tiles by broadcasting, and each source with its language.
The blocks' partial pair matrices are summed by Spark; the blocks' best terms of each source meet in one more ranking, of
`top` rows a block. No task holds more than a block of two tiles, however many terms or sources a language has; the result
itself has a row for each ordered pair of sources.

Integers are exact up to 290 trillion occurrences in a language: 1,000,000,000 is multiplied in two steps, so that no
intermediate value leaves 64 bits.

Defined cases: null text, lang and source count as empty, and an empty lang or source is one like others; each row is a
document, repeated rows too; a source without terms, and a language none of whose terms is kept, give pairs (at 0 without
kept terms) and no terms; a language with one source gives no pairs; terms are of any length; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, slices, string_bytes, table, unsettle

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
BLOCK, TILE = 256, 128
#: Rows sent at a time, bytes of text that are counted together, and bytes of a text that are split at a time.
ENTRIES, HELD, PART = 20_000, 16 << 20, 1 << 20
_STEPS = (31_250, UNIT // 31_250)
#: ASCII that isn't a letter becomes a blank, A-Z becomes a-z, all else stays.
_FOLDED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_TO = np.frombuffer(_FOLDED, np.uint8)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, in lists of about PART bytes of it."""
    folded, start = text.translate(_FOLDED), 0
    while start < len(folded):
        end = folded.find(b" ", start + PART) if start + PART < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The terms of texts that lie together: the text that each is of, and the terms."""
    folded = _TO[raw]
    inside = folded != 0x20
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = inside[firsts]  # a text's end ends its last term
    at = np.flatnonzero(starts)
    before = np.cumsum(inside, dtype=np.int32)  # the bytes of terms up to here
    data = folded[inside]
    ends = np.append(before[at] - 1, len(data)).astype(np.int32)
    return np.searchsorted(offsets, at, "right") - 1, pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, how often each occurs, and the sum of its n (as often, if not given)."""
    order = np.argsort(keys, kind="stable") if n is not None else None
    keys = np.sort(keys) if order is None else keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(keys)))
    return keys[at], times, times if order is None else np.add.reduceat(n[order], at) if len(at) else times


def _sent(groups: list[tuple[str, str]], group: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray, alone: bool) -> pa.RecordBatch:
    """Rows of (lang, source, term, n, docs); alone: after one without a term for each of the groups."""
    some = len(groups) if alone else 0
    group = pa.array(np.append(np.arange(some), group))
    lang, source = (pa.array([g[i] for g in groups], pa.string()).take(group) for i in (0, 1))
    terms = pa.concat_arrays([pa.nulls(some, pa.string()), terms.cast(pa.string())])
    n, docs = (pa.array(np.append(np.zeros(some, np.int64), x)) for x in (n, docs))
    return pa.RecordBatch.from_arrays([lang, source, terms, n, docs], names=["lang", "source", "term", "n", "docs"])


def _together(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What some rows count, each of whose texts is of PART bytes at most."""
    names = [x for r in rows for x in zip(r.column("lang").to_pylist(), r.column("source").to_pylist(), strict=True)]
    places: dict[tuple[str, str], int] = {}
    group = np.array([places.setdefault(x, len(places)) for x in names], np.int64)
    doc, terms = _tokens(*string_bytes(pa.chunked_array([r.column("text") for r in rows])))
    coded = terms.dictionary_encode()
    size = max(1, len(coded.dictionary))
    each, _, n = _summed(doc * size + coded.indices.to_numpy())
    keys, docs, n = _summed(group[each // size] * size + each % size, n)
    for start in range(0, max(1, len(keys)), ENTRIES):
        some = slice(start, start + ENTRIES)
        yield _sent([*places], keys[some] // size, coded.dictionary.take(pa.array(keys[some] % size)), n[some], docs[some], not start)


def _alone(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """What a row with a long text counts."""
    counts: Counter[bytes] = Counter()
    group = (row.column("lang")[0].as_py(), row.column("source")[0].as_py())
    for terms in terms_of(row.column("text")[0].as_py().encode()):
        counts.update(terms)
    names, n = [*counts], np.fromiter(counts.values(), np.int64, len(counts))
    for start in range(0, max(1, len(names)), ENTRIES):
        some = slice(start, start + ENTRIES)
        yield _sent([group], np.zeros(len(n[some]), np.int64), pa.array(names[some], pa.binary()), n[some], np.ones(len(n[some]), np.int64), not start)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of what a task has read, HELD bytes of text at a time; rows without a term for each
    group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices([batch], "text", PART):
            bytes_ = len(string_bytes(part.column("text"))[0])
            if held and size + bytes_ > HELD:
                yield from _together(held)
                held, size = [], 0
            if bytes_ > PART:  # one row
                yield from _alone(part)
            else:
                held.append(part)
                size += bytes_
    if held:
        yield from _together(held)


def weights(n: np.ndarray, total: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / (total + 2 * vocabulary)), in two exact steps."""
    below = total + 2 * vocabulary
    whole, rest = np.divmod((n + 2) * _STEPS[0], below)
    return 1 + whole * _STEPS[1] + rest * _STEPS[1] // below


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tile(top: int):
    """From one block of two tiles: rows without a term describe the sources, the others are counts. Returns pairs
    (source, item) with their sum over the block's terms and, where both tiles are one, each source's best terms."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, a, b = (k.as_py() for k in key[:3])
        head, cells = rows.filter(pc.is_null(rows["term"])), rows.filter(pc.is_valid(rows["term"]))
        sources, tile = head["source"].to_pylist(), head["tile"].to_numpy()
        total, vocabulary, all_, in_block = (head[c].to_numpy() for c in ("total", "vocabulary", "lang_total", "in_block"))
        coded = cells["term"].combine_chunks().dictionary_encode() if len(cells) else None
        terms = coded.dictionary.cast(pa.binary()).to_pylist() if coded is not None else []
        code = coded.indices.to_numpy(zero_copy_only=False) if coded is not None else np.zeros(0, np.int64)
        n = np.zeros((len(sources), len(terms)), np.int64)
        n[pc.index_in(cells["source"], pa.array(sources, pa.string())).to_numpy(), code] = cells["n"].to_numpy()
        out: tuple[list, ...] = ([], [], [], [])

        def put(part: str, source: str, items: list, values: list) -> None:
            for column, x in zip(out, ([source] * len(items), [part] * len(items), items, values), strict=True):
                column.extend(x)

        left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        if in_block[0]:
            p = weights(n, total[:, None], vocabulary[:, None])
            none = weights(np.zeros(1, np.int64), total, vocabulary)
            step = max(1, (1 << 20) // max(1, len(right) * len(terms)))
            for at in range(0, len(left), step):
                some = left[at : at + step]
                sums = gap(p[some][:, None, :], p[right][None, :, :]).sum(2) + (in_block[0] - len(terms)) * gap(none[some][:, None], none[right][None, :])
                for i, s in enumerate(some):
                    mine = right > s if a == b else right >= 0
                    put("pair", sources[s], [sources[r] for r in right[mine]], sums[i][mine].tolist())
        else:
            for s in left:
                mine = right[right > s] if a == b else right
                put("pair", sources[s], [sources[r] for r in mine], [0] * len(mine))
        if a == b and terms:
            in_lang = np.zeros(len(terms), np.int64)
            in_lang[code] = cells["lang_n"].to_numpy()
            q = weights(in_lang, all_[0], vocabulary[0])
            value, place = gap(p, q[None, :]), np.empty(len(terms), np.int64)
            place[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
            for s in left:
                over = np.flatnonzero((n[s] > 0) & (p[s] > q))
                best = over[np.lexsort((place[over], -value[s, over]))[:top]]
                put("term", sources[s], [terms[t].decode() for t in best], value[s, best].tolist())
        return pa.table([pa.array([lang] * len(out[0]), pa.string()), *(pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True))], names=["lang", "source", "part", "item", "value"])

    return run


def _dealt(key: str, parts: str):
    return F.pmod(F.xxhash64(key), F.col(parts)).cast("int")


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: the divergence from each other source of the language, largest
    first. Part `term`: up to `top` terms that the source uses more than its language does."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    counted = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    dealt = counted.repartition("lang", "source", "term")  # a task's rows hardly repeat a term, so none is looked for before the shuffle
    counts = settle(dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n")).where(F.col("in_docs") >= least_docs)
    kept = settle(kept.select("lang", "term", "lang_n"))
    cells = settle(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))

    groups = counts.where("term is null").select("lang", "source")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    langs = sizes.join(vocabulary, "lang", "left").fillna(0, ["vocabulary", "lang_total"])
    langs = settle(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / block))))  # a row a language
    in_blocks = kept.join(langs.select("lang", "blocks"), "lang").groupBy("lang", _dealt("term", "blocks").alias("block")).agg(F.count(F.lit(1)).alias("in_block"))

    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    heads = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
    heads = heads.withColumns({"tile": _dealt("source", "tiles"), "block": F.explode(F.expr("sequence(0, cast(blocks as int) - 1)"))}).join(in_blocks, ["lang", "block"], "left").fillna(0, ["in_block"])
    placed = cells.join(langs.select("lang", "tiles", "blocks"), "lang").withColumns({"tile": _dealt("source", "tiles"), "block": _dealt("term", "blocks")})
    rows = heads.unionByName(placed, allowMissingColumns=True).withColumn("other", F.explode(F.expr("sequence(0, cast(tiles as int) - 1)")))
    rows = rows.select("lang", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "block", "source", "tile", "term", "n", "lang_n", "total", "vocabulary", "lang_total", "in_block")
    found = settle(rows.groupBy("lang", "a", "b", "block").applyInArrow(_tile(top), "lang string, source string, part string, item string, value long"))

    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("source").alias("s"), F.col("item").alias("i")), F.struct(F.col("item").alias("s"), F.col("source").alias("i")))).alias("x"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = both.select("lang", F.col("x.s").alias("source"), F.lit("pair").alias("part"), F.col("x.i").alias("item"), "value").select("*", rank)
    best = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    for done in (counts, kept, cells, langs):
        unsettle(done)
    return pairs.unionByName(best)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
nv AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
tl AS (SELECT lang, sum(n) AS total FROM cl GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * nv.v)::HUGEINT AS p
  FROM g JOIN v USING (lang) JOIN nv USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
q AS (SELECT cl.lang, cl.term, 1 + 1000000000::HUGEINT * (cl.n + 2) // (tl.total + 2 * nv.v)::HUGEINT AS q FROM cl JOIN tl USING (lang) JOIN nv USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, cast(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, cast((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, cast(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
