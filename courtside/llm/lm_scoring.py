"""Operator 1, language-model scoring by context-tree weighting over bytes.

Model. Bytes are decomposed into 8 binary decisions. Each decision has a tree over the preceding `depth` bytes whose nodes
hold Krichevsky-Trofimov estimates; from the leaves up, a node weighs its own block probability against the product of its
children's, one half each. A trained tree predicts a byte by mixing the estimates along its context's path with the
weights so found. A context that training never saw leaves the decision to the longest one that it did see.

What is scored. A text is lower-cased (A-Z), its words are joined by single spaces, and an end symbol follows: the same
events that the base, a smoothed unigram of words and the end, gives a probability to. Both are log10. bits_per_byte is
the code length that the model gives the text, per byte of these words and spaces and the end symbol.

Scale. All training texts are counted whole; nothing is sampled or capped. Documents are dealt by a hash into chunks of
about 16 MB, many of which may share a partition and pass one after the other. A chunk sends its distinct grams and words
with their training counts, one row each, however often they occur; these are combined by key, and each chunk gets back
the values of its own keys before its documents stream by, so no task ever holds the model. Words are told apart by their
bytes in the corpus and by 64-bit hashes within a chunk.

Trees are weighted bottom up by aggregates: grams that share their three most recent context bytes are weighed together
where they lie and send sums for the nodes two bytes deep; these send sums for the nodes one byte deep (256 of 255 each
at most, which go over the driver). Top down, a context's nodes two bytes deep travel to its grams. A task holds the grams
of one context of three bytes at a time, however many share two. Intermediate tables are written to the shared folder.

Defined cases: null and empty texts are the end symbol alone; without any training text the base and the model are
uniform over what they know; repeated rows are scored and learned from row by row; null ids are hashed as null and belong
to training; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, settle, slices, string_bytes, table, unsettle
from .ctw import Levels, grams, log_kt
from .hashed import Table
from .words import LOWER, NOT_SPACE, mixed, word_bounds, word_hashes

DEPTH, CHUNK_BYTES, PARTITIONS, UNIT, SLICE = 5, 16 << 20, 20_000, 200_000, 512 << 10
#: Counts that a worker holds unmerged; a slice's arrays and these are most of its memory.
UNMERGED = 1_500_000
_TOP = 3
#: Stands for the end among hashes of words.
_END = np.uint64(0x9E3779B97F4A7C15)


class _Texts:
    """Texts as bytes: words lower-cased and joined by single spaces, and each word's hash."""

    def __init__(self, column: pa.Array):
        raw, off = string_bytes(column)
        self.starts, self.ends, self.words = word_bounds(raw, off, NOT_SPACE)
        inner = np.ones(len(self.starts), bool)
        inner[self.words[:-1][np.diff(self.words) > 0]] = False  # a text's first word has no space before it
        keep, self.low = NOT_SPACE[raw], LOWER[raw]
        gaps = self.starts[inner] - 1
        keep[gaps], self.low[gaps] = True, 0x20
        upto = np.concatenate([[0], np.cumsum(keep)])
        self.sizes = np.diff(upto[off])
        self.body = self.low[keep]
        with np.errstate(over="ignore"):
            self.hashes = mixed(word_hashes(raw, self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64) * _END)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their n, and where each was first."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.add.reduceat(n[order], cut) if len(cut) else n[:0], order[cut]


class _Counts:
    """A chunk's distinct grams and words with their training counts."""

    def __init__(self) -> None:
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, texts: _Texts, train: np.ndarray, depth: int) -> None:
        key, off = grams(texts.body, texts.sizes, depth)
        key = np.sort(key << np.uint64(1) | np.repeat(train, np.diff(off)).astype(np.uint64))  # depth + 1 bytes and the flag
        cut = np.flatnonzero(np.concatenate([[True], key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1)]))
        self.grams.append((key[cut] >> np.uint64(1), np.add.reduceat((key & np.uint64(1)).astype(np.int64), cut)))
        hash_, n, at = _summed(texts.hashes, np.repeat(train, np.diff(texts.words)).astype(np.int64))
        names = np.empty(len(at) + 1, object)
        names[:-1] = [texts.word(i) for i in at.tolist()]
        names[-1] = b""
        self.words.append((np.append(hash_, _END), np.append(n, train.sum()), names))
        self.held += len(cut) + len(at)
        if self.held > UNMERGED:
            self.merge()

    def merge(self) -> None:
        key, n = (np.concatenate(x) for x in zip(*self.grams, strict=True))
        self.grams = []  # each array goes before the next one comes
        order = np.argsort(key, kind="stable")
        key = key[order]
        n = n[order]
        del order
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if len(cut) < len(key):
            key, n = key[cut], np.add.reduceat(n, cut)
        self.grams = [(key, n)]
        hash_, sums, names = (np.concatenate(x) for x in zip(*self.words, strict=True))
        hash_, sums, at = _summed(hash_, sums)
        self.words, self.held = [(hash_, sums, names[at])], 0

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        (key, n), (hash_, sums, names) = self.grams[0], self.words[0]
        for keys, words, counts in ((key, None, n), (hash_, names, sums)):
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                word = pa.nulls(len(k), pa.binary()) if words is None else pa.array(words[i : i + (1 << 16)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk, np.int32)), pa.array(k.view(np.int64)), word, pa.array(counts[i : i + (1 << 16)].astype(np.int64))], names=["chunk", "key", "word", "n"])


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where the chunk changes."""
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b > a:
                yield int(chunk[a]), batch.slice(a, b - a)


def _counted(depth: int):
    """A mapper from (chunk, train, text), chunk after chunk, to the chunks' distinct grams and words. The empty word is
    the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for chunk, batch in _by_chunk(slices(batches, "text", SLICE)):
            if chunk != last and held:
                yield from held.rows(last)
            if chunk != last:
                held, last = _Counts(), chunk
            held.add(_Texts(batch.column("text")), batch.column("train").to_numpy(zero_copy_only=False), depth)
        if held:
            yield from held.rows(last)

    return run


def _units(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (gram, n) rows as runs of about UNIT rows, never cut within grams that agree from bit `shift` up."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column("gram").to_numpy().astype(np.uint64), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size >= UNIT:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, (key[-1] >> np.uint64(shift)) << np.uint64(shift)))
            if cut:
                yield key[:cut], n[:cut]
            held, size = [(key[cut:], n[cut:])], len(key) - cut
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _stay(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logs of nodes' weighted probabilities, and the weights of their own estimates in them."""
    own = log_kt(zeros.astype(np.int64), ones.astype(np.int64))
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted)


def _mixed_in(p: np.ndarray, seen: np.ndarray, zeros: np.ndarray, ones: np.ndarray, stay: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability p of longer contexts, mixed with the nodes one byte up; what longer contexts never saw is theirs."""
    own = (np.where(bits == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
    return np.where(seen, stay * own + (1 - stay) * p, own), zeros + ones > 0


class _Shallow:
    """Nodes at depths 1 and 0, by (byte << 8) | node and by node."""

    def __init__(self, rows: list) -> None:
        zeros, ones, below = (np.zeros(1 << 16) for _ in range(3))
        for r in rows:
            zeros[r.node], ones[r.node], below[r.node] = r.zeros, r.ones, r.below
        weighted, stay = _stay(zeros, ones, below)
        by = lambda x: x.reshape(256, 256).sum(0)
        zeros0, ones0 = by(zeros), by(ones)
        self.levels = [(zeros, ones, stay, 0xFFFF), (zeros0, ones0, _stay(zeros0, ones0, by(np.where(zeros + ones > 0, weighted, 0.0)))[1], 0xFF)]

    def mixed(self, p: np.ndarray, seen: np.ndarray, node: np.ndarray, bits: np.ndarray) -> np.ndarray:
        for zeros, ones, stay, mask in self.levels:
            at = node & mask
            p, seen = _mixed_in(p, seen, zeros[at], ones[at], stay[at], bits)
        return p


def _sums(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> pa.RecordBatch:
    """What nodes send to those one byte up, whose numbers are given; nodes that training never saw send nothing."""
    some = zeros + ones > 0
    above, to = np.unique(node[some], return_inverse=True)
    sums = [np.bincount(to, v[some], len(above)) for v in (zeros, ones, weighted)]
    return pa.RecordBatch.from_arrays([pa.array(above.astype(np.int64)), *(pa.array(s.astype(np.int64)) for s in sums[:2]), pa.array(sums[2])], names=["node", "zeros", "ones", "below"])


def _up(node: np.ndarray) -> np.ndarray:
    """The node one byte up: the context's oldest byte goes."""
    return ((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255))


def train(totals: DataFrame, depth: int) -> DataFrame:
    """From (gram, n), one row per distinct gram, to a settled (gram, value): the log10 probability of its last byte."""
    shift = 8 * (depth + 1 - _TOP)
    two = 8 * (depth - 1)  # from this bit up, a gram's two most recent context bytes

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _units(batches, shift):
            x = Levels(key, n, depth, _TOP)
            yield _sums(_up(x.nodes[-1]), x.zeros[-1], x.ones[-1], x.log_weighted[-1])

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, zeros, ones, below = (b.column(c).to_numpy() for c in ("node", "zeros", "ones", "below"))
            yield _sums(_up(node.astype(np.uint64)), zeros, ones, _stay(zeros, ones, below)[0])

    nodes = "node long, zeros long, ones long, below double"
    summed = lambda df: df.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
    dealt = totals.repartition(F.shiftrightunsigned("gram", shift)).sortWithinPartitions("gram")
    deep = settle(summed(dealt.mapInArrow(upward, nodes)))
    shallow = totals.sparkSession.sparkContext.broadcast(_Shallow(summed(deep.mapInArrow(further, nodes)).collect()))  # 256 * 255 rows at most

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[list[np.ndarray]] = [[np.zeros(0)] * 4]

        def grams_only() -> Iterator[pa.RecordBatch]:
            for b in batches:
                is_node = np.asarray(b.column("node").is_valid())
                if is_node.any():
                    own = b.filter(pa.array(is_node))
                    known.append([own.column(c).to_numpy(zero_copy_only=False) for c in ("node", "zeros", "ones", "below")])
                if not is_node.all():
                    yield b.filter(pa.array(~is_node)).select(["gram", "n"])

        for key, n in _units(grams_only(), shift):
            node, zeros, ones, below = (np.concatenate(c) for c in zip(*known, strict=True))
            here = node.astype(np.uint64) >> np.uint64(8) >= key[0] >> np.uint64(two)  # those before are done with
            known[:] = [[c[here] for c in (node, zeros, ones, below)]]
            node, zeros, ones, below = known[0]
            x = Levels(key, n, depth, _TOP)
            p, seen = x.mixed()
            symbol = np.stack([np.uint64(1 << k) | ((key & np.uint64(255)) >> np.uint64(8 - k)) for k in range(8)])
            at = ((key >> np.uint64(two)) << np.uint64(8)) | symbol
            order = np.argsort(node)
            place = np.searchsorted(node[order], at.astype(np.int64))
            there = np.append(node[order], -1)[place] == at.astype(np.int64)
            z, o, s = (np.where(there, np.append(v[order], 0.0)[place], 0.0) for v in (zeros, ones, _stay(zeros, ones, below)[1]))
            p, seen = _mixed_in(p, seen, z, o, s, x.bits)
            last = (key >> np.uint64(8 * depth)) << np.uint64(8)
            value = np.log10(shallow.value.mixed(p, seen, (last | symbol).astype(np.int64), x.bits)).sum(0)
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].astype(np.int64)), pa.array(value[i : i + (1 << 16)])], names=["gram", "value"])

    # A context's nodes two bytes deep come before its grams.
    own = deep.select(F.shiftleft(F.shiftrightunsigned("node", 8), two).alias("gram"), "node", F.col("zeros").cast("double").alias("zeros"), F.col("ones").cast("double").alias("ones"), "below", F.lit(0).alias("kind"))
    both = totals.withColumn("kind", F.lit(1)).unionByName(own, allowMissingColumns=True)
    both = both.repartition(F.shiftrightunsigned("gram", two)).sortWithinPartitions("gram", "kind").drop("kind")
    values = settle(both.mapInArrow(downward, "gram long, value double"))
    unsettle(deep)
    return values


def _scored(depth: int, n_tokens: int, n_distinct: int):
    """A mapper from rows sorted by chunk, each chunk's looked-up values first, to its documents' scores: grams (kind 0,
    value = log10 probability), words (kind 1, key = hash, value = training count), documents (kind 2)."""
    total = n_tokens + 0.5 * (n_distinct + 1)
    unseen = np.log10(0.5 / total)

    def scores(batch: pa.RecordBatch, of_gram: Table, of_word: Table) -> pa.RecordBatch:
        texts = _Texts(batch.column("text"))
        gram, off = grams(texts.body, texts.sizes, depth)
        score = np.add.reduceat(of_gram.of(gram), off[:-1])
        n = np.diff(texts.words)
        at = np.arange(len(n)) + texts.words[1:]  # of each text's end among the words and ends
        log = np.empty(len(texts.hashes) + len(n))
        log[at] = of_word.of(np.array([_END]))[0]
        log[np.setdiff1d(np.arange(len(log)), at, assume_unique=True)] = of_word.of(texts.hashes)
        first = texts.words[:-1] + np.arange(len(n))
        base, known = np.add.reduceat(log, first), np.add.reduceat((log > unseen).astype(np.int64), first)
        bits = -score * np.log2(10) / (texts.sizes + 1)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), n_tokens)), pa.array(base), pa.array(score), pa.array(bits)], names=_SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked, last, tables = {0: [], 1: []}, None, None
        for chunk, batch in _by_chunk(batches):
            if chunk != last:
                looked, last, tables = {0: [], 1: []}, chunk, None
            kind = batch.column("kind").to_numpy()
            for k in (0, 1):
                if (kind == k).any():
                    own = batch.filter(pa.array(kind == k))
                    looked[k].append((own.column("key").to_numpy().view(np.uint64), own.column("value").to_numpy()))
            if (kind == 2).any():
                if tables is None:
                    (key, value), (word, count) = ((np.concatenate(x) for x in zip(*looked[k], strict=True)) for k in (0, 1))
                    tables, looked = (Table(key, value), Table(word, np.log10((count + 0.5) / total))), {0: [], 1: []}
                for part in slices(iter([batch.filter(pa.array(kind == 2))]), "text", SLICE):
                    yield scores(part, *tables)

    return run


_SCORES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. held_out: a
    boolean column of docs; what it holds for is scored but not learned from. depth: of the context, 3 to 6 bytes."""
    if not _TOP <= depth <= 6:
        raise ValueError(f"depth is {_TOP} to 6, not {depth}")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts = min(chunks, PARTITIONS)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    place = F.pmod(F.col("chunk"), F.lit(parts))

    dealt = rows.select("chunk", (~F.col("held_out")).alias("train"), "text").repartitionById(parts, place)
    if parts < chunks:
        dealt = dealt.sortWithinPartitions("chunk")
    asked = settle(dealt.mapInArrow(_counted(depth), "chunk int, key long, word binary, n long"))
    words, grams_ = asked.where("word is not null"), asked.where("word is null").withColumnRenamed("key", "gram")

    # A word's rows, one for each chunk at most, get their sum; the first of them stands for the word.
    over = Window.partitionBy("word").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = words.withColumn("c", F.sum("n").over(over)).withColumn("one", F.row_number().over(Window.partitionBy("word").orderBy("chunk")) == 1)
    counts = settle(counts.select("chunk", "key", "c", "one"))
    tokens, distinct = counts.where("one").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).head()

    totals = settle(grams_.groupBy("gram").agg(F.sum("n").alias("n")))
    values = train(totals, depth)
    lookup = grams_.select("chunk", "gram").join(values, "gram").select("chunk", F.lit(0).alias("kind"), F.col("gram").alias("key"), "value")
    lookup = settle(lookup.unionByName(counts.select("chunk", F.lit(1).alias("kind"), "key", F.col("c").cast("double").alias("value"))))
    for done in (asked, totals, values, counts):
        unsettle(done)

    kind = rows.schema["id"].dataType.simpleString()
    both = rows.withColumn("kind", F.lit(2)).unionByName(lookup, allowMissingColumns=True)
    both = both.withColumn("turn", F.col("chunk") * F.lit(2).cast("long") + F.when(F.col("kind") == 2, 1).otherwise(0)).repartitionById(parts, place).sortWithinPartitions("turn")
    out = both.select("chunk", "kind", "id", "held_out", "text", "key", "value").mapInArrow(_scored(depth, tokens, distinct), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return out.withColumnRenamed("id", id_col)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)
