"""Operator 13, best-fit packing of tokenised documents into sequences, by a linear grouping scheme.

Method. Documents become token ids with an end id; only longer ones than a sequence are cut. How many pieces have each
length (a histogram of `capacity` numbers at most, whatever the corpus) is all that the plan needs. Large pieces, over a
LARGE-th of a sequence, are put in order of length and cut into GROUPS groups of equal cardinality; each group's lengths are
rounded up to its largest. Few sizes remain, and the sequences' configurations of these are optimised as a linear
programme, its columns found by a knapsack over the dual prices. Its solution is rounded down, the groups' actual pieces
take the places, longest first, and all that is left, large or small, goes longest first into the fullest sequence that has
room for it, else a new one. Sequences that look alike are planned together, so the plan has some thousands of rows, each
for a range of pieces of one length.

Spark numbers the pieces of each length: hot lengths are dealt out in parts that are numbered apart and shifted, so no task
orders more than PART pieces; the plan, whose size only the capacity bounds, goes to every task, which looks up the
sequence and place of each piece.

Documents are encoded with the library. Where the tokenizer's own description says that it drops white space and splits
words, digits and other signs, the ids of parts between blanks, and of plain Latin words in them, are kept up to a bounded
number of bytes and put together; any other tokenizer gets whole texts.

Defined cases: null text is empty and gives one piece of the end id; repeated rows and ids are documents of their own; very
long texts are encoded part by part and cut into pieces as they come; an empty table gives an empty result; pack() keeps all
columns of its input, replaces those of the new names, and refuses lengths outside 1..capacity.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, slices, table, unsettle

CAPACITY, END = 4096, 1
LARGE, GROUPS, COLUMNS = 3, 256, 3000
#: Pieces of one length that a task numbers.
PART = 100_000
#: Bytes of text encoded at a time, of parts whose ids are kept, and of a part that is kept.
TEXT, KEPT, KEPT_PART = 1 << 20, 128 << 20, 64
_BLANK = re.compile("[ \t\n\r]+")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- token ids
# The parts of a tokenizer's file by which it drops white space, and splits words, digits and other signs.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: White space beside ASCII blanks; texts that hold some are cut at ASCII blanks only.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Parts that the split above surely cuts as _SIGNS does: ASCII without apostrophes, and Latin letters that have one code.
_SIMPLE = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SIGNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

#: Texts of such letters and ASCII alone, and how the split above cuts them once they are lower-cased.
_PLAIN = re.compile("[ \t\n\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ \t\n\ra-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Byte-level signs: a byte's own sign if it is printable, else one of those from 256 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers. Where a tokenizer is known to drop white space, those of short
    parts are remembered: what was used of late stays, in KEPT bytes. Other tokenizers get whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(self.library.to_str())
        self.blanks_drop = made["normalizer"] == _NORMALIZER and made["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in made["added_tokens"])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _library(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(parts, add_special_tokens=False)] if parts else []

    def _signs(self, signs: set[str]) -> dict[str, bytes]:
        """Takes in what the split can't cut any further; those that are too long to be kept are returned."""
        tokenize, old, made, long = self.library.model.tokenize, self.old, {}, {}
        for s in signs.difference(self.young):
            if (ids := old.get(s)) is None:
                found = [t.id for t in tokenize(s if s.isascii() else s.encode().decode("latin-1").translate(_BYTE_SIGNS))]
                ids = struct.pack(f"<{len(found)}I", *found)
            (made if len(s) <= KEPT_PART else long)[s] = ids
        self._keep(made)
        return long

    def _keep(self, found: dict[str, bytes]) -> None:
        self.young |= found
        self.held += 200 * len(found) + 4 * sum(map(len, found)) + sum(map(len, found.values()))

    def _learned(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts that `young` lacks; those that are too long to be kept are returned."""
        old, words, cuts, other = self.old, {}, {}, []
        for p in parts:
            if p in old:
                pass
            elif len(p) <= KEPT_PART and p.isascii() and p.isalpha():
                words[p] = p.lower()
            elif len(p) <= KEPT_PART and _SIMPLE.fullmatch(p) and "<|" not in p:
                cuts[p] = _SIGNS.findall(p.lower())
            else:
                other.append(p)
        self._keep({p: old[p] for p in parts & old.keys()})
        self._signs(set(words.values()).union(*cuts.values()))
        of = self.young.__getitem__
        self._keep({p: of(w) for p, w in words.items() if p != w} | {p: b"".join(map(of, c)) for p, c in cuts.items() if len(c) > 1 or c[0] != p})
        made = dict(zip(other, self._library(other), strict=True))
        self._keep({p: ids for p, ids in made.items() if len(p) <= KEPT_PART})
        return {p: ids for p, ids in made.items() if len(p) > KEPT_PART}

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some texts, which are held as parts meanwhile."""
        if not self.blanks_drop:
            return [np.frombuffer(ids, "<u4") for ids in self._library(texts)]
        if self.held > KEPT // 2:
            self.old, self.young, self.held = self.young, {}, 0
        split, signs, parts = [], set(), set()
        for t in texts:
            if "<|" not in t and _PLAIN.fullmatch(t):
                split.append(_WORDS.findall(t.lower()))
                signs.update(split[-1])
            else:
                split.append(_BLANK.split(t) if _OTHER_SPACE.search(t) else t.split())
                parts.update(split[-1])
        long, of = self._signs(signs) | self._learned(parts.difference(self.young)), self.young.get
        if not long:
            return [np.frombuffer(b"".join(map(of, x)), "<u4") for x in split]
        return [np.frombuffer(b"".join([long[p] if p in long else of(p) for p in x]), "<u4") for x in split]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(text: str) -> Iterator[str]:
    """A text in parts of about TEXT characters, cut at blanks."""
    start = 0
    while start < len(text):
        cut = _BLANK.search(text, start + TEXT) if start + TEXT < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def cut(parts: Iterator[np.ndarray], capacity: int, end: int) -> Iterator[np.ndarray]:
    """A document's ids, which come in parts, and the end id, in pieces of `capacity`; the last may be shorter."""
    rest = np.zeros(0, "<u4")
    for ids in itertools.chain(parts, [np.array([end], "<u4")]):
        rest = np.concatenate([rest, ids])
        whole = len(rest) // capacity * capacity
        for at in range(0, whole, capacity):
            yield rest[at : at + capacity]
        rest = rest[whole:]
    if len(rest):
        yield rest


def encoded(texts: list[str], encoder: Encoder) -> Iterator[Iterator[np.ndarray]]:
    """Ids of each text, in parts: short texts together, TEXT characters at a time, long ones alone and part by part."""
    run, held = [], 0
    for text in [*texts, None]:
        if run and (text is None or held + len(text) > TEXT):
            yield from ([ids] for ids in encoder.many(run))
            run, held = [], 0
        if text is not None and len(text) > TEXT:
            yield (encoder.many([part])[0] for part in (_texts(text) if encoder.blanks_drop else [text]))
        elif text is not None:
            run.append(text)
            held += len(text)


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices([batch], "text"):
                at, piece, start, found = [], [], [], []
                for i, parts in enumerate(encoded(some.column("text").to_pylist(), _encoder(path))):
                    before = 0
                    for k, ids in enumerate(cut(parts, capacity, end)):
                        at.append(i)
                        piece.append(k)
                        start.append(before)
                        found.append(ids.tobytes())
                        before += len(ids)
                ids = pa.array(found, pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pc.divide(pc.binary_length(ids), 4).cast(pa.int64()), ids], names=["id", "piece", "start", "length", "ids"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids): every document's pieces; ids are little-endian unsigned 32-bit numbers."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity, end), f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


# -- the plan
def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Which numbers of each size to put together, and how often: the fewest sequences, as a linear programme by column
    generation. sizes are distinct. After COLUMNS columns the solution so far is taken, which is feasible as well."""
    k, deepest = len(sizes), capacity // int(sizes.min())
    base = np.diag(capacity // sizes).astype(float)  # columns are configurations
    inverse, amount = np.diag(1 / np.diag(base)), need / np.diag(base)
    for _ in range(COLUMNS):
        price = inverse.sum(0)  # each configuration costs one sequence
        value, took = np.zeros(capacity + 1), []
        for _ in range(deepest):  # of one piece more at a time: what it is worth to fill so many places
            more, last = value.copy(), np.full(capacity + 1, -1)
            for i in np.flatnonzero(price > 0):
                tried = value[: capacity + 1 - sizes[i]] + price[i]
                better = tried > more[sizes[i] :] + 1e-12
                more[sizes[i] :][better], last[sizes[i] :][better] = tried[better], i
            if (last < 0).all():
                break
            value = more
            took.append(last)
        if value[-1] <= 1 + 1e-7 or amount.sum() * (1 - 1 / value[-1]) < max(0.5, 1e-5 * amount.sum()):
            break  # prices over value[-1] are dual feasible, so no solution can be much better
        column, c = np.zeros(k), capacity
        for last in reversed(took):
            if last[c] >= 0:
                column[last[c]] += 1
                c -= sizes[last[c]]
        way = inverse @ column
        ratio = np.where(way > 1e-9, amount / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        base[:, out] = column
        amount = amount - ratio[out] * way
        amount[out] = ratio[out]
        inverse[out] /= way[out]
        others = np.arange(k) != out
        inverse[others] -= np.outer(way[others], inverse[out])
    return [(base[:, j].astype(int), float(max(0, amount[j]))) for j in range(k)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Rows (length, first, count, sequence, offset): of the pieces of a length, numbered from 0, `count` from `first` on go
    one each to the sequences from `sequence` on, at that offset. And how many sequences there are."""
    left = dict(sorted(((n, c) for n, c in histogram.items() if c), reverse=True))
    used, rows, n_sequences = Counter(), [], 0
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free places: (sequence, count) of sequences alike

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        rows.append((length, used[length], count, sequence, offset))
        used[length] += count
        left[length] -= count

    # Groups of equal cardinality, longest first: (length, count) in each; a group's size is its first length.
    over = {n: c for n, c in left.items() if capacity // large < n < capacity}
    share, group, room = -(-sum(over.values()) // groups), [], 0
    for n, c in over.items():
        while c:
            if not room:
                group.append([])
                room = share
            take = min(c, room)
            group[-1].append([n, take])
            c, room = c - take, room - take
    merged: list[list] = []
    for g in group:  # groups of one size are one
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    if merged:
        sizes, need = np.array([g[0][0] for g in merged]), np.array([sum(c for _, c in g) for g in merged])
        for config, often in sorted(configurations(sizes, need, capacity), key=lambda x: -x[1]):
            places = [i for i, m in enumerate(config) for _ in range(m)]
            times = min([int(often + 1e-6), *(int(need[i]) // config[i] for i in set(places))]) if places else 0
            if not times:
                continue
            need -= config * times
            # Actual pieces take the places; sequences are alike where all their pieces are.
            alike = [(n_sequences, times, 0)]  # sequence, count, offset
            for i in places:
                after, g = [], merged[i]
                for sequence, count, offset in alike:
                    while count:
                        n, c = g[0]
                        take = min(c, count)
                        put(n, take, sequence, offset)
                        after.append((sequence, take, offset + n))
                        sequence, count = sequence + take, count - take
                        g[0][1] -= take
                        if not g[0][1]:
                            g.pop(0)
                alike = after
            for sequence, count, offset in alike:
                bins[capacity - offset].append((sequence, count))
            n_sequences += times

    # Best fit, longest first; what fits nowhere opens sequences.
    for n in list(left):
        free = n
        while left[n]:
            while free <= capacity and not bins[free]:
                free += 1
            if free > capacity:
                each = capacity // n
                if left[n] >= each:
                    count = left[n] // each
                    for k in range(each):
                        put(n, count, n_sequences, k * n)
                    bins[capacity - each * n].append((n_sequences, count))
                    n_sequences += count
                if left[n]:
                    bins[capacity].append((n_sequences, 1))
                    n_sequences, free = n_sequences + 1, capacity
                continue
            sequence, count = bins[free].pop()
            each = min(free // n, left[n])  # the fullest sequence takes all that it has room for
            some = min(count, left[n] // each)
            for k in range(each):
                put(n, some, sequence, capacity - free + k * n)
            bins[free - each * n].append((sequence, some))
            if some < count:
                bins[free].append((sequence + some, count - some))
            free = min(free, max(n, free - each * n))
    return np.array(sorted(rows), np.int64).reshape(-1, 5), n_sequences


# -- places of pieces
def _placed(starts: np.ndarray, sequence: np.ndarray, offset: np.ndarray):
    """A mapper that looks up pieces by (length, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("__length").to_numpy(), batch.column("__number").to_numpy()
            row = np.searchsorted(starts, (length << 48) + number, "right") - 1
            found = [sequence[row] + number - (starts[row] & ((1 << 48) - 1)), offset[row]]
            kept = [c for c in batch.schema.names if c not in ("__length", "__number")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *map(pa.array, found)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> DataFrame:
    """pieces with sequence_id and offset: sequences of `capacity` at most, gapless from 0."""
    length = F.col(length_col).cast("long")
    fits = F.when(length.between(1, capacity), length).otherwise(F.raise_error(F.concat(F.lit("no piece has length "), F.coalesce(length.cast("string"), F.lit("null")))).cast("long"))
    rows = settle(pieces.drop("sequence_id", "offset").withColumns({"__uid": F.monotonically_increasing_id(), "__length": fits}))
    counts = rows.groupBy("__length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["__length"]: r["n"] for r in counts.collect()}  # `capacity` rows at most
    found, _ = plan(histogram, capacity, large, groups)

    # Numbers within each length: within a part of it, shifted by the parts before.
    parts = {n: -(-c // PART) for n, c in histogram.items() if c > PART}
    deal = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for n, c in parts.items() for x in (n, c))), F.col("__length")), F.lit(1)) if parts else F.lit(1)
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64("__uid"), deal).cast("int"))
    numbered = dealt.withColumn("__place", F.row_number().over(Window.partitionBy("__length", "__part").orderBy("__uid")) - 1)
    sizes = rows.select("__length", F.pmod(F.xxhash64("__uid"), deal).cast("int").alias("__part")).groupBy("__length", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__length", "__part", (F.sum("n").over(Window.partitionBy("__length").orderBy("__part")) - F.col("n")).alias("__before"))
    numbered = numbered.join(before, ["__length", "__part"]).withColumn("__number", F.col("__place") + F.col("__before")).drop("__uid", "__part", "__place", "__before")
    schema = ", ".join(f"`{c}` {t}" for c, t in numbered.dtypes if c not in ("__length", "__number"))
    return numbered.mapInArrow(_placed((found[:, 0] << 48) + found[:, 1], found[:, 3], found[:, 4]), f"{schema}, sequence_id long, offset long")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizer())
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
