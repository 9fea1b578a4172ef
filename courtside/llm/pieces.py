"""Operator 8, exact SentencePiece BPE encoding by backtracking, and decoding.

Method. A tokenisation is the merge order's own exactly if each two neighbours survive re-merging (their joined text,
merged from characters, gives the same two pieces back). So encoding walks left to right: an Aho-Corasick automaton finds
every piece at every place; the longest is taken whose fit with the piece before it holds; where none is left, the place
is marked in a bitfield of failed positions (the encoding of a prefix is unique, so a place fails once and for all), the
last piece is given up and the next shorter one tried. Each piece is merged once, alone; whether two fit is told by going
through their merges together. Fits are remembered in a bounded table.

A text is cut before each run of the space mark and around new lines. No piece crosses such a place, so parts encode on
their own and are remembered in a bounded table. Pieces made of space marks alone have tied scores, outside the theorem;
parts that begin with several marks are merged directly by a heap. Characters without a piece become byte pieces.

Decoding goes through the ids of every text, whatever the text they came from was.

Defined cases: null text is empty; an empty text is the end id alone and decodes to ""; ids, texts and other columns may
repeat; other columns are not read. The tokenizer's file is read on the driver by the path given; workers get its bytes.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from math import inf
from pathlib import Path
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SPACE_MARK = "▁"
#: Bytes of known parts that a worker keeps and of the largest of them; pairs of tokens whose fit it keeps.
PARTS_KEPT, PART_KEPT, FITS_KEPT = 128 << 20, 4 << 10, 400_000


class BpePieces:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback and an identity normaliser."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, a leading space mark and no other normalisation is needed")
        kinds = pb.ModelProto.SentencePiece.Type
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_ids, self.byte_of = [bytes_[b] for b in range(256)], {i: b for b, i in bytes_.items()}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        unknown = proto.trainer_spec.unk_surface
        self.texts = ["" if p.type == kinds.CONTROL else unknown if p.type == kinds.UNKNOWN else p.piece.replace(SPACE_MARK, " ") for p in proto.pieces]
        for b, i in bytes_.items():  # None for a byte that is no character on its own
            self.texts[i] = chr(b) if b < 128 else None
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in self.scores):
            raise ValueError("a piece crosses a place where texts are cut")
        self._parts: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._held = 0
        self._fits: dict[int, bool] = {}
        self._histories: dict[int, tuple | None] = {}

    def merged(self, text: str, steps: list | None = None) -> list[int]:
        """The definition: neighbours merge by best score, the leftmost first among equals. steps: gets each merge's score,
        and the text's first and last symbol after it."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (joined := symbols[i] + symbols[after[i]]) in self.scores:
                heapq.heappush(queue, (-self.scores[joined], i, joined))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, joined = heapq.heappop(queue)
            if symbols[i] is None or (j := after[i]) >= n or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
            if steps is not None:
                steps.append((self.scores[joined], symbols[0], next(s for s in reversed(symbols) if s is not None)))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                out += [self.ids[s]] if s in self.ids else [self.byte_ids[b] for b in s.encode()]
        return out

    def _history(self, piece: int) -> tuple | None:
        """How a piece comes about from its characters: the scores of its merges in order, with an end below all scores, and
        its first and last symbol before each and at the end. None for a piece that its own text doesn't merge to."""
        text, steps = self.pieces[piece], []
        if self.merged(text, steps) == [piece]:
            found = (*(s[0] for s in steps), -inf), (text[0], *(s[1] for s in steps)), (text[-1], *(s[2] for s in steps))
        else:
            found = None
        self._histories[piece] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether the pieces a, b come back when their joined text is merged anew. Until symbols of both meet, each merges as
        it does alone, so their histories are gone through together: the better next merge comes first, the left one among
        equals, and a, b come back if the symbols that meet never make a better one."""
        if (known := self._fits.get(a << 32 | b)) is None:
            if len(self._fits) >= FITS_KEPT:
                self._fits.clear()
            known = self._fits[a << 32 | b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        histories = self._histories
        left = histories[a] if a in histories else self._history(a)
        right = histories[b] if b in histories else self._history(b)
        if left is None or right is None:
            return False
        (ours, _, last), (theirs, first, _), score = left, right, self.scores.get
        i = j = 0
        x, y = ours[0], theirs[0]
        meet = score(last[0] + first[0])
        while True:
            if meet is not None and meet > x and meet >= y:
                return False
            if x >= y:
                if x == -inf:
                    return True
                i += 1
                x = ours[i]
                if last[i] is not last[i - 1]:
                    meet = score(last[i] + first[j])
            else:
                j += 1
                y = theirs[j]
                if first[j] is not first[j - 1]:
                    meet = score(last[i] + first[j])

    def backtracked(self, text: str) -> list[int]:
        """Encodes a text in which every character has a piece and no two space marks meet."""
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, found in self.automaton.iter(text):
            at[last - found[0] + 1].append(found)
        failed = bytearray(n + 1)
        out: list[int] = []
        chosen: list[int] = []
        known, fits = self._fits, self.fits
        pos, k = 0, len(at[0]) - 1 if n else -1
        while pos < n:
            found, pair = at[pos], out[-1] << 32 if out else -1
            while k >= 0:
                size, piece = found[k]
                if not failed[pos + size]:
                    if pair < 0:
                        break
                    ok = known.get(pair | piece)
                    if fits(out[-1], piece) if ok is None else ok:
                        break
                k -= 1
            if k >= 0:
                out.append(piece)
                chosen.append(k)
                pos += size
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                failed[pos] = 1
                pos -= len(self.pieces[out.pop()])
                k = chosen.pop() - 1
        return out

    def part(self, text: str) -> list[int]:
        if text.startswith(SPACE_MARK * 2):
            return self.merged(text)
        if self.chars.issuperset(text):
            return self.backtracked(text)
        out: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.ids:
                out += self.backtracked(text[start:i]) if i > start else []
                out += [self.byte_ids[b] for b in c.encode()]
                start = i + 1
        return out + self.backtracked(text[start:]) if start < len(text) else out

    def joined(self, ids: list[int]) -> str:
        """The pieces' text with byte pieces decoded and space marks as spaces."""
        plain = [self.texts[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out: list[str] = []
        held = bytearray()
        for i, text in zip(ids, plain, strict=True):
            if text is None:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_lenient(held))
                held = bytearray()
            out.append(text)
        if held:
            out.append(_lenient(held))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        text = self.joined(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and first not in self.byte_of and self.pieces[first].startswith(SPACE_MARK) else text

    def _remember(self, text: str) -> bytes:
        """Known parts are of two ages; when the younger ones fill their half, the older ones go, so frequent parts stay. A
        part is kept with spaces, which take a byte where marks take two for each character, and with its ids alone."""
        known = self._older.get(text)
        if known is None:
            known = array("i", self.part(text.replace(" ", SPACE_MARK))).tobytes()
        held = 100 + getsizeof(text) + getsizeof(known)  # with the place in the table
        if held <= PART_KEPT:
            if self._held + held > PARTS_KEPT // 2:
                self._older, self._parts, self._held = self._parts, {}, 0
            self._parts[text] = known
            self._held += held
        return known

    def packed(self, text: str) -> tuple[bytes, str]:
        """The ids (32-bit, end id last) and what they decode to."""
        end = np.int32(self.end).tobytes()
        known, new = self._parts, self._remember
        done = []
        for p in _PARTS.findall(" " + text.replace(SPACE_MARK, " ")) if text else []:
            if (ids := known.get(p)) is None:
                ids = new(p)
                known = self._parts
            done.append(ids)
        ids = b"".join([*done, end])
        return ids, self.decode(memoryview(ids).cast("i").tolist())

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text)[0], np.int32).tolist()


_PARTS = re.compile(r" *[^ \n]+| +|\n")
_LOADED: dict[bytes, BpePieces] = {}


def _lenient(raw: bytearray) -> str:
    """UTF-8 with one replacement character for each byte that isn't part of a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + size].decode())
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def loaded(model: bytes) -> BpePieces:
    """One encoder per worker process and model."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = BpePieces(model)
    return _LOADED[model]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids array<int> (end id last), decoded string."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())  # a tokenizer's file: its size is the vocabulary's
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        for batch in slices(batches, "text", 2 << 20):
            done = [pieces.packed(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(x[0]) // 4 for x in done)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([x[0] for x in done]), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids, pa.array([x[1] for x in done], pa.string())], names=["id", "ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def public_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_model()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
