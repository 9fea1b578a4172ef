"""Operator 2, language identification: multinomial logistic regression on TF-IDF of character n-grams.

Features. Letters are lower-cased, everything else counts as one space, and n-grams of 1 to 3 characters are hashed into
2**15 buckets. A feature is the share of a text's n-grams in the bucket, times its inverse document frequency.

Training. Document frequencies come from every training text. The weights are fitted on a sample of at most SAMPLE texts for
each language, chosen by a hash of id and text, equal rows once (a documented bound; the rest of the training texts only
counts towards frequencies), by follow-the-regularised-leader steps with L1 and L2 penalties, which leaves the weights sparse. A fifth
of the sample is kept back to fit one temperature by which the logits are divided, so that scores are probabilities.

Prediction reads the text alone. The model (32,768 buckets for each language) is broadcast; its size depends on the
number of languages only: 0.13 MB each, and 0.5 MB each on the driver while it is fitted.

Defined cases: a text that is null or without a letter is `und` with score 0; without training texts all are `und`; ties
go to the first language in order; null labels teach nothing; null and repeated ids teach by their texts; repeated rows are judged row by row; very long texts are
read whole; empty tables work; other columns are carried and not read, those named like the two new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, hashed_sample, slices, small_batches, table

BUCKETS, SAMPLE, EPOCHS = 1 << 15, 1000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-3
SLICE = 128 << 10  # bytes of text that a worker holds as arrays at a time, at some 100 bytes a character


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each n-gram, the n+1 offsets of each text's, and whether a text has a letter."""
    text = [" " + (t or "").lower() + " " for t in texts]
    code = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(text)), [len(t) for t in text])
    letter = _letters()[code]
    has = np.bincount(owner, letter, len(text)) > 0
    code = np.where(letter, code, 32)
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
    code, owner = code[keep].astype(np.uint32), owner[keep]
    found, owners = [], []
    h = np.zeros(len(code), np.uint32)
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x9E3779B1) + (code[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA6B)
            same = owner[:m] == owner[n - 1 :]
            mixed = h ^ (h >> np.uint32(15))
            mixed = mixed * np.uint32(0xC2B2AE35)
            found.append((mixed >> np.uint32(17)).astype(np.int32)[same])
            owners.append(owner[:m][same])
    bucket, at = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    return bucket[order], np.searchsorted(at[order], np.arange(len(text) + 1)), has


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets by languages, with the inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        bucket, off, has = features(texts)
        sums = np.stack([np.add.reduceat(np.append(w[bucket], 0.0), off[:-1]) for w in self.weights.T], 1)
        logits = sums / np.maximum(np.diff(off), 1)[:, None] + self.bias
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, p.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts: in how many each bucket occurs."""
    df = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text", SLICE):
        texts = batch.column("text").to_pylist()
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            bucket, off, _ = features(part)
            there = np.zeros((len(part), BUCKETS), bool)
            there[np.repeat(np.arange(len(part)), np.diff(off)), bucket] = True
            df += there.sum(0)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], names=["bucket", "df"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's buckets and their shares."""
    for batch in slices(batches, "text", SLICE):
        bucket, off, _ = features(batch.column("text").to_pylist())
        out = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            own, n = np.unique(bucket[a:b], return_counts=True)
            out.append((own.astype(np.int32), (n / max(b - a, 1)).astype(np.float32)))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.float32()))], names=["lang", "order", "bucket", "share"])


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal steps, one for each text in turn."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def solve(rows: np.ndarray) -> np.ndarray:
        zr = z[rows]
        return np.where(np.abs(zr) <= L1, 0.0, -(zr - np.sign(zr) * L1) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for bucket, share, label in samples:
            rows, x = np.append(bucket, BUCKETS), np.append(share * idf[bucket], 1.0)
            w = solve(rows)
            error = softmax(x @ w)
            error[label] -= 1.0
            g = x[:, None] * error
            z[rows] += g - (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] += g * g
    w = solve(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """learn: a boolean column of docs, true where a row may teach."""
    rows = docs.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).alias("lang"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    df = np.zeros(BUCKETS)
    seen = rows.select("text").mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    with small_batches(docs.sparkSession):
        seen = seen.toArrow()  # one row a bucket
    df[seen.column("bucket").to_numpy()] = seen.column("df").to_numpy()
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    chosen = hashed_sample(rows, "lang", ["id", "text"], sample, counts).select("lang", "order", "text").mapInArrow(_vectors, "lang string, order long, bucket array<int>, share array<float>")
    with small_batches(docs.sparkSession):
        chosen = chosen.toArrow().combine_chunks()
    place = {lang: i for i, lang in enumerate(languages)}
    label, turn = np.array([place[x] for x in chosen.column("lang").to_pylist()], np.int64), chosen.column("order").to_numpy()
    lists = [chosen.column(c).combine_chunks() for c in ("bucket", "share")]
    off, (bucket, share) = lists[0].offsets.to_numpy(), (x.values.to_numpy() for x in lists)
    # Views into the collected arrays, in an order that doesn't depend on how rows arrive.
    found = [(bucket[off[i] : off[i + 1]], share[off[i] : off[i + 1]], int(label[i])) for i in np.lexsort((np.diff(off), label, turn)).tolist()]
    kept_back = found[::5] if len(found) >= 20 else []
    fitted = [x for i, x in enumerate(found) if i % 5] if kept_back else found
    weights, bias = fit(fitted, len(languages), idf)
    heat = 1.0
    if kept_back:
        heat = calibrated(np.stack([(s * idf[b]) @ weights[b] + bias for b, s, _ in kept_back]), np.array([x[2] for x in kept_back]))
    return LanguageModel(languages, (weights * idf[:, None]).astype(np.float32), bias, heat)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns: the language and its probability. Columns of docs with these names go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*({lang, score} - {text_col}))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE):
            best, p = shared.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(p, pa.float64())], names=[*names, lang, score])

    return docs.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = train(docs, ~held_out)
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
