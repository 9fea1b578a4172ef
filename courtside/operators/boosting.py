"""Gradient boosting of binary classifiers on histograms, with missing values: several models, one a segment, in one go.

Features become bins once: a feature of few distinct values gets a bin for each, others quantile bins; bin 0 is for missing
values. A tree grows leaf by leaf, the one with the largest gain first. What a split needs is a histogram, sums of gradients
by (model, node, feature, bin): each task adds up its rows, Spark adds up the tasks' sums, finds every node's best split by
running sums over bins, tries missing values on both sides, and sends one row a node to the driver. Histograms are taken for
several nodes at a time, those of likely splits beforehand, so a tree needs about as many passes over the rows as it has
levels. Gradients are whole numbers of 1 / UNIT: sums are exact and don't depend on the order of rows, nor does a model.

Rows keep their scores in a written table, which is written anew every SETTLE trees; trees in between are added as rows are
read. What the driver and closures hold is bounded by the numbers of features, bins and leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.matches import discard, written

UNIT = 1 << 24
SETTLE = 10
#: Models trained in one go, at most: their histograms share a task's memory.
MODELS = 16


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root. left is -1 at leaves. Rows whose bin is at most `bin` go left, missing ones where
    missing_left says."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row. All rows take as many steps as the tree has levels; at a leaf they stay."""
        inner, here = self.left >= 0, np.arange(len(self.left))
        children = np.stack([np.where(inner, self.left, here), np.where(inner, self.right, here)], 1).ravel()
        least = np.where(self.missing_left, 0, 1).astype(np.uint16)  # bins from here to `bin` go left; a 0 below it wraps
        span = self.bin.astype(np.uint16) - least
        flat, start = np.ascontiguousarray(bins, np.uint16).ravel(), np.arange(len(bins)) * bins.shape[1]
        node, level = np.zeros(len(bins), np.int64), np.zeros(1, np.int64)
        while len(level := level[inner[level]]):
            beyond = flat[start + self.feature[node]] - least[node] > span[node]
            node = children[2 * node + beyond]
            level = np.concatenate([self.left[level], self.right[level]])
        return node


@dataclass
class Binning:
    """Upper bounds of each feature's bins; a bin holds values up to its bound, the last one all beyond."""

    features: list[str]
    upper: list[np.ndarray]

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint16)
        for i, (x, upper) in enumerate(zip(columns, self.upper, strict=True)):
            out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(upper, x) + 1)
        return out


    def only(self, i: int) -> Binning:
        return Binning([self.features[i]], [self.upper[i]])


@dataclass
class Boosted:
    """Models by the values of a segment column."""

    binning: Binning
    keys: list
    base: np.ndarray
    trees: list[list[Tree]]
    gains: list[np.ndarray] = field(default_factory=list)

    def probability(self, key: Column, features: dict[str, Column] | None = None) -> Column:
        """P(label 1) of a row with the binning's features, or with other values of theirs. A key that has no model is an
        error."""
        return self._udf()(self._model(key), *((features[c] if features else F.col(c)).cast("double") for c in self.binning.features))

    def probabilities(self, key: Column, others: dict[str, Column]) -> Column:
        """An array: probability() of a row, then with each of the other values in place of its own one at a time. Only
        trees that ask for a feature are walked again, and only by rows that it puts into another bin."""
        features, binning, base, trees = self.binning.features, self.binning, self.base, self.trees
        at = [features.index(c) for c in others]

        @F.pandas_udf("array<double>")
        def each(model: pd.Series, *columns: pd.Series) -> pd.Series:
            own, other = ([c.to_numpy(float) for c in part] for part in (columns[: len(features)], columns[len(features) :]))
            return pd.Series(list(scored_with(model.to_numpy(), binning.bins(own), at, [binning.only(i).bins([x])[:, 0] for i, x in zip(at, other, strict=True)], base, trees)))

        return each(self._model(key), *(F.col(c).cast("double") for c in features), *(x.cast("double") for x in others.values()))

    def _model(self, key: Column) -> Column:
        return F.coalesce(*(F.when(key == F.lit(k), F.lit(i)) for i, k in enumerate(self.keys)), F.raise_error(F.concat(F.lit("no model for "), F.coalesce(key.cast("string"), F.lit("null")))).cast("int"))

    def _udf(self):
        binning, base, trees = self.binning, self.base, self.trees

        @F.pandas_udf("double")
        def score(model: pd.Series, *columns: pd.Series) -> pd.Series:
            return pd.Series(scored(model.to_numpy(), binning.bins([c.to_numpy(float) for c in columns]), base, trees))

        return score


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def scored(model: np.ndarray, bins: np.ndarray, base: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    """Probabilities by each row's own model."""
    return sigmoid(_raised(base[model].astype(float), model, bins, trees))


def scored_with(model: np.ndarray, bins: np.ndarray, at: list[int], others: list[np.ndarray], base: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    """A row's probability, then with the bins of each of `others` in place of feature at[i]; sums as in scored()."""
    out = np.empty((len(model), 1 + len(at)))
    for m, own in enumerate(trees):
        rows = np.flatnonzero(model == m)
        here = bins[rows]
        values = [tree.value[tree.route(here)] for tree in own]
        out[rows] = sum(values, np.full(len(rows), float(base[m])))[:, None]
        for k, (f, other) in enumerate(zip(at, others, strict=True)):
            moved = np.flatnonzero(other[rows] != here[:, f])
            changed = here[moved]
            changed[:, f] = other[rows[moved]]
            score = np.full(len(moved), float(base[m]))
            for tree, value in zip(own, values, strict=True):
                score += tree.value[tree.route(changed)] if (tree.feature[tree.left >= 0] == f).any() else value[moved]
            out[rows[moved], k + 1] = score
    return sigmoid(out)


def _raised(score: np.ndarray, model: np.ndarray, bins: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    for m, own in enumerate(trees):
        rows = np.flatnonzero(model == m)
        for tree in own:
            score[rows] += tree.value[tree.route(bins[rows])]
    return score


def binned(df: DataFrame, features: list[str], most: int = 255) -> Binning:
    """At most `most` bins a feature: halfway between its distinct values if these are no more, else at quantiles. NaN counts
    as missing."""
    x = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"f{i}") for i, c in enumerate(features)))
    shares = [i / most for i in range(1, most)]
    # A sketch is one value of a task's buffer; approx_count_distinct keeps hundreds of columns a feature, which each row passes.
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), 12))
    known = x.agg(*(sketch(f"f{i}").alias(f"n{i}") for i in range(len(features)))).first()
    few = [i for i in range(len(features)) if (known[f"n{i}"] or 0) <= 1.2 * most]
    sets = x.agg(*(F.collect_set(f"f{i}").alias(f"s{i}") for i in few)).first() if few else None  # about 1.2 times `most` values at most
    values = {i: np.array(sorted(sets[f"s{i}"])) for i in few}
    many = [i for i in range(len(features)) if i not in values or len(values[i]) > most]  # only these pay for quantiles
    cuts = x.agg(*(F.percentile_approx(f"f{i}", shares, 20 * most).alias(f"q{i}") for i in many)).first() if many else None
    return Binning(features, [np.unique(np.array(cuts[f"q{i}"] or [], float)) if i in many else (values[i][1:] + values[i][:-1]) / 2 for i in range(len(features))])


def _prepared(binning: Binning, base: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binning.bins([np.asarray(batch.column(f"f{i}").to_numpy(zero_copy_only=False), float) for i in range(len(binning.features))])
            model = batch.column("model").to_numpy()
            ends = np.arange(len(bins) + 1, dtype=np.int32) * np.int32(2 * bins.shape[1])
            packed = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column("label"), packed, pa.array(base[model].astype(float))], names=["model", "label", "bins", "score"])

    return run


def _matrix(batch: pa.RecordBatch, n_features: int) -> np.ndarray:
    """The rows' bins, where Arrow has them: all rows have as many bytes, one after the other."""
    column = batch.column("bins").cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, n_features), np.uint16)
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int64)[column.offset]
    return np.frombuffer(data, np.uint16, len(column) * n_features, first).reshape(len(column), n_features)


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, of about `rows`, since each costs as much as its histograms have cells."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _rescored(trees: list[list[Tree]], n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _raised(batch.column("score").to_numpy().copy(), batch.column("model").to_numpy(), _matrix(batch, n_features), trees)
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(score))

    return run


def gradients(label: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, in whole numbers of 1 / UNIT."""
    p = sigmoid(score)
    return np.rint((p - label) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64)


def _histograms(pending: list[list[Tree]], growing: list[Tree], wanted: list[list[int]], widths: list[int]):
    """Sums of a task's rows by (model, node, feature, bin), of the wanted nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_features = len(widths)
        place = [np.full(len(t.left), -1) for t in growing]
        first = np.cumsum([0, *map(len, wanted)])
        for m, nodes in enumerate(wanted):
            place[m][nodes] = first[m] + np.arange(len(nodes))
        sums = [np.zeros((3, first[-1] * width), np.int64) for width in widths]
        for batch in _larger(batches):
            bins, model, label = _matrix(batch, n_features), batch.column("model").to_numpy(), batch.column("label").to_numpy()
            score = _raised(batch.column("score").to_numpy().copy(), model, bins, pending)
            node = np.full(len(model), -1)
            for m, tree in enumerate(growing):
                if wanted[m]:
                    rows = np.flatnonzero(model == m)
                    node[rows] = place[m][tree.route(bins[rows])]
            rows = np.flatnonzero(node >= 0)
            g, h = (x.astype(float) for x in gradients(label[rows], score[rows]))
            node = node[rows]
            for own, width, column in zip(sums, widths, bins[rows].T, strict=True):
                cell = node * width + column
                for s, weight in zip(own, (g, h, None), strict=True):
                    s += np.bincount(cell, weight, len(s)).astype(np.int64)  # whole numbers below 2^53 in a batch, so exact
        nodes = [(m, n) for m, own in enumerate(wanted) for n in own]
        model, node = (np.array([x[k] for x in nodes], np.int64) for k in (0, 1))
        for f, (own, width) in enumerate(zip(sums, widths, strict=True)):
            cell = np.flatnonzero(own[2])
            columns = [model[cell // width], node[cell // width], np.full(len(cell), f), cell % width]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), *(pa.array(s[cell]) for s in own)], names=["model", "node", "feature", "bin", "g", "h", "n"])

    return run


def best_splits(histograms: DataFrame, by: list[str], least_rows: int = 20, least_h: float = 1e-3, l2: float = 0.0) -> DataFrame:
    """Each group's best split from its histograms (by..., feature, bin, g, h, n): by..., g, h and n of the group, and split
    (gain, feature, bin, missing_left, and the left side's g, h and n), null where none is allowed. The largest gain wins,
    then the first feature, the first bin, and missing values to the right. A group's histograms, a row a feature and bin,
    meet in one task."""
    keys = ", ".join(by)
    sums = histograms.repartition(*by).groupBy(*by, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    one = f"over (partition by {keys}, feature)"
    running = [x for c in "ghn" for x in (f"sum({c}) over (partition by {keys}, feature order by bin) as {c}_upto", f"sum({c}) {one} as {c}_all", f"sum(if(bin = 0, {c}, 0)) {one} as {c}_none")]
    worth = lambda g, h: f"try_divide(({g} / {UNIT}) * ({g} / {UNIT}), {h} / {UNIT} + {l2!r})"

    def option(missing_left: bool) -> str:
        left = {c: f"({c}_upto - {c}_none)" if not missing_left else f"{c}_upto" for c in "ghn"}
        right = {c: f"({c}_all - {left[c]})" for c in "ghn"}
        gain = f"{worth(left['g'], left['h'])} + {worth(right['g'], right['h'])} - {worth('g_all', 'h_all')}"
        allowed = f"bin > 0 and least({left['n']}, {right['n']}) >= {least_rows} and least({left['h']}, {right['h']}) >= {least_h * UNIT!r}"
        return f"if({allowed}, struct(round({gain}, 9) as gain, -feature as f, -bin as b, {-int(missing_left)} as m, {', '.join(f'{left[c]} as {c}_left' for c in 'ghn')}), null)"

    x = sums.selectExpr(*by, "feature", "bin", *running)
    x = x.selectExpr(*by, "g_all", "h_all", "n_all", f"greatest({option(False)}, {option(True)}) as s")
    found = x.groupBy(*by).agg(F.max("s").alias("s"), *(F.max(f"{c}_all").alias(c) for c in "ghn"))
    return found.selectExpr(*by, "g", "h", "n", "if(s.gain > 0, struct(s.gain as gain, -s.f as feature, -s.b as bin, s.m = -1 as missing_left, s.g_left, s.h_left, s.n_left), null) as split")


class _Growing:
    """A tree that grows: its nodes, those of splits that may follow too. Active nodes are leaves so far."""

    def __init__(self):
        self.nodes, self.active, self.known = [{"split": None, "left": -1, "right": -1, "depth": 0}], {0}, set()

    def learn(self, node: int, row) -> None:
        self.known.add(node)
        own = self.nodes[node]
        own |= {"g": row.g, "h": row.h, "n": row.n}
        if row.split:
            own |= {"split": row.split, "left": len(self.nodes), "right": len(self.nodes) + 1}
            s = row.split
            for g, h, n in ((s.g_left, s.h_left, s.n_left), (row.g - s.g_left, row.h - s.h_left, row.n - s.n_left)):
                self.nodes.append({"split": None, "left": -1, "right": -1, "g": g, "h": h, "n": n, "depth": own["depth"] + 1})

    def expand(self, leaves: int, depth: int | None, least_rows: int) -> list[int]:
        """Splits leaves, the largest gain first, as long as all are known; the nodes whose histograms come next."""
        self.known |= {i for i, x in enumerate(self.nodes) if "n" in x and x["n"] < 2 * least_rows or x["depth"] == depth}
        while len(self.active) < leaves and not self.active - self.known:
            fit = [i for i in self.active if self.nodes[i]["split"]]
            if not fit:
                return []
            best = max(fit, key=lambda i: (self.nodes[i]["split"].gain, -i))
            self.active = self.active - {best} | {self.nodes[best]["left"], self.nodes[best]["right"]}
        if len(self.active) >= leaves:
            return []
        likely = sorted((i for i in self.active & self.known if self.nodes[i]["split"]), key=lambda i: -self.nodes[i]["split"].gain)[: leaves - len(self.active)]
        return sorted({*(self.active - self.known), *({self.nodes[i][k] for i in likely for k in ("left", "right")} - self.known)})

    def tree(self, rate: float = 1.0, l2: float = 0.0, final: bool = False) -> Tree:
        """All nodes so far; final: without splits that did not happen."""
        inner = lambda i: self.nodes[i]["split"] and not (final and i in self.active)
        of = lambda k, none: np.array([getattr(x["split"], k) if inner(i) else none for i, x in enumerate(self.nodes)])
        side = lambda k: np.array([x[k] if inner(i) else -1 for i, x in enumerate(self.nodes)])
        value = [-rate * (x["g"] / UNIT) / (x["h"] / UNIT + l2) if x.get("h") else 0.0 for x in self.nodes]
        return Tree(of("feature", 0).astype(int), of("bin", 0).astype(int), of("missing_left", False).astype(bool), side("left"), side("right"), np.array(value))

    def gains(self, n_features: int) -> np.ndarray:
        out, todo = np.zeros(n_features), [0]
        while todo:
            i = todo.pop()
            if i not in self.active and (s := self.nodes[i]["split"]):
                out[s.feature] += s.gain
                todo += [self.nodes[i]["left"], self.nodes[i]["right"]]
        return out


def _models(df: DataFrame, label: str, by: str) -> tuple[DataFrame, list, np.ndarray]:
    """Rows that can teach, the values of `by`, and each model's first score: the log odds of its labels."""
    rows = df.where(F.col(label).isNotNull() & F.col(by).isNotNull())
    known = rows.groupBy(by).agg(F.avg(F.col(label).cast("double")).alias("share")).orderBy(by).limit(MODELS + 1).collect()
    if len(known) > MODELS:
        raise ValueError(f"{by} has more than {MODELS} values")
    if not known:
        raise ValueError("no rows to learn from")
    share = np.clip([r.share for r in known], 1e-6, 1 - 1e-6)
    return rows, [r[by] for r in known], np.log(share / (1 - share))


def _source(rows: DataFrame, features: list[str], label: str, by: str, keys: list) -> DataFrame:
    number = F.coalesce(*(F.when(F.col(by) == F.lit(k), F.lit(i)) for i, k in enumerate(keys)))
    return rows.select(number.alias("model"), F.col(label).cast("double").alias("label"), *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)))


_TABLE = "model int, label double, bins binary, score double"


def first_splits(df: DataFrame, features: list[str], label: str, by: str, least_rows: int = 20, bins: int = 1000, l2: float = 0.0) -> DataFrame:
    """(by, feature, gain, upto, missing_left, n_left): for each model, what the first tree's first split would gain by each
    feature; upto is the largest value on the left. No row for a feature that can't split."""
    rows, keys, base = _models(df, label, by)
    binning = binned(rows, features, bins)
    widths = [len(u) + 2 for u in binning.upper]
    table = written(_source(rows, features, label, by, keys).mapInArrow(_prepared(binning, base), _TABLE))
    root = [_Growing().tree() for _ in keys]
    sums = table.mapInArrow(_histograms([[] for _ in keys], root, [[0] for _ in keys], widths), "model int, node int, feature int, bin int, g long, h long, n long")
    found = best_splits(sums.withColumn("of", F.col("feature")), ["model", "of"], least_rows, l2=l2).where("split is not null")
    bounds = df.sparkSession.createDataFrame([(f, b + 1, float(x)) for f, upper in enumerate(binning.upper) for b, x in enumerate(upper)], "of int, bin int, bound double")
    names = F.element_at(F.array(*map(F.lit, features)), F.col("of") + 1).alias("feature")
    key = F.element_at(F.array(*map(F.lit, keys)), F.col("model") + 1).alias(by)
    upto = F.coalesce("bound", F.lit(float("inf"))).alias("upto")  # beyond the last bound only missing values are apart
    return found.select("model", "of", "split.*").join(bounds, ["of", "bin"], "left").select(key, names, "gain", upto, "missing_left", F.col("n_left"))


def train(df: DataFrame, features: list[str], label: str, by: str, iterations: int = 100, rate: float = 0.1, leaves: int = 31, depth: int | None = None, least_rows: int = 20, bins: int = 255, l2: float = 0.0) -> Boosted:
    """One model for each value of `by` (a few). label: 0 or 1. The defaults are the usual ones of such learners; missing
    values need no filling. depth bounds a tree's levels, and with them the passes that it needs."""
    rows, keys, base = _models(df, label, by)
    binning = binned(rows, features, bins)
    widths, models, schema = [len(u) + 2 for u in binning.upper], range(len(keys)), _TABLE
    table = written(_source(rows, features, label, by, keys).mapInArrow(_prepared(binning, base), schema))
    trees, pending, gains = [[] for _ in models], [[] for _ in models], [np.zeros(len(features)) for _ in models]
    for k in range(iterations):
        growing, wanted = [_Growing() for _ in models], [[0] for _ in models]
        while any(wanted):
            sums = table.mapInArrow(_histograms(pending, [g.tree() for g in growing], wanted, widths), "model int, node int, feature int, bin int, g long, h long, n long")
            for r in best_splits(sums, ["model", "node"], least_rows, l2=l2).collect():  # a row a node
                growing[r.model].learn(r.node, r)
            for m, nodes in enumerate(wanted):
                growing[m].known |= set(nodes)
            wanted = [g.expand(leaves, depth, least_rows) for g in growing]
        for m, g in enumerate(growing):
            tree = g.tree(rate, l2, final=True)
            trees[m].append(tree)
            pending[m].append(tree)
            gains[m] += g.gains(len(features))
        if (k + 1) % SETTLE == 0 and k + 1 < iterations:
            before, table = table, written(table.mapInArrow(_rescored(pending, len(features)), schema))
            discard(before)
            pending = [[] for _ in models]
    discard(table)
    return Boosted(binning, keys, base, trees, gains)
