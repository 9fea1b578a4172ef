"""Missing values, encoders, imputation and scaling. Parameters are aggregates of the frame they are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..schema import NUMERIC, UNKNOWN, UNRANKED, UNSEEDED
from ..sources.matches import written

# What fills missing values of a split.
MEDIAN_FILLED = ["player1_age", "player2_age", "player1_ht", "player2_ht", "rank_diff", "log_rank_diff", "age_diff", "seed_diff", "height_diff"] + [f"player{i}_{k}_win_percentage" for k in ("last_5", "last_10", "surface_last_10") for i in (1, 2)]
TEXT_FILLED = {"player1": UNKNOWN, "player2": UNKNOWN, "player1_preferred_surface": UNKNOWN, "player2_preferred_surface": UNKNOWN, "player1_hand": "U", "player2_hand": "U"}
NUMBER_FILLED = {"result": -1, "surface_encoded": -1, "player1_seed": UNSEEDED, "player2_seed": UNSEEDED, "player1_rank": UNRANKED, "player2_rank": UNRANKED, "head_to_head_wins_p1": 0, "head_to_head_wins_p2": 0, "surface_preference_diff": 0}
FALSE_FILLED = ["top_10_vs_not", "young_vs_old", "seeded_vs_unseeded", "tall_vs_short", "left_vs_right", "same_hand", "player1_surface_match", "player2_surface_match"]


#: Values of a column that a task gathers for a median, and distinct texts that it puts in order.
GATHERED, VOCABULARY = 4096, 100_000
#: Share of the rows by which a bracket reaches from the place that is looked for; the quantiles' error is 1 / ACCURACY.
MARGIN, ACCURACY = 0.01, 1000


def at_places(df: DataFrame, places: list[tuple[str, int, int]], gathered: int = GATHERED) -> list[float]:
    """Exact order statistics: for each (column, place from 0, number of values) the value at that place, missing values left
    out. Rounds of approximate quantiles bracket each place, and counts tell what lies on the bounds and between them,
    until a bracket has `gathered` values or a bound is the value itself. df is read twice a round; a round leaves about 2 %."""
    low, high, below = [None] * len(places), [None] * len(places), [0] * len(places)
    left, found = [n for _, _, n in places], [None] * len(places)
    value = lambda i: F.col(f"`{places[i][0]}`").cast("double")

    def within(i: int):
        ok = value(i).isNotNull()
        ok = ok if low[i] is None else ok & (value(i) > low[i])
        return F.when(ok if high[i] is None else ok & (value(i) < high[i]), value(i))

    while open_ := [i for i in range(len(places)) if found[i] is None and left[i] > gathered]:
        shares = {i: [min(1.0, max(0.0, (places[i][1] - below[i]) / left[i] + m)) for m in (-MARGIN, MARGIN)] for i in open_}
        bounds = df.agg(*(F.percentile_approx(within(i), shares[i], ACCURACY).alias(f"q{i}") for i in open_)).first()
        counts = []
        for i in open_:
            a, b = bounds[f"q{i}"]
            counts += [F.count(F.when(within(i) < a, 1)).alias(f"a{i}"), F.count(F.when(within(i) == a, 1)).alias(f"b{i}"), F.count(F.when((within(i) > a) & (within(i) < b), 1)).alias(f"c{i}"), F.count(F.when(within(i) == b, 1)).alias(f"d{i}")]
        seen = df.agg(*counts).first()
        for i in open_:
            (a, b), place = bounds[f"q{i}"], places[i][1] - below[i]
            under, on, between, on_high = seen[f"a{i}"], seen[f"b{i}"], seen[f"c{i}"], seen[f"d{i}"] if a != b else 0
            if place < under:
                high[i], left[i] = a, under
            elif place < under + on:
                found[i] = a
            elif place < under + on + between:
                low[i], high[i], below[i], left[i] = a, b, below[i] + under + on, between
            elif place < under + on + between + on_high:
                found[i] = b
            else:
                low[i], below[i], left[i] = b, below[i] + under + on + between + on_high, left[i] - under - on - between - on_high
    if rest := [i for i in range(len(places)) if found[i] is None]:
        got = df.agg(*(F.get(F.array_sort(F.collect_list(within(i))), F.lit(places[i][1] - below[i])).alias(f"v{i}") for i in rest)).first()
        for i in rest:
            found[i] = got[f"v{i}"]
    return found


def medians(df: DataFrame, columns: list[str], gathered: int = GATHERED) -> DataFrame:
    """Exact medians, missing values left out: one row, null for a column without values. No task gathers more than
    `gathered` values of a column."""
    df = df.select(*(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in columns))
    n = df.agg(*(F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns))).first()
    places = [(c, place, n[i]) for i, c in enumerate(columns) if n[i] for place in sorted({(n[i] - 1) // 2, n[i] // 2})]
    values: dict[str, list[float]] = {}
    for (c, _, _), v in zip(places, at_places(df, places, gathered), strict=True):
        values.setdefault(c, []).append(v)
    return df.sparkSession.createDataFrame([[sum(v) / len(v) if (v := values.get(c)) else None for c in columns]], ", ".join(f"`{c}` double" for c in columns))


def impute(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Missing values from a one-row frame whose columns are named alike; columns missing there stay."""
    row = parameters.toDF(*(f"__{c}" for c in parameters.columns))
    filled = {c: F.coalesce(c, f"__{c}") for c in parameters.columns}
    return df.crossJoin(F.broadcast(row)).withColumns(filled).drop(*row.columns)


def fill_missing(df: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """The fill rules of a split, each applied to the columns that df has. parameters: medians of another frame (one row),
    else df's own. Differences were taken before, so a missing rank gives the median difference and not one against
    UNRANKED."""
    has = set(df.columns)
    df = df.fillna({c: v for c, v in TEXT_FILLED.items() if c in has}).fillna({c: v for c, v in NUMBER_FILLED.items() if c in has})
    df = df.fillna(False, [c for c in FALSE_FILLED if c in has])
    columns = [c for c in MEDIAN_FILLED if c in has]
    return impute(df, medians(df, columns) if parameters is None else parameters.select(columns))


def numeric_features(df: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """The columns as doubles; text that isn't a number becomes missing."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns({c: S.lenient_double(F.col(c)) if c in text else F.col(c).cast("double") for c in columns if c in df.columns})


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _leads(values: DataFrame, most: int) -> DataFrame:
    """values with lead, a beginning of the text, such that at most `most` distinct texts share one. Leads of too many grow
    by what all their texts share and one character more; those that grow at a time are one in `most` of the texts at most."""
    x = values.withColumn("lead", F.substring("value", 1, 1))
    while crowded := x.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b")).where(F.col("n") > most).collect():
        grown = values.sparkSession.createDataFrame([(r["lead"], _common(r.a, r.b) + 1) for r in crowded], "lead string, size int")
        x = written(x.join(F.broadcast(grown), "lead", "left").select("value", F.expr("if(size is null, lead, substring(value, 1, size))").alias("lead")))
    return x


def vocabulary(df: DataFrame, column: str, most: int = VOCABULARY) -> DataFrame:
    """(value, code): the column's distinct texts in order, a missing value as the text nan. Places are counted within texts
    of equal beginnings, of which at most `most` share one, and shifted by those before; only the beginnings meet in one task."""
    values = _leads(df.select(S.text_or_nan(F.col(column)).alias("value")).distinct(), most)
    leads = values.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    before = leads.select("lead", (F.sum("n").over(Window.orderBy("lead")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("lead").orderBy("value")) - 1
    return values.withColumn("place", place).join(before, "lead").select("value", (F.col("before") + F.col("place")).cast("int").alias("code"))


def encode(df: DataFrame, column: str, vocab: DataFrame, into: str | None = None) -> DataFrame:
    """The column's codes; a value that the vocabulary lacks is an error."""
    out = df.withColumn("__value", S.text_or_nan(F.col(column))).join(vocab.toDF("__value", "__code"), "__value", "left")
    code = F.coalesce("__code", F.raise_error(F.concat(F.lit(f"unseen value in {column}: "), "__value")).cast("int"))
    return out.withColumn(into or column, code).drop("__value", "__code")


def unseen(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """The column's distinct values that the vocabulary lacks."""
    return df.select(S.text_or_nan(F.col(column)).alias("value")).distinct().join(vocab, "value", "left_anti")


def require_seen(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    if bad := unseen(df, column, vocab).take(5):
        raise ValueError(f"unseen values in {column}: {[r.value for r in bad]}")
    return df


def scale_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column, in long form."""
    long = df.select(F.expr(f"stack({len(columns)}, {', '.join(f"'{c}', cast(`{c}` as double)" for c in columns)}) as (feature, value)"))
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def scale(df: DataFrame, columns: list[str], parameters: DataFrame | None = None) -> DataFrame:
    """z-scores; a constant column gives 0. parameters: from scale_parameters of another frame, else of df itself."""
    rows = (parameters if parameters is not None else scale_parameters(df, columns)).collect()  # one row a feature
    by = {r.feature: (r["mean"], r["std"] or 1.0) for r in rows}
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(by[c][0])) / F.lit(by[c][1]) for c in columns})
