"""Two routed classifiers: matches with a top-10 player, and the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import FEATURES
from . import prep


def is_top_segment(r1: str = "player1_rank", r2: str = "player2_rank") -> Column:
    """Whether a side ranks in the top 10, on filled ranks; the complement is the other segment."""
    return (F.col(r1) <= 10) | (F.col(r2) <= 10)


def segments(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(is_top_segment()), df.where((F.col("player1_rank") > 10) & (F.col("player2_rank") > 10))


def vectors(df: DataFrame) -> DataFrame:
    """Model input: features in order as one vector, categories as codes, label 1.0 if player1 won."""
    codes = {c: S.surface_code(F.col(c)) for c in ("player1_preferred_surface", "player2_preferred_surface", "surface") if dict(df.dtypes)[c] == "string"}
    df = df.withColumns(codes).withColumns({c: F.col(c).cast("double") for c in FEATURES})
    df = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(df)
    return df.withColumn("label", F.when(F.col("result") == 1, 1.0).otherwise(0.0)) if "result" in df.columns else df


@dataclass
class Routed:
    """Two models and what rows need before them: the medians (a row) and scales (a row a feature) of what they learned."""

    top: GBTClassificationModel
    other: GBTClassificationModel
    medians: DataFrame
    scaling: DataFrame

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (features, not filled or scaled, with is_top) with the predicted result, 1 or 2, by segment. A row's
        prediction depends on no other row."""
        x = vectors(prep.scale(prep.fill_missing(rows, self.medians), prep.NUMERIC, self.scaling))
        parts = [m.transform(x.where(c)) for m, c in ((self.top, F.col("is_top")), (self.other, ~F.col("is_top")))]
        return parts[0].unionByName(parts[1]).withColumns({"predicted": F.when(F.col("prediction") == 1.0, 1).otherwise(2), "p_player1": vector_to_array("probability")[1]})


def _kept(df: DataFrame) -> DataFrame:
    """A frame of a few rows, computed now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def train(df: DataFrame, max_iter: int = 20, max_depth: int = 5, seed: int = 42) -> Routed:
    """df: pair features with result and is_top, not filled. Boosted trees, one model a segment."""
    medians = _kept(prep.medians(df, [c for c in prep.MEDIAN_FILLED if c in df.columns]))
    filled = prep.fill_missing(df, medians)
    scaling = _kept(prep.scale_parameters(filled, prep.NUMERIC))
    x = vectors(prep.scale(filled, prep.NUMERIC, scaling)).select("is_top", "features", "label").persist()  # each fit reads it several times
    fit = lambda part: GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=seed, maxBins=32).fit(part)
    try:
        return Routed(fit(x.where("is_top")), fit(x.where("not is_top")), medians, scaling)
    finally:
        x.unpersist()


def evaluate(predictions: DataFrame, label: str = "result", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 from the confusion counts; 0 where undefined."""
    by = by or []
    n = predictions.groupBy(*by, F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = n.select(*by, F.expr("inline(array(struct(l as c, n as support, 0L as called, if(l = p, n, 0L) as hit), struct(p as c, 0L as support, n as called, 0L as hit)))"))
    each = both.groupBy(*by, "c").agg(*(F.sum(k).alias(k) for k in ("support", "called", "hit")))
    p, r = S.ratio(F.col("hit"), F.col("called")), S.ratio(F.col("hit"), F.col("support"))
    each = each.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    weighted = [(F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(f"weighted_{k}") for k in ("precision", "recall", "f1")]
    return each.groupBy(*by).agg((F.sum("hit") / F.sum("support")).alias("accuracy"), *weighted)


def feature_values(spark: SparkSession, values: list[float], name: str = "importance") -> DataFrame:
    """What a model says of each of its inputs, as a frame of two columns."""
    return spark.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, values, strict=True)], f"feature string, {name} double")


def importances(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    return feature_values(spark, model.featureImportances.toArray())


def top_importances(frame: DataFrame, k: int = 10) -> DataFrame:
    return frame.orderBy(F.desc("importance"), "feature").limit(k)
