"""Pixel classification with pyspark.ml on the wide layout."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import all_present
from ..grid import GridMeta
from .vector import cells_of

UNAVAILABLE = ("tabnet", "ltae", "unet", "deeplabv3", "deeplabv3+", "fpn", "s2cloudless")


def estimator(name: str, **options) -> Estimator:
    """By name: random_forest, naive_bayes, mlp, logistic, kmeans, gaussian_mixture, bisecting_kmeans."""
    from pyspark.ml import classification, clustering

    made = {"random_forest": classification.RandomForestClassifier, "naive_bayes": lambda **o: classification.NaiveBayes(modelType="gaussian", **o), "mlp": classification.MultilayerPerceptronClassifier, "logistic": classification.LogisticRegression, "kmeans": clustering.KMeans, "gaussian_mixture": clustering.GaussianMixture, "bisecting_kmeans": clustering.BisectingKMeans}
    if name in UNAVAILABLE:
        raise NotImplementedError(f"{name} needs a deep-learning library; give its result as a band instead")
    return made[name](**options)


def is_unsupervised(est: Estimator) -> bool:
    return not est.hasParam("labelCol")


def with_labels(pixels: DataFrame, shapes: DataFrame, grid: GridMeta, column: str = "value") -> DataFrame:
    """targ: the value of the polygon on each pixel (greatest id of overlapping ones), NULL elsewhere."""
    burnt = cells_of(shapes, grid, False).groupBy("row", "col").agg(F.max_by(column, "id").alias("targ"))
    return pixels.join(burnt, ["row", "col"], "left")


def add_categorical(pixels: DataFrame, shapes: DataFrame, grid: GridMeta, column: str = "value", name: str = "cat1") -> DataFrame:
    """A polygon attribute as one more band."""
    return with_labels(pixels.drop("targ"), shapes, grid, column).withColumnRenamed("targ", name)


def fit(pixels: DataFrame, bands: list[str], est: Estimator, label: str | None = "targ") -> PipelineModel:
    """Labels of any type are numbered from 0 inside (StringIndexer, alphabetic) and from 1 in predictions."""
    stages = [VectorAssembler(inputCols=bands, outputCol="features", handleInvalid="skip")]
    rows = pixels
    if not is_unsupervised(est):
        rows = pixels.filter(F.col(label).isNotNull()).withColumn("__label", F.col(label).cast("string"))
        stages.append(StringIndexer(inputCol="__label", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"))
    return Pipeline(stages=[*stages, est]).fit(rows.dropna(subset=bands))


def predict(pixels: DataFrame, bands: list[str], model: PipelineModel) -> DataFrame:
    """Adds targ, the predicted class: the label itself, or clusters from 1; NULL where any band is missing."""
    labels = next((s.labels for s in model.stages if hasattr(s, "labels")), None)
    # filled copies go into the model, the bands themselves stay as they are
    filled = [f"__{b}" for b in bands]
    got = VectorAssembler(inputCols=filled, outputCol="features").transform(pixels.drop("targ").withColumns({n: F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for n, b in zip(filled, bands, strict=True)}))
    for s in model.stages[1:]:
        got = got if hasattr(s, "labels") else s.transform(got)
    name = F.get(F.lit(labels), F.col("prediction").cast("int")) if labels else (F.col("prediction") + 1).cast("int")
    return got.withColumn("targ", F.when(all_present(*bands), name)).select(*[c for c in pixels.columns if c != "targ"], "targ")


def fit_predict(pixels: DataFrame, bands: list[str], est: Estimator, label: str | None = "targ") -> DataFrame:
    return predict(pixels, bands, fit(pixels, bands, est, label))


def class_stats(df: DataFrame, bands: list[str], label: str = "targ") -> DataFrame:
    """label, n, and of each band the mean and population deviation over the samples of a class; unlabelled pixels have none."""
    held = df.filter(F.col(label).isNotNull())
    return held.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[f(b).alias(f"{b}_{name}") for b in bands for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def standardize(df: DataFrame, bands: list[str], label: str = "targ") -> DataFrame:
    """Bands less their mean, over their deviation plus 1e-8, both of the labelled samples; one row of statistics is joined to all pixels."""
    of = df.filter(F.col(label).isNotNull()).agg(*[f(b).alias(f"__{b}_{n}") for b in bands for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return df.crossJoin(F.broadcast(of)).select(*[((F.col(c) - F.col(f"__{c}_mean")) / (F.col(f"__{c}_std") + 1e-8)).alias(c) if c in bands else F.col(c) for c in df.columns])
