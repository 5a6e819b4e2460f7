"""Models of Spark ML over the corpus, and hooks for outside ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark grows trees to this depth at most; deeper settings are cut to it.
DEEPEST = 30


def tree_model(kind: str, depth: int = 8, trees: int = 20, seed: int = 42):
    depth = min(depth, DEEPEST)
    common = {"featuresCol": "features", "labelCol": "label", "seed": seed}
    if kind == "tree":
        return DecisionTreeClassifier(maxDepth=depth, **common)
    if kind == "forest":
        return RandomForestClassifier(maxDepth=depth, numTrees=trees, **common)
    return GBTClassifier(maxDepth=min(depth, 5), maxIter=trees, **common)


def held_out(df: DataFrame, key: str, share: int = 80) -> tuple[DataFrame, DataFrame]:
    h = F.pmod(F.xxhash64(key), F.lit(100))
    return df.where(h < share), df.where(h >= share)


def vector_guesses(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, label, guess of the held-out rows, by a tree model of ``label`` on ``embedding``. Boosting knows two classes: odd and even labels."""
    data = vectors.where("embedding is not null and label is not null").select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))
    if kind == "boosting":
        data = data.withColumn("label", (F.col("label") % 2).cast("double"))
    train, test = held_out(data, "vec_id")
    return tree_model(kind).fit(train).transform(test).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("guess"))


def accuracy(guesses: DataFrame) -> float:
    return guesses.agg(F.avg((F.col("label") == F.col("guess")).cast("double"))).first()[0]


def regression_guesses(df: DataFrame, key: str, features: list[str], label: str) -> DataFrame:
    """The held-out rows with ``guess``, of a linear regression fitted on the others."""
    train, test = held_out(df.dropna(subset=[*features, label]), key)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LinearRegression(labelCol=label)]).fit(train)
    return model.transform(test).drop("features").withColumnRenamed("prediction", "guess")


def predict(df: DataFrame, function: Callable[[pd.DataFrame], pd.Series], output: str, kind: str = "double") -> DataFrame:
    """Outside models: the function scores Arrow batches inside the tasks."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{output}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[output] = function(b)
            yield b

    return df.mapInPandas(run, schema)


def boundary_vector(scores, threshold: float = 0.5):
    """Ends from scores: 1 at the threshold or above, and always at the last position."""
    return F.transform(scores, lambda s, i: F.when((s >= threshold) | (i == F.size(scores) - 1), 1).otherwise(0))
