"""Learned scorers on Spark ML: substitutes for rankers and factorisations that Spark lacks.

A gradient-boosted classifier stands in for a list-wise boosted ranker, a
logistic regression on feature differences for a pairwise one, and implicit
ALS for a factorisation trained on sampled negatives. Losses differ, so
scores are comparable in rank only.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("qid", "pos", "cand", "label")


def feature_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in KEYS]


def _assembled(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=feature_columns(features), outputCol="__x").transform(features)


def gbt_ranker(train: DataFrame, test: DataFrame, rounds: int = 20, depth: int = 5, seed: int = 7) -> DataFrame:
    """qid, pos, cand, label, score of test by a boosted classifier of positives; score: its probability."""
    model = GBTClassifier(featuresCol="__x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.9, seed=seed).fit(_assembled(train))
    return model.transform(_assembled(test)).select(*KEYS, vector_to_array("probability")[1].alias("score"))


def pairwise_ranker(train: DataFrame, test: DataFrame, rounds: int = 30) -> DataFrame:
    """Scores by weights learned on differences between the positive and the other candidates of its query.

    Both signs of each difference are examples.
    """
    columns = feature_columns(train)
    best = train.where("label = 1").select("qid", *[F.col(c).alias(f"__{c}") for c in columns])
    pairs = train.where("label = 0").join(best, "qid")
    signed = pairs.withColumn("__s", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    signed = signed.select(((F.col("__s") + 1) / 2).alias("label"), *[(F.col("__s") * (F.col(f"__{c}") - F.col(c))).alias(c) for c in columns])
    model = LogisticRegression(featuresCol="__x", labelCol="label", maxIter=rounds, regParam=1e-3, fitIntercept=False, standardization=True).fit(
        VectorAssembler(inputCols=columns, outputCol="__x").transform(signed)
    )
    weights = [float(w) for w in model.coefficients]
    score = sum((F.col(c) * w for c, w in zip(columns, weights)), F.lit(0.0))
    return test.select(*KEYS, score.alias("score"))


def als_factors(history: DataFrame, queries: DataFrame, rank: int = 16, rounds: int = 5, seed: int = 7) -> DataFrame:
    """qid, pos, cand, label, score: products of implicit factors; what is unknown in training scores 0."""
    counts = history.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("float").alias("n"))
    model = ALS(userCol="src", itemCol="dst", ratingCol="n", implicitPrefs=True, rank=rank, maxIter=rounds, seed=seed, coldStartStrategy="nan").fit(counts)
    asked = queries.select(*KEYS, F.col("src").cast("int"), F.col("cand").cast("int").alias("dst"))
    return model.transform(asked).select(*KEYS, F.nanvl(F.col("prediction").cast("double"), F.lit(0.0)).alias("score"))


def ease_scores(history: DataFrame, queries: DataFrame, most_items: int = 500, ridge: float = 50.0) -> DataFrame:
    """qid, pos, cand, label, score by a linear item-to-item model in closed form, over the most_items commonest items.

    Only their Gram matrix (most_items squared entries) reaches the driver; items beyond score 0.
    """
    spark = history.sparkSession
    pairs = history.select("src", "dst").distinct()
    top = [r[0] for r in pairs.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(most_items).collect()]
    at = {d: i for i, d in enumerate(top)}
    kept = pairs.join(F.broadcast(spark.createDataFrame([(d,) for d in top], "dst long")), "dst")  # most_items rows
    gram = np.zeros((len(top), len(top)))
    for a, b, n in kept.alias("a").join(kept.alias("b"), "src").groupBy("a.dst", "b.dst").agg(F.count(F.lit(1))).collect():
        gram[at[a], at[b]] = n
    inverse = np.linalg.inv(gram + ridge * np.eye(len(top)))
    weights = -inverse / np.diag(inverse)
    np.fill_diagonal(weights, 0.0)
    links = spark.createDataFrame([(top[i], top[j], float(weights[i, j])) for i in range(len(top)) for j in range(len(top)) if i != j], "dst long, cand long, w double")
    asked = queries.select(*KEYS, "src")
    found = asked.select("src", "cand").distinct().join(links, "cand").join(kept, ["src", "dst"]).groupBy("src", "cand").agg(F.sum("w").alias("score"))
    return asked.join(found, ["src", "cand"], "left").select(*KEYS, F.coalesce("score", F.lit(0.0)).alias("score"))


def mean_reciprocal_rank(scores: DataFrame) -> DataFrame:
    """n, mrr; ties go to the smaller position."""
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pos")))
    first = ranked.where("label = 1").groupBy("qid").agg(F.min("r").alias("r"))
    return first.agg(F.count(F.lit(1)).alias("n"), F.avg(1 / F.col("r")).alias("mrr"))
