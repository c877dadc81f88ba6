"""Scorers of retrieved passages: callables from retr (qid, rank, p_id, score, table_id) to the same rows with `fused`.

`fused_sum` is the fixed one; `LearntScorer` is a logistic model over a passage's own score and what its table has
in the question's list. Any other callable of this form can be given to `pipeline.answer`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseek.operators.ranking import fused_scores

Scorer = Callable[[DataFrame], DataFrame]

#: What a passage is judged by.
FEATURES = ("score", "table_top", "table_mean", "table_share", "behind", "table_behind", "early")


def fused_sum(retr: DataFrame) -> DataFrame:
    return fused_scores(retr)


def with_features(retr: DataFrame) -> DataFrame:
    """FEATURES: the score; its table's best and mean; the table's share of the list; how far passage and table lie behind the list's best; the reciprocal of the rank."""
    table, whole = Window.partitionBy("qid", "table_id"), Window.partitionBy("qid")
    out = retr.withColumns({"table_top": F.max("score").over(table), "table_mean": F.avg("score").over(table), "n": F.count("*").over(table), "best": F.max("score").over(whole), "all": F.count("*").over(whole)})
    out = out.withColumns({"table_share": F.col("n") / F.col("all"), "behind": F.col("best") - F.col("score"), "table_behind": F.col("best") - F.col("table_top"), "early": 1 / F.col("rank")})
    return out.drop("n", "best", "all")


class LearntScorer:
    """A logistic model; `fused` is its probability that a passage's table answers the question."""

    def __init__(self, model: LogisticRegressionModel):
        self.model = model

    @classmethod
    def fit(cls, labelled: DataFrame, regularised: float = 1e-4) -> LearntScorer:
        """labelled: retr with label (0 or 1). Right and wrong passages weigh the same in total."""
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(labelled).withColumn("label", F.col("label").cast("double")))
        n, right = rows.agg(F.count("*"), F.sum("label")).first()
        if not n or not right or right == n:
            raise ValueError("a scorer needs right and wrong passages")
        weight = F.when(F.col("label") == 1, n / (2 * right)).otherwise(n / (2 * (n - right)))
        return cls(LogisticRegression(regParam=regularised, weightCol="weight", maxIter=50).fit(rows.select("features", "label", weight.alias("weight"))))

    def __call__(self, retr: DataFrame) -> DataFrame:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(retr))
        scored = self.model.transform(rows).withColumn("fused", vector_to_array("probability")[1])
        return scored.select(*retr.columns, "fused")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> LearntScorer:
        return cls(LogisticRegressionModel.load(path))
