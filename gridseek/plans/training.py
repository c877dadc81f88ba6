"""Training on questions that the collection asks of itself: rounds of sample, retrieve, label, fit and evaluate.

A round's tables lie in its folder below <work>/train, written one after the other, and its metric is written last, so a
round either has one or is run again from what it has; draws are md5 digits of a seed and a number, so a round that is
repeated asks the same. Texts are new to all rounds before, by the stored keys. Training stops at the round after
which `patience` rounds in a row brought no better precision."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseek.config import Config, discard, exists
from gridseek.operators import ranking
from gridseek.operators.scorer import LearntScorer
from gridseek.plans import pipeline


@dataclass(frozen=True)
class Round:
    number: int
    folder: str
    precision: float  # at 1, on the development questions


def _once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made unless it is there, whole."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _asked(spark: SparkSession, folder: str, rows: DataFrame, wanted: int, known: DataFrame | None, seed: str) -> tuple[DataFrame, DataFrame]:
    """`wanted` new questions and their tables, stored. The truth is written before the questions, which are the sign that both are there."""
    if not exists(spark, f"{folder}/questions/_SUCCESS"):
        asked, truth = pipeline.training_rounds(rows, wanted, known, seed)
        prefix = lambda df: df.withColumn("qid", F.concat(F.lit(f"{seed}-"), "qid"))
        prefix(truth).write.mode("overwrite").parquet(f"{folder}/truth")
        prefix(asked).write.mode("overwrite").parquet(f"{folder}/questions")
    return spark.read.parquet(f"{folder}/questions"), spark.read.parquet(f"{folder}/truth")


def labelled(spark: SparkSession, work: str, questions: DataFrame, truth: DataFrame, config: Config) -> DataFrame:
    """The passages of each question with label 1 where their table answers it; questions without both labels go, others are cut to a balance."""
    retr = pipeline.retrieve(spark, work, questions.select("qid", "question"), config)
    right = truth.select("qid", "table_id", F.lit(1).alias("label")).distinct()
    judged = retr.join(right, ["qid", "table_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    split = ranking.balanced_cap(ranking.split_by_label(judged), config.rel_num_train)
    chosen = split.select("qid", F.explode(F.concat("pos", "neg")).alias("p_id"))
    return judged.join(chosen, ["qid", "p_id"], "left_semi")


def train(spark: SparkSession, work: str, rounds: int = 10, config: Config = Config(), patience: int = 3, seed: str = "train", fit: Callable[[DataFrame], LearntScorer] = LearntScorer.fit, again: bool = False) -> tuple[LearntScorer, list[Round]]:
    """The scorer of the best round, and all rounds. Each asks config.train_incr_size new questions; config.dev_n others are for evaluation.

    fit: from labelled passages to a scorer with `save`; a run that was stopped goes on with its first unfinished round."""
    base = f"{work}/train"
    if again:
        discard(spark, base)
    rows = spark.read.parquet(f"{work}/rows")
    dev, dev_truth = _asked(spark, f"{base}/dev", rows, config.dev_n, None, f"{seed}-dev")
    keys, found, seen = dev.select("key"), None, []
    for number in range(rounds):
        folder = f"{base}/round-{number}"
        asked, truth = _asked(spark, folder, rows, config.train_incr_size, keys, f"{seed}-{number}")
        keys = keys.union(asked.select("key"))
        own = _once(spark, f"{folder}/examples", lambda a=asked, t=truth: labelled(spark, work, a, t, config))
        found = own if found is None else found.union(own)

        def measured(f: str = folder, all_found: DataFrame = found, n: int = number) -> DataFrame:
            scorer = fit(all_found)
            scorer.save(f"{f}/scorer")
            top = pipeline.answer(spark, work, dev.select("qid", "question"), config, scorer=scorer)
            right = pipeline.evaluate(top, dev_truth).filter("k = 1").select(F.col("precision").cast("double"))
            return right.select(F.lit(n).alias("round"), "precision")

        seen.append(Round(number, folder, _once(spark, f"{folder}/metric", measured).first()["precision"]))
        best = max(seen, key=lambda r: (r.precision, -r.number))
        if number - best.number >= patience:
            break
    return LearntScorer.load(f"{best.folder}/scorer"), seen


def newest(spark: SparkSession, work: str) -> LearntScorer | None:
    """The scorer of the best finished round of a working folder, if it has been trained."""
    done = []
    while exists(spark, f"{work}/train/round-{len(done)}/metric/_SUCCESS"):
        done.append(spark.read.parquet(f"{work}/train/round-{len(done)}/metric").first()["precision"])
    if not done:
        return None
    return LearntScorer.load(f"{work}/train/round-{done.index(max(done))}/scorer")
