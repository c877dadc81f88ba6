"""Order-dependent operators on retrieved lists: retr(qid, rank, p_id, score, table_id), rank from 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.functions.vectors import log_sigmoid


def ranked(scored: DataFrame, by: str = "score", key: str = "qid", tie: str = "p_id", top: int | None = None) -> DataFrame:
    """rank by falling score, ties to the smaller id; with `top`, the limit reaches the map side."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), tie)))
    return out if top is None else out.filter(F.col("rank") <= top)


def grouped_by_table(retr: DataFrame) -> DataFrame:
    """table_rank: tables in the order of their first passage; nth: a passage's place within its table; length: the table's passages."""
    per_table = Window.partitionBy("qid", "table_id")
    first = retr.withColumn("first", F.min("rank").over(per_table)).withColumn("nth", F.row_number().over(per_table.orderBy("rank"))).withColumn("length", F.count("*").over(per_table))
    return first.withColumn("table_rank", F.dense_rank().over(Window.partitionBy("qid").orderBy("first")))


def rebalanced(retr: DataFrame, top_n: int, min_tables: int = 5, keep: int = 3) -> DataFrame:
    """The first top_n, changed where fewer than min_tables tables are among them although the list has as many.

    Then the next tables get their first `keep` passages each, and room is made at the tail of the tables
    that were in, from the last of them up, none falling under `keep`. The output is grouped by table.
    Closed form: what a table loses is what the tables after it couldn't give."""
    g = grouped_by_table(retr)
    whole = Window.partitionBy("qid")
    g = g.withColumn("tables", F.max("table_rank").over(whole)).withColumn("t", F.max(F.when(F.col("rank") <= top_n, F.col("table_rank"))).over(whole))
    change = (F.col("t") < min_tables) & (F.col("tables") >= min_tables)
    is_in = F.col("table_rank") <= F.col("t")
    is_new = (F.col("table_rank") > F.col("t")) & (F.col("table_rank") <= min_tables)
    lead = F.col("nth") == 1  # one row stands for its table
    need = F.sum(F.when(lead & is_in, F.col("length"))).over(whole) + F.coalesce(F.sum(F.when(lead & is_new, F.least("length", F.lit(keep)))).over(whole), F.lit(0)) - top_n
    cap = F.greatest(F.col("length") - keep, F.lit(0))
    g = g.withColumn("need", need).withColumn("gives", F.when(lead & is_in, cap).otherwise(0))
    after = Window.partitionBy("qid").orderBy("table_rank").rangeBetween(1, Window.unboundedFollowing)
    g = g.withColumn("given", F.coalesce(F.sum("gives").over(after), F.lit(0)))
    lost = F.greatest(F.lit(0), F.least(cap, F.col("need") - F.col("given")))
    stays = F.when(is_in, F.col("nth") <= F.col("length") - lost).otherwise(is_new & (F.col("nth") <= keep))
    kept = g.filter(F.when(change, stays).otherwise(F.col("rank") <= top_n))
    order = Window.partitionBy("qid").orderBy(F.when(change, F.col("table_rank")).otherwise(0), "rank")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_n).select("qid", "place", "rank", "p_id", "score", "table_id")


def deepened(retr: DataFrame, top_n: int, max_retr: int, min_tables: int) -> DataFrame:
    """The first top_n of a list of max_retr, or all of it where top_n holds too few tables."""
    shallow = retr.filter(F.col("rank") <= top_n).groupBy("qid").agg(F.count_distinct("table_id").alias("n"))
    cut = F.when(F.col("n") < min_tables, max_retr).otherwise(top_n)
    return retr.join(shallow, "qid").filter(F.col("rank") <= cut).drop("n")


def top_tables(retr: DataFrame, n: int = 5) -> DataFrame:
    """(qid, place, table_id, score) of the first n distinct tables."""
    first = retr.groupBy("qid", "table_id").agg(F.min("rank").alias("first"), F.max("score").alias("score"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).filter(F.col("place") <= n).select("qid", "place", "table_id", "score")


def reranked(retr: DataFrame, new_score: str, top: int | None = None) -> DataFrame:
    """Ordered by another score; `score` stays that of the first stage."""
    out = retr.withColumn("was", F.col("rank")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(new_score), "p_id")))
    return out if top is None else out.filter(F.col("rank") <= top)


def table_max(features: DataFrame, vector: str = "features") -> DataFrame:
    """Each passage with `top`, the elementwise maximum over the passages of its table: one vector a passage is aggregated, not a row a component."""
    most = features.groupBy("qid", "table_id").agg(vector_to_array(Summarizer.max(array_to_vector(F.col(vector).cast("array<double>")))).alias("top"))
    return features.join(most, ["qid", "table_id"])


def mean_pooled(vectors: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """(key, mean): the mean of the vectors whose mask is 1, summed where they lie before they are shuffled; a key without any is left out."""
    used = vectors.filter(mask == 1)
    return used.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("mean"))


def ensemble(scores: DataFrame) -> DataFrame:
    """Mean over samples of the log sigmoid of the score: (qid, p_id, score)."""
    return scores.groupBy("qid", "p_id").agg(F.avg(log_sigmoid(F.col("score"))).alias("score"))


def table_scores(retr: DataFrame) -> DataFrame:
    """A table's score is its best passage's."""
    best = retr.groupBy("qid", "table_id").agg(F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "table_id")))


def fused_scores(retr: DataFrame, weight: float = 0.5) -> DataFrame:
    """A passage's score together with the best of its table."""
    top = F.max("score").over(Window.partitionBy("qid", "table_id"))
    return retr.withColumn("fused", F.col("score") + weight * top)


def mixed_label_questions(retr: DataFrame, label: Column) -> DataFrame:
    """Rows of the questions that have both a right and a wrong passage."""
    whole = Window.partitionBy("qid")
    lab = retr.withColumn("label", label.cast("int"))
    return lab.withColumns({"lo": F.min("label").over(whole), "hi": F.max("label").over(whole)}).filter("lo = 0 AND hi = 1").drop("lo", "hi")


def split_by_label(labelled: DataFrame) -> DataFrame:
    """(qid, pos, neg): passage ids in the order of rank; questions without either are left out."""
    side = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == v, F.struct("rank", "p_id")))), lambda x: x["p_id"])
    return labelled.groupBy("qid").agg(side(1).alias("pos"), side(0).alias("neg")).filter("size(pos) > 0 AND size(neg) > 0")


def balanced_cap(split: DataFrame, most: int = 100) -> DataFrame:
    """At most `most` passages, half of each kind, the rest of a short side given to the other."""
    half = most // 2
    over = F.size("pos") + F.size("neg") > most
    short_pos, short_neg = F.least(F.size("pos"), F.lit(half)), F.least(F.size("neg"), F.lit(half))
    n_pos = F.when(over, F.greatest(short_pos, F.least(F.size("pos"), most - short_neg))).otherwise(F.size("pos"))
    n_neg = F.when(over, F.greatest(short_neg, F.least(F.size("neg"), most - short_pos))).otherwise(F.size("neg"))
    return split.select("qid", F.slice("pos", F.lit(1), n_pos).alias("pos"), F.slice("neg", F.lit(1), n_neg).alias("neg"))


def one_positive(split: DataFrame, k: int) -> DataFrame:
    """The first positive and the first k negatives."""
    return split.select("qid", F.get("pos", F.lit(0)).alias("pos"), F.slice("neg", 1, k).alias("neg"))


def sampled_negatives(split: DataFrame, k: int, seed: str = "neg") -> DataFrame:
    """The first positive and k negatives drawn by md5 of seed, question and passage."""
    keyed = F.transform("neg", lambda p: F.struct(F.md5(F.concat_ws("/", F.lit(seed), F.col("qid").cast("string"), p.cast("string"))).alias("k"), p.alias("p")))
    drawn = F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["p"])
    return split.select("qid", F.get("pos", F.lit(0)).alias("pos"), drawn.alias("neg"))


def coreset(questions: DataFrame, worth: Column | Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
    """The n questions to train on. worth: a column, of which the most are taken, ties to the smaller qid; or a strategy, from
    the questions (qid among their columns) to those it chooses, of which the first n by its column `worth` are taken, or all if it gives none."""
    if isinstance(worth, Column):
        return questions.orderBy(F.desc(worth), "qid").limit(n)
    chosen = worth(questions)
    if "worth" not in chosen.columns:
        return questions.join(chosen.select("qid").distinct(), "qid", "left_semi")
    best = chosen.groupBy("qid").agg(F.max("worth").alias("worth")).orderBy(F.desc("worth"), "qid").limit(n)
    return questions.join(best.select("qid"), "qid", "left_semi")


def patience(history: DataFrame) -> DataFrame:
    """(step, metric, best, waited): steps since the last improvement. history: run, step, metric."""
    so_far = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    up = history.withColumn("better", F.col("metric") > F.coalesce(F.max("metric").over(so_far), F.lit(float("-inf"))))
    upto = Window.partitionBy("run").orderBy("step")
    last = F.max(F.when(F.col("better"), F.col("k"))).over(upto)
    return up.withColumn("k", F.row_number().over(upto)).withColumn("waited", F.col("k") - last).withColumn("best", F.max("metric").over(upto)).select("run", "step", "metric", "best", "waited")
