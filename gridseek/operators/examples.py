"""Examples for readers and scorers: selection, routing, references, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.functions import text as T

from gridseek.functions.vectors import kl_divergence, softmax
from gridseek.operators.metrics import exact_match


def select_examples(picked: DataFrame, examples: DataFrame, passages: DataFrame) -> DataFrame:
    """(ord, question, target, ctxs): the examples of the picked ordinals with their passages attached in order.

    picked: ord, passage_ids; examples: ord, question, target; passages: p_id, title, text. A target in capitals becomes title case."""
    one = picked.join(examples, "ord").select("ord", "question", "target", F.posexplode("passage_ids").alias("k", "p_id")).join(passages, "p_id")
    target = F.when(F.col("target") == F.upper("target"), F.initcap("target")).otherwise(F.col("target"))
    nested = F.transform(F.array_sort(F.collect_list(F.struct("k", "title", "text"))), lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text")))
    return one.groupBy("ord", "question", target.alias("target")).agg(nested.alias("ctxs"))


def route(examples: DataFrame, mode: str) -> DataFrame:
    """The examples whose id starts with a mode; an id of neither train nor dev is an error."""
    kind = F.split("qid", "_")[0]
    known = F.when(kind.isin("train", "dev"), kind).otherwise(F.raise_error(F.concat(F.lit("an id of no known mode: "), F.col("qid"))))
    return examples.filter(known == mode)


def merged_references(lines: DataFrame, columns: list[str]) -> DataFrame:
    """(line, refs): references of a line joined by ` *# `. lines: line and one column for each file."""
    return lines.select("line", F.concat_ws(" *# ", *columns).alias("refs"))


def interleaved_references(lines: DataFrame, columns: list[str]) -> DataFrame:
    return lines.select("line", F.posexplode(F.array(*columns)).alias("k", "ref"))


def step_correctness(scored: DataFrame) -> DataFrame:
    """(step, qid, correct): whether the best table at each checkpoint is right. scored: step, qid, p_id, score, correct."""
    return scored.groupBy("step", "qid").agg(F.max(F.struct("score", (-F.col("p_id")).alias("i"), "correct")).getField("correct").alias("correct"))


def mean_exact_match(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.round(F.avg(exact_match(F.col("prediction"), F.col("references")).cast("double")), 6).alias("em"), F.count("*").alias("n"))


def coherent_answers(candidates: DataFrame) -> DataFrame:
    """(qid, em): the exact match of the candidate answer of best coherence. candidates: qid, cand, prediction, references, coherence."""
    em = exact_match(F.col("prediction"), F.col("references"))
    return candidates.groupBy("qid").agg(F.max(F.struct("coherence", (-F.col("cand")).alias("c"), em.alias("em"))).getField("em").alias("em"))


def attention_scores(attention: DataFrame) -> DataFrame:
    """(qid, p_id, score): attention summed over valid tokens, layers and heads, over their number; passages without a valid token have none. attention: qid, p_id, layer, head, token, valid, weight.

    A passage's tokens, layers and heads are sets that are filled in one pass: distinct counts would send each row once for each of them."""
    valid = F.col("valid") == 1
    many = lambda x: F.size(F.collect_set(x))
    out = attention.groupBy("qid", "p_id").agg(F.sum(F.when(valid, F.col("weight")).otherwise(0.0)).alias("s"), many(F.when(valid, F.col("token"))).alias("t"), many(F.col("layer")).alias("l"), many(F.col("head")).alias("h")).filter("t > 0")
    return out.select("qid", "p_id", F.round(F.col("s") / (F.col("t") * F.col("l") * F.col("h")), 6).alias("score"))


def distillation_loss(teacher: Column, student: Column, temperature: float, weight: float, target: Column) -> Column:
    """weight * T^2 * KL(teacher / T, student / T) + (1 - weight) * negative log-likelihood of the target's place (from 0)."""
    cooled = lambda a: softmax(F.transform(a, lambda x: x / temperature))
    return weight * temperature**2 * kl_divergence(cooled(teacher), cooled(student)) - (1 - weight) * F.log(F.get(softmax(student), target))


def smoothed_loss(logs: Column, target: Column, smoothing: float) -> Column:
    """Negative log-likelihood of the target's place (from 0) with some of its weight spread over all places; logs: log probabilities."""
    spread = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x)
    return -((1 - smoothing) * F.get(logs, target) + smoothing / F.size(logs) * spread)


def trimmed(tokens: Column, pad: int) -> Column:
    """Batches of token arrays without the places that hold padding in all of them."""
    last = F.array_max(F.transform(tokens, lambda t: F.array_max(F.transform(t, lambda x, i: F.when(x != pad, i + 1).otherwise(0)))))
    return F.transform(tokens, lambda t: F.slice(t, F.lit(1), last))


def latest_file(listing: DataFrame) -> DataFrame:
    """The path of the latest change. listing: path, modificationTime."""
    return listing.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def renumbered(kept: DataFrame, key: str = "p_id") -> DataFrame:
    """Gapless numbers from 0 in the order of the key."""
    from gridseek.sources.tables import dense_ids

    return dense_ids(kept, [key], "new_id", 0)


def renumbered_embeddings(embeddings: DataFrame, passages: DataFrame) -> DataFrame:
    """(new_id, p_id, table_id, row, embedding): the vectors (p_id, embedding) of some passages (p_id, table_id, row), together by table and row, numbered from 0 without gaps."""
    from gridseek.sources.tables import dense_ids

    joined = passages.select("p_id", "table_id", "row").join(embeddings.select("p_id", "embedding"), "p_id")
    return dense_ids(joined, ["table_id", "row", "p_id"], "new_id", 0).select("new_id", "p_id", "table_id", "row", "embedding")


def with_gold_delta(passages: DataFrame, gold: DataFrame) -> DataFrame:
    """passages (p_id, passage) with what the gold text (p_id, passage: the first passage and more) adds to them after the mark [G]; others stay as they are."""
    longer = gold.select("p_id", F.col("passage").alias("_gold"))
    more = F.when(F.startswith(F.col("_gold"), F.col("passage")), T.suffix_after(F.col("_gold"), F.col("passage")))
    joined = passages.join(longer, "p_id", "left").withColumn("_more", more)
    return joined.withColumn("passage", F.when(F.col("_more") != "", F.concat("passage", F.lit(" [G] "), "_more")).otherwise(F.col("passage"))).drop("_gold", "_more")


def gaussian_divergence(mean: Column, spread: Column, prior_mean: float = 0.0, prior_spread: float = 1.0) -> Column:
    """The Kullback-Leibler term of weights (arrays of means and standard deviations) against a normal prior: the sum over the weights."""
    one = lambda m, s: F.log(F.lit(prior_spread) / s) + (s * s + (m - prior_mean) * (m - prior_mean)) / (2 * prior_spread * prior_spread) - 0.5
    return F.aggregate(F.zip_with(mean, spread, one), F.lit(0.0), lambda total, x: total + x)


def bayesian_loss(loss: Column, divergence: Column, batches: Column) -> Column:
    """The loss of a batch with its share of the divergence."""
    return loss + divergence / batches


def graph_regulariser(vectors: DataFrame) -> DataFrame:
    """(qid, reg): mean inner product of the pairs of a question's table vectors; tables of one question are few."""
    from gridseek.functions.vectors import dot

    a, b = vectors.alias("a"), vectors.alias("b")
    pairs = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.table_id") < F.col("b.table_id")))
    return pairs.groupBy(F.col("a.qid").alias("qid")).agg(F.round(F.avg(dot(F.col("a.v"), F.col("b.v"))), 6).alias("reg"))
