"""Measures of retrieval and of text. hits: (qid, rank, table_id, correct 0/1), rank from 1."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.functions import text as T
from gridseek.functions.vectors import log_sigmoid


def precision_at(hits: DataFrame, ks: Sequence[int], tables: bool = True) -> DataFrame:
    """(k, precision): share of questions, in per cent, with a right one among the first k; by distinct tables in order of
    first appearance, or by passages."""
    if tables:
        first = hits.groupBy("qid", "table_id").agg(F.min("rank").alias("first"), F.max("correct").alias("correct"))
        hits = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("first")))
    best = hits.groupBy("qid").agg(F.min(F.when(F.col("correct") == 1, F.col("rank"))).alias("at"))
    at = best.select("qid", "at", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return at.groupBy("k").agg(F.round(100 * F.avg(F.when(F.col("at") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("precision"))


def hit_curve(hits: DataFrame, depth: int) -> DataFrame:
    """(k, questions): how many questions have a right passage among the first k."""
    first = hits.groupBy("qid").agg(F.min(F.when(F.col("correct") == 1, F.col("rank"))).alias("at"))
    per_k = first.groupBy("at").count()
    spots = hits.sparkSession.range(1, depth + 1).select(F.col("id").alias("k"))
    joined = spots.join(per_k, F.col("k") == F.col("at"), "left")
    return joined.select("k", F.sum(F.coalesce("count", F.lit(0))).over(Window.orderBy("k")).alias("questions"))


#: Answers, and their bytes, up to which all of them travel to the passages as one automaton.
ANSWERS, ANSWER_BYTES = 200_000, 16 << 20
_EDGE = "\x1f"


def _phrase(text: Column) -> Column:
    """The lower-case tokens, each between two marks, so that a phrase is a substring; null where there are none."""
    tokens = T.simple_tokens(F.lower(text))
    return F.when(F.size(tokens) > 0, F.concat(F.lit(_EDGE), F.array_join(tokens, _EDGE), F.lit(_EDGE)))


def _phrases_held(passages: DataFrame, phrases: DataFrame) -> DataFrame:
    """(p_id, phrase): which passages (p_id, text) hold which phrases (phrase), each passage read once."""
    held = phrases.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    # nulls stay: a filter of them would be pushed below the join that leaves the retrieved passages, and so mark all texts
    marked = passages.select("p_id", _phrase(F.col("text")).alias("text"))
    if held[0] <= ANSWERS and held[1] <= ANSWER_BYTES:
        known = passages.sparkSession.sparkContext.broadcast([r["phrase"] for r in phrases.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for p in known.value:
                machine.add_word(p, p)
            machine.make_automaton()
            for b in batches:
                at, found = [], []
                for i, text in enumerate(b.column(1)):
                    own = {p for _, p in machine.iter(text.as_py())} if len(known.value) and text.is_valid else ()
                    at += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=["p_id", "phrase"])

        return marked.mapInArrow(run, f"p_id {marked.schema['p_id'].dataType.simpleString()}, phrase string")
    # more phrases than travel: the passages' runs of as many tokens as some phrase has meet the phrases
    sizes = [r["n"] for r in phrases.select((F.size(F.split("phrase", _EDGE)) - 2).alias("n")).distinct().collect()]  # a row for each length
    tokens = F.split(F.col("text"), _EDGE)

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(2), F.size(tokens) - n), lambda i: F.concat(F.lit(_EDGE), F.array_join(F.slice(tokens, i, F.lit(n)), _EDGE), F.lit(_EDGE)))

    several = [F.when(F.size(tokens) - 2 >= n, runs_of(n)).otherwise(F.array().cast("array<string>")) for n in sizes]
    return marked.select("p_id", F.explode(F.array_distinct(F.flatten(F.array(*several)))).alias("phrase")).join(phrases, "phrase", "left_semi").select("p_id", "phrase")


def answered(retr: DataFrame, passages: DataFrame, answers: DataFrame) -> DataFrame:
    """retr with `correct`: 1 where the passage's text (p_id, text) holds one of the question's answers (qid, answers: array) as a run of whole tokens, whatever its case."""
    retr = retr.persist()  # read three times
    wanted = answers.select("qid", F.explode("answers").alias("answer")).select("qid", _phrase(F.col("answer")).alias("phrase")).filter("phrase IS NOT NULL").distinct()
    asked = passages.join(retr.select("p_id").distinct(), "p_id", "left_semi")
    held = _phrases_held(asked, wanted.select("phrase").distinct())
    right = retr.select("qid", "p_id").join(wanted, "qid").join(held, ["p_id", "phrase"]).select("qid", "p_id", F.lit(1).alias("correct")).distinct()
    return retr.join(right, ["qid", "p_id"], "left").withColumn("correct", F.coalesce("correct", F.lit(0)))


def exact_match(prediction: Column, references: Column) -> Column:
    """1 if some reference equals the prediction once both are normal."""
    return F.exists(references, lambda r: T.answer_normal(r) == T.answer_normal(prediction)).cast("int")


def rank_agreement(lists: DataFrame, k: int) -> DataFrame:
    """(qid, inversions, topk, depth): lists is (qid, place from 0, true_rank from 0).

    inversions: pairs in the wrong order; topk: share of the first k that belong there; depth: how far one must read for all of the true first k."""
    a, b = lists.alias("a"), lists.alias("b")
    wrong = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.place") < F.col("b.place")) & (F.col("a.true_rank") > F.col("b.true_rank"))).groupBy(F.col("a.qid").alias("qid")).agg(F.count("*").alias("inversions"))
    top = lists.groupBy("qid").agg(F.round(F.avg(F.when(F.col("place") < k, (F.col("true_rank") < k).cast("double"))), 6).alias("topk"), (F.max(F.when(F.col("true_rank") < k, F.col("place"))) + 1).alias("depth"))
    return top.join(wrong, "qid", "left").select("qid", F.coalesce("inversions", F.lit(0)).cast("long").alias("inversions"), "topk", "depth")


def _shared(hyp: list[str], ref: list[str], n: int) -> tuple[int, int, int]:
    """n-grams that two token lists share (as multisets), and how many each has."""
    a, b = (zip(*(x[i:] for i in range(n))) for x in (hyp, ref))
    left = Counter(a)
    hit = sum(min(m, left[g]) for g, m in Counter(b).items() if g in left)
    return hit, max(0, len(hyp) - n + 1), max(0, len(ref) - n + 1)


def _gram_counts(pairs: DataFrame, orders: list[tuple[int, int]]) -> DataFrame:
    """(sid, hn, rn, hit): how many n-grams hypothesis and reference have and how many they share, by order. pairs: sid, hyp and ref, each
    a list of token lists; orders: which list, and n. A pair is counted where it lies: no n-gram is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [[_shared(h[i], r[i], n) for i, n in orders] for h, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                hit, hn, rn = ([[x[j] for x in row] for row in found] for j in range(3))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in (hn, rn, hit))], names=["sid", "hn", "rn", "hit"])

    return pairs.select("sid", "hyp", "ref").mapInArrow(run, f"sid {pairs.schema['sid'].dataType.simpleString()}, hn array<long>, rn array<long>, hit array<long>")


def bleu4(pairs: DataFrame) -> DataFrame:
    """One row: bleu over all sentences. pairs: sid (unique), hyp, refs (array of texts). Counts are clipped by the reference that
    has most; the reference length is the closest, the shorter of two."""
    p = pairs.repartition("sid").select(T.words(F.col("hyp")).alias("h"), F.transform("refs", T.words).alias("rs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, own = [0] * 4, [0] * 4
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for h, rs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    h = h or []
                    for n in range(1, 5):
                        grams = lambda x: Counter(zip(*(x[i:] for i in range(n))))  # noqa: B023, E731
                        most: Counter = Counter()
                        for r in rs or []:
                            most |= grams(r or [])
                        mine = grams(h)
                        hit[n - 1] += sum(min(k, most[g]) for g, k in mine.items() if g in most)
                        own[n - 1] += max(0, len(h) - n + 1)
            yield pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(hit), pa.array(own)], names=["o", "hit", "all"])

    counted = p.mapInArrow(run, "o long, hit long, all long")
    mean = counted.groupBy("o").agg(F.sum("hit").alias("hit"), F.sum("all").alias("all")).filter("all > 0").agg(F.sum(F.log(F.col("hit") / F.col("all"))).alias("logs"), F.min("hit").alias("least"))
    closest = F.array_min(F.transform("rs", lambda r: F.struct(F.abs(F.size(r) - F.size("h")).alias("d"), F.size(r).alias("n"))))["n"]
    lengths = p.agg(F.sum(F.size("h")).alias("hl"), F.sum(closest).alias("rl"))
    penalty = F.when(F.col("hl") < F.col("rl"), 1 - F.col("rl") / F.col("hl")).otherwise(0.0)
    return mean.crossJoin(lengths).select(F.round(F.when(F.col("least") > 0, 100 * F.exp(F.col("logs") / 4 + penalty)).otherwise(0.0), 6).alias("bleu"), F.col("hl").cast("long").alias("hyp_words"), F.col("rl").cast("long").alias("ref_words"))


def chrf(pairs: DataFrame, char_n: int = 6, word_n: int = 2, beta: float = 2.0) -> DataFrame:
    """(sid, chrf): mean over character and word n-gram orders of precision and recall, as F-beta; the best of the references. pairs: sid (unique), hyp, refs."""
    base = pairs.repartition("sid").select("sid", "hyp", F.explode("refs").alias("ref")).filter("hyp IS NOT NULL AND ref IS NOT NULL")
    letters = lambda x: F.filter(F.split(F.regexp_replace(x, r"\s+", ""), ""), lambda t: t != "")
    none = F.array().cast("array<string>")
    lists = lambda x: F.array(F.coalesce(letters(F.col(x)), none), F.coalesce(T.words(F.col(x)), none)).alias(x)
    counted = _gram_counts(base.select("sid", lists("hyp"), lists("ref")), [(0, n) for n in range(1, char_n + 1)] + [(1, n) for n in range(1, word_n + 1)])
    either = counted.select("sid", F.filter(F.arrays_zip("hn", "rn", "hit"), lambda x: (x["hn"] > 0) | (x["rn"] > 0)).alias("x")).filter("size(x) > 0")

    def mean(n: str) -> Column:  # over the orders that this side has
        has = F.filter("x", lambda x: x[n] > 0)
        return F.when(F.size(has) > 0, F.aggregate(has, F.lit(0.0), lambda s, x: s + x["hit"] / x[n]) / F.size(has))

    both = either.select("sid", mean("hn").alias("p"), mean("rn").alias("r"))
    b = beta * beta
    f = F.when((F.col("p") > 0) & (F.col("r") > 0), 100 * (1 + b) * F.col("p") * F.col("r") / (b * F.col("p") + F.col("r"))).otherwise(0.0)
    return both.groupBy("sid").agg(F.round(F.max(F.coalesce(f, F.lit(0.0))), 6).alias("chrf"))


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """(sid, precision, recall, f1) of word n-grams against one reference: pairs is sid (unique), hyp, ref."""
    none = F.array().cast("array<string>")
    lists = lambda x: F.array(F.coalesce(T.words(F.lower(x)), none)).alias(x)
    both = _gram_counts(pairs.filter("hyp IS NOT NULL AND ref IS NOT NULL").repartition("sid").select("sid", lists("hyp"), lists("ref")), [(0, n)]).select("sid", *(F.col(k)[0].alias(k) for k in ("hn", "rn", "hit"))).filter("hn > 0 OR rn > 0")
    share = lambda k: F.when(F.col(k) > 0, F.col("hit") / F.col(k)).otherwise(0.0)
    p, q = share("hn"), share("rn")
    return both.select("sid", F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0), 6).alias("f1"))


def best_step(metrics: DataFrame) -> DataFrame:
    """The step of best p1, then p5, the earliest of equals: metrics is run, step, p1, p5."""
    return metrics.groupBy("run").agg(F.max(F.struct("p1", "p5", (-F.col("step")).alias("s"))).alias("m")).select("run", (-F.col("m.s")).alias("step"), "m.p1", "m.p5")


def weighted_average(parts: DataFrame, by: str) -> DataFrame:
    return parts.groupBy(by).agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))


def bce_loss(scores: DataFrame) -> DataFrame:
    """(qid, loss): mean binary cross-entropy of scores (logits) against labels."""
    x, y = F.col("score"), F.col("label")
    return scores.groupBy("qid").agg(F.round(-F.avg(y * log_sigmoid(x) + (1 - y) * log_sigmoid(-x)), 6).alias("loss"))


def listwise_loss(scores: DataFrame) -> DataFrame:
    """(qid, loss): -log of the softmax share of the right passages."""
    top = F.max("score").over(Window.partitionBy("qid"))
    e = scores.withColumn("e", F.exp(F.col("score") - top))
    return e.groupBy("qid").agg(F.round(-F.log(F.sum(F.when(F.col("label") == 1, F.col("e"))) / F.sum("e")), 6).alias("loss"))
