"""The three entries: index a collection, answer questions, and make labelled questions from the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseek.config import Config, Stages, discard
from gridseek.functions.udf import size_in_tokens
from gridseek.operators import gold, metrics, profile, ranking, retrieval, sqlgen, words
from gridseek.operators.scorer import Scorer, fused_sum
from gridseek.operators.triples import passages as passages_of
from gridseek.sources import sinks, tables


def import_tables(spark: SparkSession, root: str, work: str, again: bool = False) -> None:
    """CSV files -> rows, and the tables as JSON lines."""
    stages = Stages(spark, work)
    stages.run("rows", lambda: tables.read_csv_tables(spark, root).write.mode("overwrite").parquet(f"{work}/rows"), again)
    stages.run("tables", lambda: sinks.write_tables(spark.read.parquet(f"{work}/rows"), f"{work}/tables"), again)


def make_passages(spark: SparkSession, work: str, strategy: str = "RelationGraph", again: bool = False) -> None:
    """rows -> passages of a strategy. Rows are narrow work: chunks of a table need no stage of their own."""
    Stages(spark, work).run(f"passages/{strategy}", lambda: passages_of(spark.read.parquet(f"{work}/rows"), strategy).write.mode("overwrite").parquet(f"{work}/passages"), again)


def embed_passages(spark: SparkSession, work: str, again: bool = False, encoder=retrieval.hashing_encoder) -> None:
    def embeddings() -> None:
        p = spark.read.parquet(f"{work}/passages")
        sinks.write_checked(p.select("p_id", "table_id", encoder(F.col("passage")).alias("embedding")), f"{work}/embeddings")

    Stages(spark, work).run("embeddings", embeddings, again)


def index_embeddings(spark: SparkSession, work: str, again: bool = False) -> None:
    """embeddings -> lists; from a million vectors on with codes of what the lists' centroids leave of them."""

    def lists() -> None:
        e = spark.read.parquet(f"{work}/embeddings")
        options = retrieval.index_options(e.count())
        retrieval.coarse_centroids(e, options["lists"], options["train"]).write.mode("overwrite").parquet(f"{work}/centroids")
        assigned = retrieval.assign_lists(e, spark.read.parquet(f"{work}/centroids"))
        if options["codes"]:
            dim = len(e.first()["embedding"])
            assigned, books = retrieval.residual_codes(assigned, spark.read.parquet(f"{work}/centroids"), max(p for p in range(1, min(options["codes"], dim // 2) + 1) if dim % p == 0))
            books.write.mode("overwrite").parquet(f"{work}/codebooks")
        else:
            discard(spark, f"{work}/codebooks")  # of an earlier, larger index
        retrieval.write_lists(assigned, f"{work}/lists")

    Stages(spark, work).run("lists", lists, again)


#: The steps of indexing by name.
STEPS = ("import", "passages", "embeddings", "lists")


def index_collection(spark: SparkSession, root: str, work: str, config: Config = Config(), again: bool = False, encoder=retrieval.hashing_encoder, step: str | None = None) -> None:
    """CSV files -> rows -> passages -> embeddings -> lists, each a table in the working folder; finished stages are kept. step: only this one."""
    run = {
        "import": lambda: import_tables(spark, root, work, again),
        "passages": lambda: make_passages(spark, work, config.strategy, again),
        "embeddings": lambda: embed_passages(spark, work, again, encoder),
        "lists": lambda: index_embeddings(spark, work, again),
    }
    for name in STEPS if step is None else (step,):
        run[name]()


def retrieve(spark: SparkSession, work: str, questions: DataFrame, config: Config = Config(), encoder=retrieval.hashing_encoder) -> DataFrame:
    """(qid, rank, p_id, score, table_id) with the depth that min_tables asks for. questions: qid, question."""
    asked = questions.select("qid", encoder(F.col("question")).alias("q"))
    lists, centroids = spark.read.parquet(f"{work}/lists"), spark.read.parquet(f"{work}/centroids")
    if "codes" in lists.columns:
        deep = retrieval.coded_search(lists, centroids, spark.read.parquet(f"{work}/codebooks"), asked, config.max_retr, config.n_probe, refine=2)
    else:
        deep = retrieval.ivf_search(lists, centroids, asked, config.max_retr, config.n_probe)
    return ranking.deepened(deep, config.retr_top_n, config.max_retr, config.min_tables)


def index_words(spark: SparkSession, work: str, again: bool = False) -> None:
    """passages -> a stored word index beside the lists."""

    def write() -> None:
        words.write_index(spark.read.parquet(f"{work}/passages").select("p_id", "table_id", F.col("passage").alias("text")), f"{work}/words")

    Stages(spark, work).run("words", write, again)


def retrieve_by_words(spark: SparkSession, work: str, questions: DataFrame, config: Config = Config()) -> DataFrame:
    """As `retrieve`, by the stored word index."""
    deep = words.WordIndex(spark, f"{work}/words").search(questions.select("qid", F.col("question").alias("text")), config.max_retr)
    return ranking.deepened(deep, config.retr_top_n, config.max_retr, config.min_tables)


def answer(spark: SparkSession, work: str, questions: DataFrame, config: Config = Config(), encoder=retrieval.hashing_encoder, scorer: Scorer = fused_sum) -> DataFrame:
    """(qid, place, table_id, score): the tables that answer each question, five by default. scorer: see operators.scorer."""
    retr = retrieve(spark, work, questions, config, encoder)
    kept = ranking.rebalanced(retr, config.rel_num_test, config.min_tables)
    fused = scorer(kept.drop("rank").withColumnRenamed("place", "rank"))
    rescored = ranking.ranked(fused.drop("rank").withColumn("score", F.col("fused")))
    return ranking.top_tables(rescored, config.top_tables)


def with_rows(top: DataFrame, rows: DataFrame, first: int = 10) -> DataFrame:
    """The answer's tables with their header and first rows, to be shown."""
    shown = rows.filter(F.col("row") < first).join(top.select("table_id").distinct(), "table_id", "left_semi")
    body = shown.groupBy("table_id").agg(F.first("title").alias("title"), F.first("names").alias("names"), F.transform(F.array_sort(F.collect_list(F.struct("row", "vals"))), lambda x: x["vals"]).alias("rows"))
    return top.join(body, "table_id").select("qid", "place", "table_id", "title", "names", "rows", "score")


def evaluate(top: DataFrame, truth: DataFrame) -> DataFrame:
    """(k, precision) for k of 1 and 5. truth: qid, table_id."""
    right = truth.select("qid", "table_id", F.lit(1).alias("correct")).distinct()
    hits = top.join(right, ["qid", "table_id"], "left").select("qid", F.col("place").alias("rank"), "table_id", F.coalesce("correct", F.lit(0)).alias("correct"))
    return metrics.precision_at(hits, (1, 5))


def test_questions(spark: SparkSession, work: str, questions: DataFrame, config: Config = Config(), scorer: Scorer = fused_sum) -> tuple[DataFrame, DataFrame]:
    """The answers to questions (qid, question, table_id_lst) and their precision at 1 and 5."""
    top = answer(spark, work, questions.select("qid", "question"), config, scorer=scorer)
    return top, evaluate(top, questions.select("qid", F.explode("table_id_lst").alias("table_id")))


def training_rounds(rows: DataFrame, wanted: int, history: DataFrame | None = None, seed: str = "train") -> tuple[DataFrame, DataFrame]:
    """`wanted` queries of different texts, none of history (key): draws go on, each without what the ones before gave, until there are enough.

    Where four times as many draws as before bring nothing new, the tables have no more to ask: an error says how many there are."""
    found, gold_, known, have, draws, k, idle = None, None, history, 0, 0, 0, 0
    while have < wanted:
        draws = max(2 * (wanted - have) + 16, 2 * draws if idle else 0)
        asked, truth = training_questions(rows, draws, known, f"{seed}-{k}")
        asked, truth = asked.withColumn("qid", F.concat(F.lit(f"{k}-"), "qid")).persist(), truth.withColumn("qid", F.concat(F.lit(f"{k}-"), "qid"))
        new = asked.count()
        idle = 0 if new else idle + 1
        if idle == 3:
            raise ValueError(f"the tables give {have} different questions, {wanted} were asked for")
        have, k = have + new, k + 1
        found, gold_ = (asked, truth) if found is None else (found.union(asked), gold_.union(truth))
        known = asked.select("key") if known is None else known.select("key").union(asked.select("key"))
    first = found.orderBy("qid").limit(wanted)
    return first, gold_.join(first.select("qid"), "qid", "left_semi")


def training_questions(rows: DataFrame, draws: int, history: DataFrame | None = None, seed: str = "train") -> tuple[DataFrame, DataFrame]:
    """(questions: qid, question, key; truth: qid, table_id) sampled from the tables; history has the keys of earlier rounds."""
    head = rows.groupBy("table_id").agg(F.first("names").alias("names")).select("table_id", F.posexplode("names").alias("col", "col_name"))
    types = profile.column_types(profile.good_columns(head), tables.cells(rows))
    hi = profile.fences(tables.cells(rows).select(size_in_tokens(F.col("value")).alias("size"))).first()["hi"]
    fresh = sqlgen.new_queries(sqlgen.sample_queries(rows, types, draws, seed, hi), history)
    asked = sqlgen.verbalised(fresh, rows).join(fresh.select("qid", "key"), "qid")
    return asked, gold.gold_tables(fresh, rows)


def training_examples(retr: DataFrame, truth: DataFrame, most: int = 100) -> DataFrame:
    """(qid, pos, neg) of the questions that have both, capped in balance."""
    right = truth.select("qid", "table_id", F.lit(1).alias("label")).distinct()
    lab = retr.join(right, ["qid", "table_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return ranking.balanced_cap(ranking.split_by_label(lab), most)
