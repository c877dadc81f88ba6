"""Stored indexes (lists with codes, words), scorers and the training loop."""

import random

import pytest
from pyspark.sql import functions as F

from gridseek.config import Config
from gridseek.operators import growing, retrieval, scorer, words
from gridseek.plans import catalogue as c
from gridseek.plans import pipeline, training


@pytest.fixture(scope="module")
def lists(spark, data):
    return c.stored_lists(spark, data, 16, parts=32)


@pytest.fixture(scope="module")
def asked(spark, data):
    return c.vector_questions(spark, data).select("qid", "q").persist()


@pytest.fixture(scope="module")
def exact(spark, data, asked):
    return {(r.qid, r.p_id) for r in retrieval.flat_knn(c.vectors(spark, data), asked, 10).collect()}


def test_a_probe_reads_its_lists_and_shuffles_none(spark, lists, asked, capsys):
    stored, centroids, _ = lists
    one = asked.limit(1)
    retrieval.ivf_search(stored, centroids, one, 10, 2).explain("formatted")
    plan = capsys.readouterr().out
    probed = sorted(r["list"] for r in retrieval.probes_of(one, centroids, 2).collect())
    assert "PartitionFilters: [list" in plan and len(probed) == 2 and all(str(x) in plan.split("PartitionFilters: [")[1].split("]")[0] for x in probed)
    assert plan.count("Exchange") // 2 <= 1  # the ranking by question alone
    assert len(stored.filter(F.col("list").isin(probed)).inputFiles()) > 0


def test_partial_probes_and_codes_find_nine_in_ten(lists, asked, exact):
    stored, centroids, books = lists
    by_vector = {(r.qid, r.p_id) for r in retrieval.ivf_search(stored, centroids, asked, 10, 12).collect()}
    by_code = {(r.qid, r.p_id) for r in retrieval.coded_search(stored, centroids, books, asked, 10, 12).collect()}
    assert len(by_vector & exact) >= 0.9 * len(exact) and len(by_code & exact) >= 0.9 * len(exact)
    whole = {(r.qid, r.p_id) for r in retrieval.coded_search(stored, centroids, books, asked, 10, 16, refine=16).collect()}
    assert whole == exact


def test_codes_order_passages_by_themselves(lists, asked, exact):
    """Without measuring again more than is returned: what the codes alone find."""
    stored, centroids, books = lists
    found = {(r.qid, r.p_id) for r in retrieval.coded_search(stored, centroids, books, asked, 10, 16, refine=1).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_many_probes_meet_their_lists_in_cells(lists, asked, monkeypatch):
    stored, centroids, books = lists
    want = [sorted(f.collect()) for f in (retrieval.ivf_search(stored, centroids, asked, 10, 5), retrieval.coded_search(stored, centroids, books, asked, 10, 5, 2))]
    monkeypatch.setattr(retrieval, "PROBES", -1)
    assert [sorted(f.collect()) for f in (retrieval.ivf_search(stored, centroids, asked, 10, 5), retrieval.coded_search(stored, centroids, books, asked, 10, 5, 2))] == want


def test_a_large_index_is_searched_by_codes(spark, data, tmp_path, monkeypatch):
    work = str(tmp_path)
    c.vectors(spark, data).write.parquet(f"{work}/embeddings")
    monkeypatch.setattr(retrieval, "index_options", lambda n: {"lists": 8, "codes": 32, "train": n})
    pipeline.index_embeddings(spark, work)
    assert "codes" in spark.read.parquet(f"{work}/lists").columns
    used = []
    search = retrieval.coded_search
    monkeypatch.setattr(retrieval, "coded_search", lambda *a, **k: used.append(1) or search(*a, **k))
    questions = c.vector_questions(spark, data).select("qid", F.col("q").alias("question")).limit(3)
    got = pipeline.retrieve(spark, work, questions, Config(retr_top_n=10, max_retr=20, min_tables=2), encoder=lambda q: q)
    assert used and got.groupBy("qid").count().filter("count >= 10").count() == 3


# ---- words


def test_word_index(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(words, "PER_BLOCK", 8)
    passages = c.load(spark, data, "documents").select(F.col("doc_id").alias("p_id"), F.col("source").alias("table_id"), "text")
    odd = spark.createDataFrame([(90_001, "s", None), (90_002, None, ""), (90_003, "s", "!! ,,")], "p_id long, table_id string, text string")
    passages = passages.union(odd)
    questions = c.load(spark, data, "benchmark").select(F.col("item_id").alias("qid"), "text").union(spark.createDataFrame([(-1, None), (-2, "nowherefound"), (-3, "")], "qid long, text string"))
    words.write_index(passages, str(tmp_path))
    index = words.WordIndex(spark, str(tmp_path))
    for k in (3, 50):
        got, judged = index.search_in_steps(questions, k)
        assert sorted(map(tuple, got.select("qid", "rank", "p_id", "score").collect())) == sorted(map(tuple, retrieval.bm25(passages, questions, k).select("qid", "rank", "p_id", "score").collect()))
        if k == 3:
            read = {r["read"]: r["count"] for r in judged.groupBy("read").count().collect()}
            assert read[False] > 0.2 * sum(read.values())


def test_word_index_of_no_passages(spark, tmp_path):
    none = spark.createDataFrame([], "p_id long, table_id string, text string")
    words.write_index(none, str(tmp_path))
    assert words.WordIndex(spark, str(tmp_path)).search(spark.createDataFrame([(1, "a b")], "qid int, text string"), 5).count() == 0


# ---- scorers


def lists_of(seed, n):
    """Right tables have many good passages, wrong ones a single best one at times."""
    rng, out = random.Random(seed), []
    for q in range(n):
        right, rows = rng.randrange(8), []
        for t in range(8):
            rows += [(rng.gauss(1.0 if t == right else 0.3, 0.3), t) for _ in range(10 if t == right else 4)]
            if t != right and rng.random() < 0.5:
                rows.append((rng.gauss(2.2, 0.3), t))
        rows.sort(reverse=True)
        out += [(q, i + 1, i, float(s), t, int(t == right)) for i, (s, t) in enumerate(rows)]
    return out


def test_a_learnt_scorer_beats_the_sum(spark, tmp_path):
    schema = "qid int, rank int, p_id int, score double, table_id int, label int"
    learnt = scorer.LearntScorer.fit(spark.createDataFrame(lists_of(1, 150), schema))
    learnt.save(f"{tmp_path}/m")
    held = spark.createDataFrame(lists_of(2, 100), schema)

    def right(by):
        scored = by(held.drop("label")).withColumnRenamed("score", "was").withColumn("score", F.col("fused"))
        top = pipeline.ranking.top_tables(pipeline.ranking.ranked(scored.drop("rank")), 1)
        return top.join(held.filter("label = 1").select("qid", "table_id").distinct(), ["qid", "table_id"]).count()

    got = right(scorer.LearntScorer.load(f"{tmp_path}/m"))
    assert got > right(scorer.fused_sum) and got >= 80
    with pytest.raises(ValueError, match="right and wrong"):
        scorer.LearntScorer.fit(held.filter("label = 1"))


# ---- the training loop


@pytest.fixture(scope="module")
def work(spark, data, tmp_path_factory):
    work = str(tmp_path_factory.mktemp("work"))
    c.customer_tables(spark, data).write.parquet(f"{work}/rows")
    pipeline.make_passages(spark, work, "row")
    pipeline.embed_passages(spark, work)
    pipeline.index_embeddings(spark, work)
    return work


def test_training_goes_on_where_it_was_stopped(spark, work):
    config = Config(train_incr_size=16, dev_n=8, retr_top_n=20, max_retr=40, rel_num_train=20, rel_num_test=20, min_tables=3)
    calls = []

    def stops_once(labelled):
        calls.append(labelled.select("qid").distinct().count())
        if len(calls) == 2:
            raise RuntimeError("lost")
        return scorer.LearntScorer.fit(labelled)

    assert training.newest(spark, work) is None
    with pytest.raises(RuntimeError, match="lost"):
        training.train(spark, work, 2, config, fit=stops_once)
    first = spark.read.parquet(f"{work}/train/round-0/questions").collect()
    _, rounds = training.train(spark, work, 2, config, fit=stops_once)
    assert len(calls) == 3 and calls[2] > calls[0]  # round 0 isn't fitted again, round 1 is, on both rounds' examples
    assert sorted(spark.read.parquet(f"{work}/train/round-0/questions").collect()) == sorted(first)
    texts = [r.key for f in ("dev", "round-0", "round-1") for r in spark.read.parquet(f"{work}/train/{f}/questions").collect()]
    assert len(texts) == len(set(texts)) == 8 + 2 * 16
    assert [r.number for r in rounds] == [0, 1] and all(0 <= r.precision <= 100 for r in rounds)
    assert training.newest(spark, work) is not None


def test_patience_ends_training(spark, work, monkeypatch):
    config = Config(train_incr_size=8, dev_n=4)
    given = iter([50.0, 60.0, 60.0, 10.0, 90.0])
    monkeypatch.setattr(training, "labelled", lambda spark, work, q, t, config: q.select("qid"))
    monkeypatch.setattr(training, "_once", lambda spark, path, make: spark.createDataFrame([(next(given),)], "precision double") if path.endswith("metric") else make())
    monkeypatch.setattr(training.LearntScorer, "load", lambda path: path)
    best, rounds = training.train(spark, work, 9, config, patience=2, seed="patient", again=True)
    assert [r.precision for r in rounds] == [50.0, 60.0, 60.0, 10.0] and "round-1" in best


def test_tables_that_have_no_more_to_ask(spark):
    rows = spark.createDataFrame([("t", "title", 0, ["a", "b"], ["x", "y"])], "table_id string, title string, row int, names array<string>, vals array<string>")
    with pytest.raises(ValueError, match="different questions"):
        pipeline.training_rounds(rows, 500)


# ---- lists that grow


def test_three_batches_are_as_good_as_one(spark, data, asked, tmp_path):
    v = c.vectors(spark, data)
    third = F.pmod(F.col("p_id"), F.lit(3))
    index = growing.GrowingIndex.create(v.filter(third == 0), f"{tmp_path}/i", 6)
    before = {r.list for r in index.centroids.collect()}
    for part in (1, 2):
        index.add(v.filter(third == part))
    want = sorted(retrieval.flat_knn(v, asked, 10).collect())
    assert sorted(index.search(asked, 10, 99).collect()) == want
    drift = {r.list: r for r in index.drift().collect()}
    assert sum(r.n for r in drift.values()) == v.count() and set(drift) == before and all(r.drift is not None for r in drift.values())
    most = sorted(r.n for r in drift.values())[-2] - 1
    least = sorted(r.n for r in drift.values())[0] + 1
    done = index.rebalance(most, least)
    assert done["split"] >= 2 and done["merged"] >= 1
    after = {r.list: r.n for r in index.lists.groupBy("list").agg(F.count("*").alias("n")).collect()}
    assert sum(after.values()) == v.count() and len(set(after) - before) >= 4
    assert sorted(index.search(asked, 10, 99).collect()) == want
    assert index.rebalance(10**9) == {"split": 0, "merged": 0}


def test_a_rewriting_that_is_lost_midway_changes_nothing(spark, data, asked, tmp_path, monkeypatch):
    v = c.vectors(spark, data)
    index = growing.GrowingIndex.create(v, f"{tmp_path}/i", 4)
    want = sorted(index.search(asked, 10, 99).collect())

    def lost(*a):
        raise RuntimeError("lost")

    written = growing.GrowingIndex._written
    with monkeypatch.context() as m:  # all is written, but not yet valid
        m.setattr(growing.GrowingIndex, "_written", lambda *a: (written(*a), lost()))
        with pytest.raises(RuntimeError):
            index.rebalance(50)
    assert index.version == 0 and sorted(index.search(asked, 10, 99).collect()) == want
    index.rebalance(50)
    assert index.version == 1 and sorted(index.search(asked, 10, 99).collect()) == want
