"""Steps whose cost would outgrow their input, and figures at the edge of rounding."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridseek.llm import linededup, links
from gridseek.llm.common import stored
from gridseek.operators import examples, gold, metrics, retrieval, sqlgen, words
from gridseek.plans import catalogue as c


def test_answers_of_one_text_are_dealt_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(gold, "PACK", 16, raising=False)
    answers = spark.range(300).select(F.col("id").alias("qid"), F.lit("Parts").alias("title"), F.lit("LARGE").alias("answer"))
    cells = spark.range(200).select(F.lit("t").alias("table_id"), F.lit("Parts").alias("title"), F.col("id").cast("int").alias("row"), F.lit(1).alias("col"), F.lit("type").alias("col_name"), F.lit("Large").alias("value"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the tables are large
    try:
        found = gold.answer_cells(answers, cells).withColumn("task", F.spark_partition_id()).persist()
        assert found.select("qid", "row").distinct().count() == found.count() == 60_000
        assert found.groupBy("task").count().agg(F.max("count")).first()[0] < 30_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


@pytest.mark.parametrize("total", [0.57, 1.13, 2.51, 9998.71, 9999.63, 4321.01])
def test_averages_round_as_in_sql(spark, total):
    values = [f"{total:.2f}"] + ["0.00"] * 7
    rows = spark.createDataFrame([("t", i, "title", ["kind", "x"], ["A", v]) for i, v in enumerate(values)], "table_id string, row int, title string, names array<string>, vals array<string>")
    types = spark.createDataFrame([("t", 0, "text"), ("t", 1, "float")], "table_id string, col int, type string")
    asked = spark.createDataFrame([("q", "t", 0, 1, 5, [(0, 0, "A")])], "qid string, table_id string, row int, sel int, agg int, conds array<struct<col:int,op:int,value:string>>")
    want = duckdb.connect().execute(f"SELECT printf('%.4f', round(round(avg(x), 9), 4)) FROM unnest({[float(v) for v in values]}::DOUBLE[]) AS t(x)").fetchall()[0][0]
    assert sqlgen.execute(asked, rows, types).first()["result"] == want


def test_products_are_held_in_bounded_blocks(monkeypatch):
    seen, nearest, rng = [], retrieval._nearest, np.random.default_rng(1)
    monkeypatch.setattr(retrieval, "_nearest", lambda scores, *rest: seen.append(scores.size) or nearest(scores, *rest))
    part = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([1] * 3000), pa.array(rng.normal(size=(3000, 4)).tolist())], names=["p_id", "table_id", "embedding"])
    qid, p_id, _, score = retrieval._hits(pa.array(range(2000)), rng.normal(size=(2000, 4)), part, 5)
    assert len(qid) == len(p_id) == len(score) == 10_000 and max(seen) <= 1 << 20


def test_rows_in_no_order_of_lists_send_their_best_alone(spark, data):
    v, q = c.vectors(spark, data), c.vector_questions(spark, data).select("qid", "q")
    cen = retrieval.hashed_centroids(v, 16)
    lists = retrieval.assign_lists(v, cen).coalesce(1).select("list", "p_id", "table_id", F.col("embedding").cast("array<double>").alias("x"))
    found = retrieval._probed(lists, retrieval.probes_of(q, cen, 16), retrieval._numbers, lambda bias, q, x: q @ x.T, 7)
    assert found.count() == 7 * q.count()


def test_codes_with_a_bound_give_the_exact_first(spark, data, tmp_path):
    v, q = c.vectors(spark, data), c.vector_questions(spark, data).select("qid", "q")
    cen = retrieval.hashed_centroids(v, 4)
    lists, books = retrieval.residual_codes(retrieval.assign_lists(v, cen), cen, 4, codes=8)
    retrieval.write_lists(lists, str(tmp_path))
    found = retrieval.coded_search(spark.read.parquet(str(tmp_path)), cen, books, q, 10, 4, refine=1, exact=True)
    assert sorted(found.collect()) == sorted(retrieval.flat_knn(v, q, 10).select(*found.columns).collect())


def test_grams_are_counted_within_their_pair(spark, capsys):
    pairs = spark.createDataFrame([(1, "a b a b c", "a b c a"), (2, "", ""), (3, None, "a"), (4, "x y", "")], "sid long, hyp string, ref string")
    several = pairs.withColumn("refs", F.array("ref"))
    for df in (metrics.bleu4(several), metrics.chrf(several), metrics.rouge_n(pairs, 2)):
        df.explain()
    assert "explode(concat" not in capsys.readouterr().out
    assert [tuple(r) for r in metrics.rouge_n(pairs, 2).orderBy("sid").collect()] == [(1, 0.5, 0.666667, 0.571429), (4, 0.0, 0.0, 0.0)]
    assert [r.sid for r in metrics.chrf(several).orderBy("sid").collect()] == [1, 4]


def test_one_inequality_is_read_off_running_aggregates(spark, capsys):
    cells = ["1.50", "-2.00", "1.50", "0.00", "7.25", "", "NaN", "-0.00"]
    rows = spark.createDataFrame([("t", i, "title", ["kind", "x"], ["A" if i != 4 else "B", v]) for i, v in enumerate(cells)], "table_id string, row int, title string, names array<string>, vals array<string>")
    types = spark.createDataFrame([("t", 0, "text"), ("t", 1, "float")], "table_id string, col int, type string")
    asks = [(f"{agg}/{op}/{b}", "t", 0, 1, agg, [(0, 0, "A"), (1, op, b)]) for agg in (1, 2, 3, 4) for op in (1, 2) for b in ("1.50", "0.00", "-9", "NaN", "none")]
    asked = spark.createDataFrame(asks, "qid string, table_id string, row int, sel int, agg int, conds array<struct<col:int,op:int,value:string>>")
    out = sqlgen.execute(asked, rows, types)
    out.explain()
    assert "Window" in capsys.readouterr().out
    held = spark.createDataFrame([("A" if i != 4 else "B", v) for i, v in enumerate(cells)], "kind string, v string").withColumn("x", F.expr("try_cast(v AS double)"))
    want = []
    for qid, *_, agg, conds in asks:
        op, b = conds[1][1], conds[1][2]
        hit = held.filter(f"kind = 'A' AND x {'>' if op == 1 else '<'} try_cast('{b}' AS double)")
        n, value = hit.agg(F.count("*"), (F.max("x"), F.min("x"), F.count("v"), F.sum("x"))[agg - 1]).first()
        if n:
            want.append((qid, str(value) if agg == 3 else value))
    got = [(r.qid, r.result if r.qid[0] == "3" else float(r.result)) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_attention_is_summed_in_one_pass(spark, capsys):
    rows = [(1, 7, layer, head, token, int(token < 2), 0.5 * token + layer) for layer in (0, 1) for head in (0, 1, 2) for token in (0, 1, 2)] + [(1, 8, 0, 0, 0, 0, 1.0)]
    out = examples.attention_scores(spark.createDataFrame(rows, "qid long, p_id long, layer int, head int, token int, valid int, weight double"))
    out.explain()
    assert "Expand" not in capsys.readouterr().out
    assert [tuple(r) for r in out.collect()] == [(1, 7, 0.75)]


def test_gold_tables_of_single_queries_need_no_distinct_rows(spark, monkeypatch):
    cells = [(f"t{i}", j, "Title", ["kind", "x"], ["A" if j % 2 else "b", str(i % 2)]) for i in range(4) for j in range(2)]
    rows = spark.createDataFrame(cells, "table_id string, row int, title string, names array<string>, vals array<string>")
    kind = "qid string, table_id string, row int, sel int, conds array<struct<col:int,op:int,value:string>>"
    asks = [("a", "t0", 1, 0, [(0, 0, "a")]), ("b", "t0", 1, 0, [(0, 0, "A"), (1, 0, "1")]), ("c", "t1", None, 0, []), ("d", "t2", 0, 1, [(1, 0, "none")])]
    every = [("a", f"t{i}") for i in range(4)] + [("b", "t0"), ("b", "t1"), ("b", "t3")] + [("c", f"t{i}") for i in range(4)] + [("d", "t2")]
    for names in (0, 10_000):
        monkeypatch.setattr(gold, "NAMES", names, raising=False)
        out = gold.gold_tables(spark.createDataFrame(asks, kind), rows)
        assert sorted(map(tuple, out.collect())) == sorted(every)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [qid" not in plan  # what grows is never held in a table of all (qid, table_id)
    again = [("a", "t1", 1, 0, [(1, 0, "0")]), ("b", "t0", 1, 0, [(0, 0, "A"), (1, 0, "1")])]
    out = gold.gold_tables(spark.createDataFrame(asks + again, kind), rows)
    assert sorted(map(tuple, out.collect())) == sorted(every)


def test_listed_values_are_filtered_where_their_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(sqlgen, "ASKS", 3, raising=False)
    cells = ["1.50", "-2.00", "1.50", "0.00", "7.25", "", "NaN"]
    kind = "table_id string, row int, title string, names array<string>, vals array<string>"
    rows = spark.createDataFrame([(t, i, f"Title {i if t == 'u' else 0}", ["kind", "x"], ["A" if i != 4 else "B", v]) for t in "tu" for i, v in enumerate(cells)], kind)
    types = spark.createDataFrame([(t, c, k) for t in "tu" for c, k in ((0, "text"), (1, "float"))], "table_id string, col int, type string")
    asks = [(f"{t}/{op}/{b}/{name}", t, 0, 1, 0, [(0, 0, "A"), (1, op, b)] + ([(None, 0, name)] if name else [])) for t in "tu" for op in (1, 2) for b in ("1.50", "0.00", "-9", "NaN", "none") for name in ("", "title 0 ", "other")]
    asked = spark.createDataFrame(asks, "qid string, table_id string, row int, sel int, agg int, conds array<struct<col:int,op:int,value:string>>")
    out = sqlgen.execute(asked, rows, types)
    assert "copies" in out._jdf.queryExecution().optimizedPlan().toString()
    held = rows.withColumn("x", F.expr("try_cast(vals[1] AS double)")).filter("vals[0] = 'A'")
    want = []
    for qid, t, *_, conds in asks:
        op, b = conds[1][1], conds[1][2]
        hit = held.filter(f"table_id = '{t}' AND x {'>' if op == 1 else '<'} try_cast('{b}' AS double)")
        if len(conds) == 3:
            hit = hit.filter(F.lower("title") == conds[2][2].strip())
        found = [r.vals[1] for r in hit.orderBy("row").collect()]
        if found:
            want.append((qid, "|".join(found)))
    assert sorted(map(tuple, out.collect())) == sorted(want)


def _worded(spark, data):
    passages = c.load(spark, data, "documents").select(F.col("doc_id").alias("p_id"), F.col("source").alias("table_id"), "text")
    return passages.union(passages.withColumn("p_id", F.col("p_id") + 100_000)), c.load(spark, data, "benchmark").select(F.col("item_id").alias("qid"), "text")


def test_passages_are_scored_by_words_where_they_lie(spark, data, monkeypatch):
    passages, questions = _worded(spark, data)  # each text twice, so that scores tie
    monkeypatch.setattr(retrieval, "TERMS", -1)
    want = sorted(retrieval.bm25(passages, questions, 5).collect())
    monkeypatch.setattr(retrieval, "TERMS", 500_000)
    out = retrieval.bm25(passages, questions, 5)
    assert "Aggregate [qid" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row for each question and passage
    assert sorted(out.collect()) == want and len(want) == 5 * questions.count()
    assert retrieval.bm25(passages, questions.limit(0), 5).count() == 0
    monkeypatch.setattr(retrieval, "PRODUCTS", 64)  # what is held comes out again and again
    best = retrieval.Best(retrieval.Asked(pa.table({"qid": [7, 8], "term": ["a", "a"]})), 3, ["p_id"])
    parts = [b for i in range(50) for b in best.add(np.arange(40) % 2, np.full(40, float(i % 7)), np.arange(40), pa.array(range(40 * i, 40 * i + 40)))]
    rows = pa.Table.from_batches([*parts, *best.out()]).to_pylist()
    assert sorted((r["p_id"], r["score"]) for r in rows if r["qid"] == 7 and r["score"] == 6)[:3] == [(240, 6.0), (242, 6.0), (244, 6.0)]


def test_postings_are_made_and_scored_in_chunks(spark, data, tmp_path, monkeypatch):
    passages, questions = _worded(spark, data)
    monkeypatch.setattr(words, "BLOCKS", 2, raising=False)
    monkeypatch.setattr(words, "PER_BLOCK", 8)
    words.write_index(passages, str(tmp_path))
    want = sorted(retrieval.bm25(passages, questions, 5).collect())
    found = words.WordIndex(spark, str(tmp_path)).search(questions, 5)
    assert "Aggregate [qid" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each question and posting
    assert sorted(found.collect()) == want
    monkeypatch.setattr(words, "QUESTIONS", 15, raising=False)  # they take their turns
    assert sorted(words.WordIndex(spark, str(tmp_path)).search(questions, 5).collect()) == want


def test_only_retrieved_passages_are_marked(spark, data):
    passages = c.load(spark, data, "documents").select(F.col("doc_id").alias("p_id"), "text")
    asked = passages.join(spark.range(3).withColumnRenamed("id", "p_id"), "p_id", "left_semi")
    plan = metrics._phrases_held(asked, spark.createDataFrame([("\x1fa\x1f",)], "phrase string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan[plan.index("LeftSemi") :]


def test_two_sets_are_bounded_by_bits_and_counted_exactly(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.concatenate([base[:n], rng.integers(0, 1 << 62, m).astype(np.uint64), base[:r]]) for n, m, r in ((400, 0, 0), (360, 40, 0), (320, 80, 9), (300, 100, 0), (5, 1, 0), (1, 0, 300), (0, 700, 0))]
    for at_once in (1 << 18, 64):
        monkeypatch.setattr(links, "AT_ONCE", at_once, raising=False)
        group = links._Group(list(range(len(sets))), sets)
        i, j = np.triu_indices(len(sets))
        both = np.array([len(set(sets[x].tolist()) & set(sets[y].tolist())) for x, y in zip(i, j, strict=True)])
        union = np.array([len(set(sets[x].tolist()) | set(sets[y].tolist())) for x, y in zip(i, j, strict=True)])
        assert (group.most(i, j) >= both).all()
        assert [group.alike(x, y, 0.8) for x, y in zip(i.tolist(), j.tolist(), strict=True)] == (both >= 0.8 * union).tolist()
        assert group.table.nbytes < group.table.shape[0] * 16 * 1024  # bits, not bytes


def test_large_buckets_shuffle_their_own_contents_alone(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK_ROWS", 4)
    read, settled = [], links.settled
    monkeypatch.setattr(links, "settled", lambda cells, content, measure: read.append(content.count()) or settled(cells, content, measure))
    members = spark.range(10).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("n"))
    sizes = spark.createDataFrame([(1, 10, 3)], "key long, size long, blocks int")
    content = spark.range(100).select(F.col("id").alias("n"), F.lit("one line of text").alias("content"))
    stars = links.large_bucket_links(members, stored(sizes), stored(content), linededup.MEASURE)
    assert {n for r in stars.collect() for n in r} == set(range(10)) and read == [10, 10][: len(read)]


def _broadcast(plan):
    """Names of the columns in all broadcasts of a plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _broadcast(plan.executedPlan())
    own = {plan.output().apply(i).name() for i in range(plan.output().size())} if plan.nodeName() == "BroadcastExchange" else set()
    return own.union(*(_broadcast(plan.children().apply(i)) for i in range(plan.children().size())))


@pytest.mark.parametrize("name", ["count", "avg", "max", "min", "plain"])
def test_rows_and_queries_of_small_files_are_not_broadcast(spark, data, name):
    out = c.QUERIES[f"sql_execute_{name}"](spark, data)  # files far below the bound that Spark broadcasts by
    assert not {"vals", "conds", "_conds", "qid", "s"} & _broadcast(out._jdf.queryExecution().executedPlan())


def test_packs_of_small_files_are_not_broadcast(spark, data):
    out = c.QUERIES["answer_cell_match"](spark, data)
    assert not {"spots", "qids", "qid", "row"} & _broadcast(out._jdf.queryExecution().executedPlan())
