"""Readers, writers and text functions around the files, against hand-made cases."""

import glob
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gridseek.functions import text as T
from gridseek.functions import udf as U
from gridseek.operators import examples, metrics, profile, ranking, retrieval, triples
from gridseek.plans import pipeline
from gridseek.sources import sinks, tables

ROWS = "table_id string, title string, row int, names array<string>, vals array<string>"


@pytest.fixture(scope="module")
def city(spark):
    return spark.createDataFrame([("t1", "City facts", 0, ["name", "country"], ["New York", "USA"]), ("t1", "City facts", 1, ["name", "country"], ['Os"lo', "Norway"])], ROWS)


def lines(folder):
    return [json.loads(x) for f in sorted(glob.glob(f"{folder}/part-*")) for x in open(f, encoding="utf-8").read().splitlines()]


def test_passages_out_and_in(spark, city, tmp_path):
    made = triples.passages(city, "RelationGraph")
    sinks.write_passages(made, str(tmp_path / "p"))
    back = tables.read_passages(spark, str(tmp_path / "p"))
    assert sorted((r.p_id, r.passage, r.tag.row, r.tag.sub_col) for r in back.collect()) == sorted((r.p_id, r.passage, r.row, r.sub_col) for r in made.collect())
    sinks.write_passage_parts(made.withColumn("title", F.lit("City facts")), str(tmp_path / "parts"), 3)
    files = sorted(glob.glob(f"{tmp_path}/parts/part-*"))
    ids = [[int(x.split("\t")[0]) for x in open(f).read().splitlines()[1:]] for f in files]
    assert [i for part in ids for i in part] == sorted(r.p_id for r in made.collect()) and len(ids) == 3


@pytest.mark.parametrize("strategy", sorted(triples.STRATEGIES))
def test_every_strategy_gives_dense_ids(city, strategy):
    got = triples.passages(city, strategy).collect()
    assert sorted(r.p_id for r in got) == list(range(1, len(got) + 1)) and all(r.passage for r in got)


def test_budgets_in_pieces_of_a_vocabulary(spark):
    rows = spark.createDataFrame([("t", "T", 0, ["aa", "bb", "cc"], ["xyxy", "xy", "z"])], ROWS)
    vocabulary = frozenset(["x", "##y", "##x", "z", "a", "##a", "b", "##b", "c", "##c", ","])
    assert [r.cols for r in triples.sliding_passages(rows, 9).collect()] == [[0, 1, 2]]
    assert [r.cols for r in triples.sliding_passages(rows, 9, vocabulary).collect()] == [[0], [1, 2]]
    tuples = spark.createDataFrame([("t", 0, ["xyxy ", "xy ", "z "])], "table_id string, row int, tuples array<string>")
    assert [r.passage for r in triples.graph_passages(tuples, 5, vocabulary).collect()] == ["xyxy ", "xy z "]
    columns = spark.createDataFrame([("t", 0, "aa"), ("t", 1, "aabb cc"), ("t", 2, "")], "table_id string, col int, col_name string")
    assert [r.col for r in profile.good_columns(columns, 2, vocabulary).collect()] == [0]


def test_windows_are_the_greedy_ones():
    rng = random.Random(3)
    for _ in range(300):
        sizes, budget, stride = [rng.randint(0, 9) for _ in range(rng.randint(0, 15))], rng.randint(1, 12), rng.randint(1, 4)
        want, at = [], 0
        while at < len(sizes):
            to, load = at, 0
            while to < len(sizes) and load + sizes[to] <= budget:
                load, to = load + sizes[to], to + 1
            want.append((at, to))
            if to == len(sizes):
                break
            at = max(at + 1, min(at + stride, to - 1))
        assert triples.pack_windows(sizes, budget, stride) == want


def test_a_repeated_stage_makes_later_ones_stale(spark, tmp_path):
    from gridseek.config import Stages

    ran = []
    for again in (False, False, True):
        stages = Stages(spark, str(tmp_path))
        stages.run("passages/row", lambda: ran.append("p"), again)
        stages.run("embeddings", lambda: ran.append("e"))
    Stages(spark, str(tmp_path)).run("passages/slide", lambda: ran.append("s"))
    assert "".join(ran) == "pepes"


def test_shuffled_parts_and_embeddings(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("p_id"), F.array(F.lit(0.5)).cast("array<float>").alias("embedding"))
    sinks.write_shuffled_parts(df.select("p_id"), "p_id", str(tmp_path / "s"), 10)
    assert sorted(p.rsplit("=", 1)[1] for p in glob.glob(f"{tmp_path}/s/part=*")) == ["0", "1", "2"]
    sinks.write_embeddings(df.filter("p_id < 10"), str(tmp_path / "e1"))
    sinks.write_embeddings(df.filter("p_id >= 10"), str(tmp_path / "e2"))
    assert tables.read_embeddings(spark, f"{tmp_path}/e*").count() == 25
    assert sinks.write_checked(df, str(tmp_path / "c")) == 25


def test_predictions_and_error_log(spark, tmp_path):
    retr = spark.createDataFrame([("q1", 1, 7, "p7", "A", 0.9, 0), ("q1", 2, 8, "p8", "B", 0.8, 1), ("q2", 1, 9, "p9", "B", 0.7, 1)], "qid string, rank int, p_id long, passage string, table_id string, score double, correct int")
    asked = spark.createDataFrame([("q1", "who?", ["B"]), ("q2", "what?", ["B"])], "qid string, question string, table_id_lst array<string>")
    sinks.write_predictions(retr, asked, str(tmp_path / "p"))
    assert {x["qid"]: (x["p_id_lst"], x["passages"], x["scores"]) for x in lines(tmp_path / "p")} == {"q1": ([7, 8], ["p7", "p8"], [0.9, 0.8]), "q2": ([9], ["p9"], [0.7])}
    sinks.write_error_log(retr, asked, str(tmp_path / "e"))
    log = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/e/log/part-*"))
    assert '"q1","0","who?"' in log and "q2" not in log
    assert sorted("".join(open(f).read() for f in glob.glob(f"{tmp_path}/e/tables/part-*")).split()) == ["A", "B"]


def test_query_files_are_aligned(spark, tmp_path):
    q = spark.createDataFrame([(f"q{i:02d}", f"select\n{i}") for i in range(20)], "qid string, sql_text string")
    sinks.write_query_files(q.repartition(4), str(tmp_path))
    texts = [x for f in sorted(glob.glob(f"{tmp_path}/source/part-*")) for x in open(f).read().splitlines()]
    assert texts == [x["sql_text"].replace("\n", " ") for x in lines(tmp_path / "meta")] and len(texts) == 20


def test_lines_of_two_files_belong_together(spark, tmp_path):
    (tmp_path / "meta").write_text("".join(f'{{"n": {i}}}\n' for i in range(5000)))
    (tmp_path / "questions").write_text("".join(f"question {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = tables.zipped_lines(spark, str(tmp_path / "meta"), str(tmp_path / "questions")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.line for r in got) == list(range(5000))
    assert all(json.loads(r.meta)["n"] == r.line and r.question == f"question {r.line}" for r in got)
    (tmp_path / "questions").write_text("one\n")
    with pytest.raises(Exception, match="no question"):
        tables.zipped_lines(spark, str(tmp_path / "meta"), str(tmp_path / "questions")).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("id\ttext\n1\ta\n2\tb\n")
    assert [r.text for r in tables.read_tsv(spark, str(tmp_path / "x.tsv"), spark.createDataFrame([("2",)], "id string")).collect()] == ["b"]
    (tmp_path / "w.tsv").write_text('id\ttext\ttitle\n1\t"He said ""no"""\tTalk\n2\tplain\tOther\n')
    assert sorted(map(tuple, tables.read_wiki_passages(spark, str(tmp_path / "w.tsv")).collect())) == [(1, "Talk", 'He said "no"'), (2, "Other", "plain")]
    ex = spark.createDataFrame([(0, None, [("t", None)]), (1, "x", [("u", 0.25)])], "ord int, id string, ctxs array<struct<title:string,score:double>>")
    assert [(r.id, r.ctxs[0].score) for r in tables.number_examples(ex).orderBy("ord").collect()] == [("0", 1.0), ("x", 0.25)]
    talk = spark.createDataFrame([(("T",), [("q1", "who", (["a"],), [(["b", "c"],)]), ("q2", "what", (["d"],), None)])], "table struct<tableId:string>, questions array<struct<id:string,originalText:string,answer:struct<answerTexts:array<string>>,alternativeAnswers:array<struct<answerTexts:array<string>>>>>")
    assert {r.qid: (r.table_id, r.answers) for r in tables.interaction_questions(talk).collect()} == {"q1": ("T", ["a", "b", "c"]), "q2": ("T", ["d"])}
    (tmp_path / "g.jsonl").write_text(json.dumps({"id": "g1", "caption": "Cap", "subcaption": "sub", "data": [["a", "b"], ["1", "2"], ["3", "4"]]}) + "\n" + json.dumps({"id": "g2", "caption": "Bare", "subcaption": "", "data": [["a"]]}) + "\n")
    assert [(r.table_id, r.title, r.row, r.vals) for r in tables.grid_tables(spark, str(tmp_path / "g.jsonl")).orderBy("row").collect()] == [("g1", "Cap , sub", 0, ["1", "2"]), ("g1", "Cap , sub", 1, ["3", "4"])]
    (tmp_path / "b.xml").write_text('<benchmark><entries><entry eid="Id1"><modifiedtripleset><mtriple>A | r | B</mtriple><mtriple>B | s | C</mtriple></modifiedtripleset><lex lid="1">A r B.</lex><lex lid="2">B is r of A.</lex></entry></entries></benchmark>')
    entry = tables.graph_entries(spark, str(tmp_path / "b.xml")).first()
    assert entry.eid == "Id1" and entry.triples == [["A", "r", "B"], ["B", "s", "C"]] and entry.references == ["A r B.", "B is r of A."]


def test_latest_file(spark):
    listing = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-03-01"), ("c", "2024-02-01")], "path string, t string").select("path", F.to_timestamp("t").alias("modificationTime"))
    assert examples.latest_file(listing).first().path == "b"


def test_names_of_csv_files():
    assert sinks.csv_name("..a/b", "part-Brand-7") == "a b-7.csv"


def test_eval_normal_is_python_s_word_class(spark):
    texts = ["Café-au-lait, 3.5€", "日本語。テスト", "naïve_x  y", "Straße's «ok»", "a b　c"]
    want = [" ".join(re.sub(r"(\W)", r" \1 ", t).split()).lower() for t in texts]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.eval_normal(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == want


def test_text_with_state(spark):
    one = spark.createDataFrame([("é", "a b", "Unaffable, NAÏVE zzz", "the old bridge in Paris was built", "the cat sat on mats", "the cat on the mat")], "e string, n string, w string, s string, h string, r string")
    vocabulary = frozenset(["un", "##aff", "##able", ",", "naive"])
    entities = F.array(F.lit("old bridges"), F.lit("Paris"))
    got = one.select(U.nfd("e").alias("e"), T.nbsp_to_space(F.col("n")).alias("n"), U.word_pieces(F.col("w"), vocabulary).alias("w"), U.templates("s", F.array(F.lit("[S]"), F.lit("[O]")), entities).alias("s"), U.rouge_l("h", "r").alias("f")).first()
    assert got.e == "é" and got.n == "a b"
    assert got.w == ["un", "##aff", "##able", ",", "naive", "[UNK]"]
    assert got.s == "the [S] in [O] was built"
    assert got.f == pytest.approx(2 * 3 / 10)


def test_negatives_and_coreset(spark):
    split = spark.createDataFrame([(1, [5], list(range(20))), (2, [6], [3])], "qid long, pos array<long>, neg array<long>")
    got = {r.qid: r for r in ranking.sampled_negatives(split, 4).collect()}
    assert got[1].pos == 5 and len(set(got[1].neg)) == 4 and set(got[1].neg) <= set(range(20)) and got[2].neg == [3]
    assert {r.qid: r for r in ranking.sampled_negatives(split, 4).collect()} == got != {r.qid: r for r in ranking.sampled_negatives(split, 4, "other").collect()}
    worth = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "qid long, w double")
    assert [r.qid for r in ranking.coreset(worth, F.col("w"), 2).collect()] == [2, 3]


def test_losses_and_trimming(spark):
    row = spark.createDataFrame([([-1.0, -2.0, -0.5], [[5, 6, 0, 0], [7, 0, 0, 0]])], "l array<double>, t array<array<int>>").select(examples.smoothed_loss(F.col("l"), F.lit(2), 0.3).alias("x"), examples.trimmed(F.col("t"), 0).alias("t")).first()
    assert row.x == pytest.approx(0.7 * 0.5 + 0.1 * 3.5) and row.t == [[5, 6], [7, 0]]


def test_recall_with_few_lists_and_codes(spark, data):
    from gridseek.plans import catalogue as c

    assert c.ivf_probe_recall(spark, data).first().recall >= 0.9
    v, q = c.vectors(spark, data), c.vector_questions(spark, data).select("qid", "q")
    exact = {(r.qid, r.p_id) for r in retrieval.flat_knn(v, q, 10).collect()}
    coded = {(r.qid, r.p_id) for r in c.pq_search(spark, data).collect()}
    assert coded == exact
    few = retrieval.index_options(v.count())["lists"]
    centroids = retrieval.hashed_centroids(v, few)
    half = {(r.qid, r.p_id) for r in retrieval.ivf_search(retrieval.assign_lists(v, centroids), centroids, q, 10, max(1, few // 2)).collect()}
    assert len(exact & half) >= 0.6 * len(exact)


def test_questions_in_blocks(spark, data, monkeypatch):
    from gridseek.plans import catalogue as c

    v, q = c.vectors(spark, data), c.vector_questions(spark, data).select("qid", "q")
    want = sorted(retrieval.flat_knn(v, q, 7).collect())
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 6)
    monkeypatch.setattr(retrieval, "PASSAGE_BLOCK", 50)
    assert sorted(retrieval.flat_knn(v, q, 7).collect()) == want and len(want) == 7 * q.count()
    assert retrieval.flat_knn(v, q.limit(0), 7).count() == 0


def test_words_by_join(spark, data, monkeypatch):
    from gridseek.plans import catalogue as c

    want = sorted(c.bm25_search(spark, data).collect())
    monkeypatch.setattr(retrieval, "TERMS", -1)
    assert sorted(c.bm25_search(spark, data).collect()) == want


def test_rounds_of_questions_and_examples(spark, data):
    from gridseek.plans import catalogue as c

    rows = c.customer_tables(spark, data)
    asked, truth = pipeline.training_rounds(rows, 40)
    got = asked.collect()
    assert len({r.key for r in got}) == len(got) == 40 and {r.qid for r in truth.collect()} == {r.qid for r in got}
    retr = spark.createDataFrame([(got[0].qid, i + 1, i, float(-i), t) for i, t in enumerate(["x", truth.filter(F.col("qid") == got[0].qid).first().table_id, "y"])], "qid string, rank int, p_id long, score double, table_id string")
    pair = pipeline.training_examples(retr, truth).collect()
    assert [(r.qid, r.pos, r.neg) for r in pair] == [(got[0].qid, [1], [0, 2])]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from gridseek import __main__ as cli

    monkeypatch.setattr(cli, "get_session", lambda: spark)
    (tmp_path / "csv").mkdir()
    for i, (title, names) in enumerate([("rivers", ["Nile", "Rhine", "Volga"]), ("planets", ["Mars", "Venus", "Earth"]), ("metals", ["Iron", "Gold", "Zinc"])]):
        (tmp_path / "csv" / f"{title}_SEP_T{i}.csv").write_text("name,score\n" + "".join(f"{w},{j}.5\n" for j, w in enumerate(names)))
    work, csv = f"{tmp_path}/w", f"{tmp_path}/csv"
    cli.main(["import", "--work", work, "--tables", csv])
    cli.main(["triples", "--work", work, "--strategy", "row"])
    assert spark.read.parquet(f"{work}/passages").count() == 9
    cli.main(["index", "--work", work, "--strategy", "row", "--step", "embeddings"])
    cli.main(["index", "--work", work, "--strategy", "row"])
    cli.main(["ask", "--work", work, "planets name Venus", "--html", f"{tmp_path}/html"])
    assert "<h2>1. planets" in "".join(open(f).read() for f in glob.glob(f"{tmp_path}/html/part-*"))
    (tmp_path / "q.jsonl").write_text('{"qid": "a", "question": "planets name Venus", "table_id_lst": ["T1"]}\n')
    cli.main(["retrieve", "--work", work, "--questions", f"{tmp_path}/q.jsonl", "--out", f"{tmp_path}/r"])
    assert {x["table_id"] for x in lines(tmp_path / "r")} == {"T0", "T1", "T2"}
    cli.main(["test", "--work", work, "--questions", f"{tmp_path}/q.jsonl", "--out", f"{tmp_path}/t"])
    assert "100.0" in capsys.readouterr().out
    cli.main(["retrieve", "--work", work, "--questions", f"{tmp_path}/q.jsonl", "--out", f"{tmp_path}/by_words", "--by", "words", "--n-docs", "2", "--max-retr", "2"])
    assert lines(tmp_path / "by_words")[0]["table_id"] == "T1" and len(lines(tmp_path / "by_words")) <= 2
    cli.main(["train", "--work", work, "--questions", "5", "--dev-questions", "3", "--rounds", "1"])
    assert spark.read.parquet(f"{work}/train/round-0/questions").count() == 5 and "round 0: precision" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.arguments(["triples", "--work", work, "--strategy", "none"])


def test_best_metric_of_a_run(spark):
    runs = spark.createDataFrame([(1, 1, 5.0, 1.0), (1, 2, 6.0, 0.0), (1, 3, 6.0, 2.0)], "run int, step int, p1 double, p5 double")
    assert metrics.best_step(runs).first().step == 3


def test_ids_of_an_index_are_checked(spark, tmp_path):
    ids = spark.range(5).withColumnRenamed("id", "p_id")
    ids.withColumn("x", F.lit(1)).write.parquet(f"{tmp_path}/i")
    assert sinks.read_checked(spark, f"{tmp_path}/i", ids).count() == 5
    for other, why in ((spark.range(6), "1 ids missing"), (spark.range(4), "1 unknown")):
        with pytest.raises(OSError, match=why):
            sinks.read_checked(spark, f"{tmp_path}/i", other.withColumnRenamed("id", "p_id"))
    ids.withColumn("x", F.lit(2)).limit(1).write.mode("append").parquet(f"{tmp_path}/i")
    with pytest.raises(OSError, match="1 repeated"):
        sinks.read_checked(spark, f"{tmp_path}/i", ids)


def test_split_and_target_files(spark, tmp_path):
    sinks.write_splits(spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "dev")], "table_id string, part string"), f"{tmp_path}/s")
    read = lambda p: [x for f in sorted(glob.glob(f"{tmp_path}/{p}/part-*")) for x in open(f).read().splitlines()]
    assert read("s/part=train") == ["a", "b"] and read("s/part=dev") == ["c"]
    sinks.write_query_files(spark.createDataFrame([("1", "SELECT a", "what\nis a ?"), ("0", "SELECT b", "b ?")], "qid string, sql_text string, question string"), f"{tmp_path}/q")
    assert read("q/source") == ["SELECT b", "SELECT a"] and read("q/target") == ["b ?", "what is a ?"]


def test_marked_spans_gold_delta_and_embeddings(spark):
    tags = ("[S]", "[/S]", "[O]", "[/O]")
    rows = [("a [S]x[/S] b [O]y [O]z[/O] c", "1", "2", "a 1 b 2 c"), ("a [S]x b", "1", "2", "a [S]x b"), ("[O]y[/O][S][/S]", "1", None, "1"), (None, "1", "2", None)]
    got = spark.createDataFrame(rows, "x string, s string, o string, want string").select("want", T.with_spans_replaced(F.col("x"), F.col("s"), F.col("o"), tags).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    p = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d"), (4, "e")], "p_id int, passage string")
    g = spark.createDataFrame([(1, "a b . more . here"), (2, "c"), (4, "other")], "p_id int, passage string")
    assert {r.p_id: r.passage for r in examples.with_gold_delta(p, g).collect()} == {1: "a b [G] more . here", 2: "c", 3: "d", 4: "e"}
    e = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "p_id int, embedding array<double>")
    meta = spark.createDataFrame([(5, "t", 0), (1, "t", 1), (3, "a", 2), (0, "t", 0)], "p_id int, table_id string, row int")
    assert [(r.new_id, r.p_id, r.embedding) for r in sorted(examples.renumbered_embeddings(e, meta).collect())] == [(0, 3, [3.0]), (1, 0, [0.0]), (2, 5, [5.0]), (3, 1, [1.0])]


def test_divergence_and_strategies(spark):
    row = spark.createDataFrame([([0.5, -1.0], [0.2, 2.0])], "m array<double>, s array<double>")
    kl = sum(math.log(1 / s) + (s * s + m * m) / 2 - 0.5 for m, s in ((0.5, 0.2), (-1.0, 2.0)))
    assert row.select(examples.bayesian_loss(F.lit(1.5), examples.gaussian_divergence(F.col("m"), F.col("s")), F.lit(4)).alias("x")).first().x == pytest.approx(1.5 + kl / 4)
    q = spark.createDataFrame([(i, i % 3) for i in range(9)], "qid int, x int")
    assert [r.qid for r in ranking.coreset(q, F.col("x"), 2).collect()] == [2, 5]
    assert sorted(r.qid for r in ranking.coreset(q, lambda d: d.filter("x = 1"), 1).collect()) == [1, 4, 7]
    assert sorted(r.qid for r in ranking.coreset(q, lambda d: d.select("qid", (-F.col("qid")).alias("worth")), 3).collect()) == [0, 1, 2]
