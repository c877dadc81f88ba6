"""Operators against plain re-derivations and small golden tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseek.functions import text as T
from gridseek.functions import udf
from gridseek.functions.vectors import mean_pool
from gridseek.operators import gold, metrics, profile, ranking, retrieval, sqlgen, triples
from gridseek.sources import sinks, tables

ROWS = "table_id string, title string, row int, names array<string>, vals array<string>"


@pytest.fixture(scope="module")
def city(spark):
    return spark.createDataFrame([("t1", "City facts", 0, ["name", "country", "mayor"], ["New York", "USA", ""]), ("t1", "City facts", 1, ["name", "country", "mayor"], ["Oslo", "Norway", "A B"])], ROWS)


def test_triples_of_a_titled_table(city):
    got = triples.relation_triples(city)
    assert got.count() == 12
    texts = {(r.row, r.sub_col, r.obj_col): r.passage for r in got.collect()}
    assert texts[0, None, 0] == '" City facts " ,  , name  " New York " ; '
    assert texts[0, 0, 2] == '" City facts " , name  " New York " , mayor ; '


def test_untitled_single_column_gives_none(spark):
    df = spark.createDataFrame([("t", "", 0, ["a"], ["x"])], ROWS)
    assert triples.relation_triples(df).count() == 0


def test_passage_ids_are_dense(city):
    ids = sorted(r.p_id for r in triples.with_passage_ids(triples.relation_triples(city)).collect())
    assert ids == list(range(1, 13))


def plain_rebalance(ranks, top_n, need, keep=3):
    """Ranks is a list of table ids in order."""
    order = list(dict.fromkeys(ranks))
    inside = len(set(ranks[:top_n]))
    if inside >= need or len(order) < need:
        return list(range(min(top_n, len(ranks))))
    place = {t: [i for i, x in enumerate(ranks) if x == t] for t in order}
    taken = {t: place[t][:keep] for t in order[inside:need]}
    added = sum(map(len, taken.values()))
    excess = sum(len(place[t]) for t in order[:inside]) - (top_n - added)
    for t in reversed(order[:inside]):
        cut = min(excess, max(len(place[t]) - keep, 0))
        taken[t] = place[t][: len(place[t]) - cut]
        excess -= cut
    return [i for t in order[:need] for i in taken[t]][:top_n]


def test_rebalance_like_a_loop(spark):
    rng = random.Random(4)
    lists = {"hand": ["A"] * 28 + ["B"] * 6 + ["C"] * 4 + ["D", "E"], "short": ["A"] * 20 + ["B"] * 9 + ["C"] * 9}
    for i in range(150):
        lists[f"q{i}"] = [rng.choice("AAAAAAABBBCDEFG"[: rng.randint(3, 15)]) for _ in range(rng.randint(25, 60))]
    rows = [(q, i + 1, i, 1.0, t) for q, ts in lists.items() for i, t in enumerate(ts)]
    got = {}
    for r in ranking.rebalanced(spark.createDataFrame(rows, "qid string, rank int, p_id long, score double, table_id string"), 25).collect():
        got.setdefault(r.qid, {})[r.place] = r.p_id
    for q, ts in lists.items():
        assert [got[q][k] for k in sorted(got[q])] == plain_rebalance(ts, 25, 5), q
    assert sum(lists["hand"][p] == "A" for p in got["hand"].values()) == 17


def test_column_types(spark):
    cols = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b"), ("t", 2, "c")], "table_id string, col int, col_name string")
    cells = spark.createDataFrame([("t", 0, "1.5"), ("t", 0, "-2.0"), ("t", 1, "1"), ("t", 1, "2.0")], "table_id string, col int, value string")
    assert {r.col: r.type for r in profile.column_types(cols, cells).collect()} == {0: "float", 1: "text", 2: "float"}


def test_windows_of_words():
    assert triples.pack_windows([60, 60, 60, 60], 150) == [(0, 2), (1, 3), (2, 4)]
    assert triples.pack_windows([200, 10], 150) == [(0, 0), (1, 2)]
    assert triples.slide_windows([100, 40, 30], 150) == [[0, 1], [1, 2]]
    assert triples.slide_windows([10, 200, 10], 150) == [[0], [1], [2]]


def test_gold_on_any_column_of_the_name(spark):
    names = ["a", "a", "x"]
    rows = spark.createDataFrame([("t1", "Same", 0, names, ["p", "q", "1"]), ("t2", " same", 0, names, ["Q", "P", "2"]), ("t3", "other", 0, names, ["p", "q", "3"])], ROWS)
    q = spark.createDataFrame([("q", "t1", 0, 2, 0, [(0, 0, "p"), (1, 0, "q")])], "qid string, table_id string, row int, sel int, agg int, conds array<struct<col:int,op:int,value:string>>")
    assert {r.table_id for r in gold.gold_tables(q, rows).collect()} == {"t1", "t2"}


def test_sampled_queries_are_the_grammar(spark, data):
    from gridseek.plans import catalogue as c

    rows = c.all_tables(spark, data)
    drawn = sqlgen.sample_queries(rows, c.typed_columns(rows), 200)
    got = drawn.collect()
    assert got and all(1 <= len(q.conds) <= 4 for q in got)
    assert got == sqlgen.sample_queries(rows, c.typed_columns(rows), 200).collect() or sorted(got) == sorted(sqlgen.sample_queries(rows, c.typed_columns(rows), 200).collect())
    for q in got:
        assert q.sql_text.startswith("[S-E-L-E-C-T] ") and "[W-H-E-R-E]" in q.sql_text
        assert all(x.col != q.sel for x in q.conds)


def test_all_probes_are_exact(spark, data):
    from gridseek.plans import catalogue as c

    assert sorted(c.ivf_probe_all(spark, data).collect()) == sorted(c.knn_flat_ip(spark, data).collect())


def test_precision_never_falls_with_k(spark, data):
    from gridseek.plans import catalogue as c

    p = {r.k: r.precision for r in metrics.precision_at(c.labelled(spark, data), (1, 2, 5, 10)).collect()}
    assert p[1] <= p[2] <= p[5] <= p[10]


def test_text_expressions(spark):
    one = spark.range(1)
    say = lambda e: one.select(e.alias("x")).first().x
    lit = F.lit
    assert say(T.strip(lit("  a b　"))) == "a b"
    assert say(T.answer_normal(lit("The  U.S. of a Cat!"))) == "us of cat"
    assert say(T.is_float(lit("5"))) is False and say(T.is_float(lit("-5.25"))) is True
    assert say(T.without_span(lit("a <s> b <e> c"), "<s>", "<e>")) == "a  c"
    assert say(T.without_span(lit("a <s> b"), "<s>", "<e>")) == "a <s> b"
    assert say(T.occurs_less_than_twice(lit("[S] x [S]"), "[S]")) is False
    assert say(T.nullable_int(lit("None"))) is None and say(T.nullable_int(lit("3"))) == 3
    assert say(T.comma_spacing(lit("1,000 a,b"))) == "1000 a , b"
    assert T.meta_tags()[:2] == ["[S-E-L-E-C-T]", "[M-A-X]"]


def test_csv_round_trip(spark, tmp_path, city):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "Big cities_SEP_7.csv").write_text('name,size\n"Oslo, NO",1.5\nRome,2.5\n')
    (tmp_path / "in" / "sub" / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "in" / "sub" / "x.meta.json").write_text('{"table_id": "M1", "title": "meta", "col_names": ["c", "d"]}')
    (tmp_path / "in" / "empty.csv").write_text("")
    got = {(r.table_id, r.row): r for r in tables.read_csv_tables(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {("7", 0), ("7", 1), ("M1", 0)}
    assert got["7", 0].vals == ["Oslo, NO", "1.5"] and got["7", 0].title == "Big cities"
    assert got["M1", 0].names == ["c", "d"]
    sinks.write_tables(city, str(tmp_path / "t"))
    assert sorted(tables.read_jsonl_tables(spark, str(tmp_path / "t")).collect()) == sorted(city.collect())


def test_unequal_width_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception, match="fields"):
        tables.read_csv_tables(spark, str(tmp_path)).collect()


def test_entries_end_to_end(spark, tmp_path):
    from gridseek.plans import pipeline

    (tmp_path / "csv").mkdir()
    for i, (title, words) in enumerate([("rivers", ["Nile", "Rhine", "Volga"]), ("planets", ["Mars", "Venus", "Earth"]), ("metals", ["Iron", "Gold", "Zinc"])]):
        (tmp_path / "csv" / f"{title}_SEP_T{i}.csv").write_text("name,score\n" + "".join(f"{w},{j}.5\n" for j, w in enumerate(words)))
    work = str(tmp_path / "work")
    pipeline.index_collection(spark, str(tmp_path / "csv"), work)
    q = spark.createDataFrame([("q", "planets name Venus")], "qid string, question string")
    top = pipeline.answer(spark, work, q)
    assert top.filter("place = 1").first().table_id == "T1"
    asked, truth = pipeline.training_questions(spark.read.parquet(f"{work}/rows"), 60)
    assert asked.count() > 0 and truth.count() >= asked.count()
    truth = spark.createDataFrame([("q", "T1")], "qid string, table_id string")
    assert {r.k: r.precision for r in pipeline.evaluate(top, truth).collect()} == {1: 100.0, 5: 100.0}


def test_stream_ingests_each_row_once(spark, tmp_path, city):
    from gridseek.streaming.ingest import ingest_passages

    sinks.write_tables(city, str(tmp_path / "in"))
    for _ in range(2):
        ingest_passages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_index_options():
    assert retrieval.index_options(10)["lists"] == 1
    assert retrieval.index_options(2_000_000) == {"lists": 4096, "codes": 384, "train": 2_000_000}


def test_common_length_like_the_table():
    rng = random.Random(2)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(120))] for _ in range(2))
        assert udf.common_length(a, b) == plain(a, b)


def test_quantiles_in_passes(spark, monkeypatch):
    monkeypatch.setattr(profile, "BINS", 7)
    rng = random.Random(3)
    for values in ([5], [3, 3, 3], [rng.randrange(-900, 900) ** 3 for _ in range(400)], [1] * 50 + [10**9]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "size long")
        row, got = profile.quantiles(df, [0.0, 0.1, 0.25, 0.5, 0.77, 1.0])
        assert got == pytest.approx(np.quantile(values, [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]).tolist()) and row["n"] == len(values)
    assert profile.quantiles(spark.createDataFrame([], "size int"), [0.5]) is None
    assert profile.fences(spark.createDataFrame([], "size int")).first().hi is None


def test_answers_in_texts(spark, monkeypatch):
    retr = spark.createDataFrame([(q, r, p) for q in (1, 2, 3, 4) for r, p in enumerate((10, 11, 12, 13), 1)], "qid int, rank int, p_id int")
    texts = spark.createDataFrame([(10, "The Nile, a river."), (11, "nile a"), (12, None), (13, "a a b"), (14, "not asked: river")], "p_id int, text string")
    answers = spark.createDataFrame([(1, ["river", "none"]), (2, ["NILE, a"]), (3, ["a a", ""]), (5, ["x"])], "qid int, answers array<string>")
    want = {(1, 10), (2, 10), (3, 13)}
    for limit in (100, -1):
        monkeypatch.setattr(metrics, "ANSWERS", limit)
        got = metrics.answered(retr, texts, answers).collect()
        assert {(r.qid, r.p_id) for r in got if r.correct} == want and len(got) == 16


def test_draws_meet_single_rows(spark):
    # a column that is empty but for one row, row numbers with gaps, a table without any filled cell, a null cell
    vals = [(f"a{i}", "only" if i == 777 else "", str(i % 3)) for i in range(0, 2000, 7)]
    rows = spark.createDataFrame(
        [("t", "title", 7 * i, ["a", "b", "c"], list(v)) for i, v in enumerate(vals)] + [("e", "", i, ["a", "b", "c"], ["", None, ""]) for i in range(20)],
        "table_id string, title string, row int, names array<string>, vals array<string>",
    )
    columns = rows.select("table_id").distinct().select("table_id", F.explode(F.array(*(F.struct(F.lit(i).alias("col"), F.lit(n).alias("col_name"), F.lit("text").alias("type")) for i, n in enumerate("abc")))).alias("c")).select("table_id", "c.*")
    drawn = sqlgen.sample_queries(rows, columns, 400).collect()
    held = {r["row"]: r["vals"] for r in rows.filter("table_id = 't'").collect()}
    assert drawn and {r["table_id"] for r in drawn} == {"t"}  # every draw of the empty table has a condition and no title
    for r in drawn:
        for c in r["conds"]:
            assert c["value"] == ("title" if c["col"] is None else held[r["row"]][c["col"]]) != ""
    rare = [r for r in drawn if any(c["col"] == 1 for c in r["conds"])]
    assert rare and {r["row"] for r in rare} == {7 * [v[1] for v in vals].index("only")}
    assert len({r["row"] for r in drawn if r["row"] is not None}) > 60
    again = sqlgen.sample_queries(rows.repartition(5), columns, 400).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, drawn))


def test_execution_against_plain_filters(spark):
    cells = [("x" if i % 3 else "y", str(i % 5) + ".5", None if i % 11 == 0 else f"v{i}") for i in range(300)]
    rows = spark.createDataFrame([("t", "The Title", i, ["k", "n", "v"], list(c)) for i, c in enumerate(cells)] + [("u", "Other", 0, ["k", "n", "v"], ["x", "1.5", "z"])], "table_id string, title string, row int, names array<string>, vals array<string>")
    types = spark.createDataFrame([(t, i, n, k) for t in "tu" for i, n, k in ((0, "k", "text"), (1, "n", "float"), (2, "v", "text"))], "table_id string, col int, col_name string, type string")
    conds = [
        [(0, 0, "y")], [(0, 0, "x"), (1, 1, "2")], [(1, 2, "3")], [(1, 0, "2.50")], [(None, 0, " the title ")], [(None, 0, "nope")],
        [(0, 0, "x"), (2, 0, "v7")], [(0, 0, "y"), (0, 0, "x")], [(0, 0, None)], [(0, 0, "y"), (None, 0, "The Title")], [(0, 0, "absent")],
    ]
    asked = [(f"q{i}_{agg}_{twin}", "t", 0, sel, agg, c) for i, c in enumerate(conds) for agg, sel in ((0, 2), (1, 1), (2, 1), (3, 2), (4, 1), (5, 1)) for twin in "ab"]
    queries = spark.createDataFrame(asked, "qid string, table_id string, row int, sel int, agg int, conds array<struct<col:int,op:int,value:string>>")

    def holds(v, c):
        col, op, x = c
        if col is None:
            return x.strip().lower() == "the title"
        if x is None or v[col] is None:
            return False
        if col == 1:
            return (float(v[1]) == float(x), float(v[1]) > float(x), float(v[1]) < float(x))[op]
        return v[col] == x

    want = {}
    for qid, _, _, sel, agg, cs in asked:
        hit = [v[sel] for v in cells if all(holds(v, c) for c in cs)]
        if hit:
            number = [float(x) for x in hit if x is not None] if sel == 1 else []
            want[qid] = ("|".join(x for x in hit if x is not None) if agg == 0 else str(sum(x is not None for x in hit)) if agg == 3
                         else f"{ {1: max, 2: min, 4: sum, 5: lambda z: sum(z) / len(z)}[agg](number):.4f}")
    got = {r["qid"]: r["result"] for r in sqlgen.execute(queries, rows, types).collect()}
    assert got == want


def test_vectors_of_tables(spark):
    rows = [(q, t, p, [float(p), -float(p), float(q)]) for q in range(3) for t in range(2) for p in range(1, 6)]
    df = spark.createDataFrame(rows, "qid int, table_id int, p_id int, features array<double>")
    out = ranking.table_max(df).collect()
    assert len(out) == len(rows) and all(r["top"] == [5.0, -1.0, float(r["qid"])] for r in out)
    pooled = {r["table_id"]: r["mean"] for r in ranking.mean_pooled(df.filter("qid = 0"), "table_id", "features", (F.col("p_id") <= 2).cast("int")).collect()}
    assert pooled == {0: [1.5, -1.5, 0.0], 1: [1.5, -1.5, 0.0]}
    assert ranking.mean_pooled(df, "table_id", "features", F.lit(0)).count() == 0
    one = df.groupBy().agg(F.collect_list("features").alias("v"), F.collect_list((F.col("p_id") == 5).cast("int")).alias("m")).select(mean_pool(F.col("v"), F.col("m"), 3).alias("x")).first()["x"]
    assert [round(x, 9) for x in one] == [5.0, -5.0, 1.0]


def test_grams_of_several_references(spark):
    pairs = spark.createDataFrame([(1, "a b c d e", ["a b c d", "x b c d e"]), (2, "", ["a"]), (3, "a a", ["a", "a a a"]), (4, "q", [])], "sid int, hyp string, refs array<string>")
    got = {r["sid"]: r["chrf"] for r in metrics.chrf(pairs).collect()}
    assert set(got) == {1, 2, 3} and got[1] > 80 and got[2] == 0  # the best reference counts; without references there is no score
    total = metrics.bleu4(pairs).first()
    # sentence 1: 5, 4, 3, 2 of 5, 4, 3, 2 n-grams are in some reference; sentence 3: 2 of 2 and 1 of 1; sentence 4: 0 of 1
    logs = math.log(7 / 8) + 0
    assert total["hyp_words"] == 8 and abs(total["bleu"] - round(100 * math.exp(logs / 4 + min(0, 1 - total["ref_words"] / 8)), 6)) < 1e-5
