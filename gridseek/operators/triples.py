"""From table rows to passages. A row carries its header, so every generator works inside the row."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridseek.functions import text as T
from gridseek.functions.udf import tokens_of
from gridseek.sources.tables import dense_ids

BUDGET, STRIDE = 150, 2


def wrapped(rows: DataFrame) -> DataFrame:
    """Title, header and cells as triples want them: trimmed, and quoted if of several words."""
    each = lambda a: F.transform(a, T.quote_wrap)
    return rows.withColumns({"title": T.quote_wrap(F.col("title")), "names": each("names"), "vals": each("vals")})


def _pairs(with_title: bool) -> Column:
    """(s, o) column pairs of a row; s is null where the title is the subject."""
    n = F.size("vals")
    below = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    entry = lambda s, o: F.struct(s.cast("int").alias("s"), o.cast("int").alias("o"))
    inner = F.flatten(F.transform(below, lambda i: F.transform(F.filter(below, lambda j: j > i), lambda j: entry(i, j))))
    if not with_title:
        return inner
    about = F.when(F.col("title") != "", F.transform(below, lambda j: entry(F.lit(None), j))).otherwise(F.array().cast("array<struct<s:int,o:int>>"))
    return F.concat(about, inner)


def relation_triples(rows: DataFrame, with_title: bool = True, style: str = "annotated") -> DataFrame:
    """(table_id, row, sub_col, obj_col, passage): the title with each cell, and each two cells of a row. Empty cells count."""
    p = F.explode(_pairs(with_title)).alias("p")
    one = wrapped(rows).select("table_id", "title", "row", "names", "vals", p)
    at = lambda a, i: F.when(F.col(i).isNotNull(), F.get(a, F.col(i)))
    render = {"annotated": T.annotated, "tagged": T.tagged, "untagged": T.untagged}[style]
    passage = render(F.col("title"), at("names", "p.s"), at("vals", "p.s"), F.get("names", F.col("p.o")), F.get("vals", F.col("p.o")))
    return one.select("table_id", "row", F.col("p.s").alias("sub_col"), F.col("p.o").alias("obj_col"), passage.alias("passage"))


def with_passage_ids(passages: DataFrame, start: int = 1) -> DataFrame:
    return dense_ids(passages, ["table_id", "row", "sub_col", "obj_col"], "p_id", start)


def complete_graph(rows: DataFrame, with_title: bool = True) -> DataFrame:
    """(table_id, row, tuples): the `<H> s <R> r <T> o ` texts of a row in order, each once whatever its case."""
    cell = F.transform(F.arrays_zip("names", "vals"), lambda c: F.struct(T.strip(c["names"]).alias("n"), T.strip(c["vals"]).alias("v")))
    one = settled(rows.withColumn("title", T.strip(F.col("title"))), "c", cell)
    n = F.size("c")
    spots = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    text = lambda h, r, t: F.concat(F.lit("<H> "), h, F.lit(" <R> "), r, F.lit(" <T> "), t, F.lit(" "))
    about = F.transform(F.filter("c", lambda x: (x["n"] != "") & (x["v"] != "")), lambda x: text(F.col("title"), x["n"], x["v"]))
    own = lambda i: F.get("c", i)
    full = lambda i, j: (own(i)["v"] != "") & (own(j)["v"] != "") & (j > i)
    relation = lambda j: F.when(own(j)["n"] == "", F.lit(",")).otherwise(own(j)["n"])
    inner = F.flatten(F.transform(spots, lambda i: F.transform(F.filter(spots, lambda j: full(i, j)), lambda j: text(F.concat_ws(" ", own(i)["n"], own(i)["v"]), relation(j), own(j)["v"]))))
    one = settled(one, "inner", inner)
    if not with_title:
        return one.select("table_id", "row", _first_of_case(F.col("inner")).alias("tuples"))
    one = settled(one, "about", about)
    return one.select("table_id", "row", F.concat(_first_of_case(F.col("about")), _first_of_case(F.col("inner"))).alias("tuples"))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a one-row generator keeps the optimiser from copying it into each use."""
    return df.withColumn(name, F.explode(F.array(value)))


def _first_of_case(texts: Column) -> Column:
    """The first of texts that differ in case only."""
    low = F.transform(texts, F.lower)
    return F.filter(texts, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def pack_windows(sizes: list[int], budget: int = BUDGET, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Greedy windows [from, to) of at most `budget`, overlapping: the next starts `stride` on, but before the last end.

    A single size over the budget is an empty window."""
    upto = [0, *accumulate(sizes)]
    out, at, to = [], 0, -1
    while at < len(sizes) and to < len(sizes):
        to = max(at, bisect_right(upto, upto[at] + budget) - 1)
        out.append((at, to))
        at = max(at + 1, min(at + stride, to - 1))
    return out


def _by_row(fn: Callable[[dict], list[dict]], schema: str) -> tuple[Callable, str]:
    """An Arrow map and its schema; fn gives the output records of one input record."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([r for rec in b.to_pylist() for r in fn(rec)], kinds)

    return run, schema


def graph_passages(tuples: DataFrame, budget: int = BUDGET, vocabulary: frozenset[str] | None = None) -> DataFrame:
    """Passages of at most `budget` words, or pieces of a vocabulary, from the tuples of each row: (table_id, row, nth, passage)."""

    def size(text: str) -> int:
        return len(text.split()) if vocabulary is None else len(tokens_of(text, vocabulary))

    def fn(r: dict) -> list[dict]:
        spans = pack_windows([size(t) for t in r["tuples"]], budget)
        return [{"table_id": r["table_id"], "row": r["row"], "nth": k, "passage": "".join(r["tuples"][a:b])} for k, (a, b) in enumerate(spans)]

    run, kind = _by_row(fn, "table_id string, row int, nth int, passage string")
    return tuples.select("table_id", "row", "tuples").mapInArrow(run, kind)


def slide_windows(sizes: list[int], budget: int = BUDGET) -> list[list[int]]:
    """Windows of consecutive items: a full one is emitted and loses its first item, the new item is added even if
    the rest is full; a rest that is over the budget by itself is dropped at the next emission."""
    out: list[list[int]] = []
    held: list[int] = []
    for i, size in enumerate(sizes):
        load = sum(sizes[j] for j in held)
        if held and load and load + size > budget:
            out.append(held)
            held = held[1:]
            if sum(sizes[j] for j in held) > budget:
                held = []
        held = [*held, i]
    if held:
        out.append(held)
    return out


def sliding_passages(rows: DataFrame, budget: int = BUDGET, vocabulary: frozenset[str] | None = None) -> DataFrame:
    """(table_id, row, cols, passage) of consecutive cells of at most `budget` tokens, pieces of a vocabulary if one is given."""
    text = F.transform(F.arrays_zip("names", "vals"), lambda c: F.concat(F.when(c["names"] != "", F.concat(c["names"], F.lit("  "))).otherwise(""), T.strip(c["vals"]), F.lit("  ,  ")))
    item = F.transform(text, lambda t, i: F.struct(i.cast("int").alias("col"), t.alias("text"), T.token_size(t).alias("size"), ((F.get("names", i) == "") & (T.strip(F.get("vals", i)) == "")).alias("blank")))
    one = rows.select("table_id", "title", "row", F.filter(item, lambda x: ~x["blank"]).alias("items"))

    def fn(r: dict) -> list[dict]:
        out = slide_windows([x["size"] if vocabulary is None else len(tokens_of(x["text"], vocabulary)) for x in r["items"]], budget)
        return [{"table_id": r["table_id"], "row": r["row"], "cols": [r["items"][i]["col"] for i in w], "passage": r["title"] + "  .  " + " ".join(r["items"][i]["text"] for i in w)} for w in out]

    run, kind = _by_row(fn, "table_id string, row int, cols array<int>, passage string")
    return one.mapInArrow(run, kind)


def row_passages(rows: DataFrame) -> DataFrame:
    """(p_id from 0, passage, table_id, row)"""
    texts = rows.select("table_id", "row", T.row_text(F.col("title"), F.col("names"), F.col("vals")).alias("passage"))
    return dense_ids(texts, ["table_id", "row"], "p_id", 0)


def template_sample(rows: DataFrame, seed: str = "0") -> DataFrame:
    """One row for each (table, subject column, object column): the least by md5 of those whose texts are fit for a template."""
    one = rows.select("table_id", "row", "names", "vals", F.explode(_pairs(False)).alias("p"))
    sub, obj, rel = (F.get(a, F.col(i)) for a, i in (("vals", "p.s"), ("vals", "p.o"), ("names", "p.o")))
    fit = (sub != "") & (obj != "") & (T.token_size(sub) <= 20) & (T.token_size(obj) <= 20) & (T.token_size(rel) <= 10) & ((rel != "") | (sub != obj))
    key = F.md5(F.concat_ws("/", F.lit(seed), "table_id", F.col("p.s").cast("string"), F.col("p.o").cast("string"), F.col("row").cast("string")))
    picked = one.filter(fit).groupBy("table_id", F.col("p.s").alias("sub_col"), F.col("p.o").alias("obj_col"))
    return picked.agg(F.min(F.struct(key.alias("k"), "row", sub.alias("sub"), obj.alias("obj"))).alias("m")).select("table_id", "sub_col", "obj_col", "m.row", "m.sub", "m.obj")


def row_questions(rows: DataFrame, subjects: int = 3, most: int | None = None, seed: str = "0") -> DataFrame:
    """(table_id, row, question, answer) with the first columns as subjects; at most `most` of a row by md5 if given."""
    one = rows.select("table_id", "row", "names", "vals", F.explode(_pairs(False)).alias("p")).filter(F.col("p.s") < subjects)
    get = lambda a, i: T.strip(F.get(a, F.col(i)))
    out = one.select("table_id", "row", F.col("p.s").alias("s"), F.col("p.o").alias("o"), get("names", "p.s").alias("cls"), get("vals", "p.s").alias("sub"), get("names", "p.o").alias("rel"), get("vals", "p.o").alias("answer"))
    out = out.filter("sub <> '' AND rel <> '' AND answer <> ''")
    if most is not None:
        order = Window.partitionBy("table_id", "row").orderBy(F.md5(F.concat_ws("/", F.lit(seed), "s", "o")), "s", "o")
        out = out.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    return out.select("table_id", "row", T.natural_question(F.col("cls"), F.col("sub"), F.col("rel")).alias("question"), "answer")


def cond_permutations(queries: DataFrame) -> DataFrame:
    """Each order of a query's conditions with each word for the title: (qid, nth order, given, conds)."""
    n = F.size("conds")
    none = F.array(F.array().cast("array<int>"))
    spots = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    # grow all orders by one condition at a time; a query has four conditions at most
    orders = F.aggregate(spots, none.cast("array<array<int>>"), lambda acc, _: F.flatten(F.transform(acc, lambda p: F.transform(F.filter(spots, lambda i: ~F.array_contains(p, i)), lambda i: F.concat(p, F.array(i))))))
    one = queries.select("qid", "conds", F.posexplode(orders).alias("nth", "o"))
    worded = one.withColumn("given", F.explode(F.array(F.lit("about"), F.lit("given"))))
    return worded.select("qid", "nth", "given", F.transform("o", lambda i: F.get("conds", i)).alias("conds"))


def template_fanout(templates: DataFrame, rows: DataFrame) -> DataFrame:
    """A template text with [S] and [O] for (table_id, sub_col, obj_col), filled from every row of its table."""
    full = templates.join(rows.select("table_id", "row", "vals"), "table_id")
    sub, obj = F.get("vals", F.col("sub_col")), F.get("vals", F.col("obj_col"))
    return full.select("table_id", "row", "sub_col", "obj_col", F.replace(F.replace("template", F.lit("[S]"), sub), F.lit("[O]"), obj).alias("passage"))


#: Passage strategies by name: ROWS -> passages, and the column that orders the passages of a row.
STRATEGIES = {
    "RelationGraph": (relation_triples, None),
    "TextTag": (lambda rows: relation_triples(rows, style="tagged"), None),
    "CompleteGraph": (lambda rows: graph_passages(complete_graph(rows)), "nth"),
    "GraphNoCaption": (lambda rows: graph_passages(complete_graph(rows, with_title=False)), "nth"),
    "slide": (sliding_passages, "cols"),
    "row": (lambda rows: row_passages(rows).drop("p_id"), "row"),
}


def passages(rows: DataFrame, strategy: str = "RelationGraph") -> DataFrame:
    """The passages of a strategy with dense ids from 1: p_id, passage, table_id, row and what else the strategy says of them."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no passage strategy {strategy}; there are {', '.join(STRATEGIES)}")
    made, order = STRATEGIES[strategy]
    return with_passage_ids(made(rows)) if order is None else dense_ids(made(rows), list(dict.fromkeys(["table_id", "row", order])), "p_id")
