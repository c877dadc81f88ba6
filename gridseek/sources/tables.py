"""Readers: collections of tables from CSV, JSON lines or DataFrames, and the files around them.

The working form is one record per table row, with the header beside the values (`schema.ROWS`): what is
derived from a row needs no shuffle. `cells` is its long form."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridseek import schema
from gridseek.functions import text as T


def from_dataframe(df: DataFrame, table_id: Column, title: Column, key: list[str], columns: dict[str, Column]) -> DataFrame:
    """ROWS of a relational table split by table_id; rows of a table are numbered by key."""
    order = Window.partitionBy("table_id").orderBy(*key)
    named = df.withColumn("table_id", table_id).withColumn("title", title)
    numbered = named.withColumn("row", (F.row_number().over(order) - 1).cast("int"))
    return numbered.select("table_id", "title", "row", F.array(*map(F.lit, columns)).alias("names"), F.array(*columns.values()).alias("vals"))


def cells(rows: DataFrame) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip("names", "vals")).alias("col", "c")
    return rows.select("table_id", "title", "row", zipped).select("table_id", "title", "row", "col", F.col("c.names").alias("col_name"), F.col("c.vals").alias("value"))


def rows_of_cells(long: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("col", "col_name", "value")))
    return long.groupBy("table_id", "title", "row").agg(ordered.alias("c")).select("table_id", "title", "row", F.col("c.col_name").alias("names"), F.col("c.value").alias("vals"))


def resolve_title(name: Column, meta_title: Column, meta_id: Column) -> tuple[Column, Column]:
    """(table_id, title): a sidecar first, then `<title>_SEP_<id>`, then the file's name with a digest for the id."""
    sep = F.instr(name, "_SEP_") > 0
    parts = F.split(name, "_SEP_")
    title = F.coalesce(meta_title, F.when(sep, parts[0]).otherwise(name))
    return F.coalesce(meta_id, F.when(sep, parts[1]).otherwise(F.concat(name, F.lit("_"), F.sha2(name, 256)))), title


def read_csv_tables(spark: SparkSession, root: str) -> DataFrame:
    """ROWS of all CSV files under root, each with its own header; `<file>.meta.json` may give id, title and names.

    A file is parsed by one task, a row at a time; a record of another width than the header is an error. An empty file gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root).select("path", "content")
    # the same listing with the schema fixed, so that a folder without sidecars is no error
    side = spark.read.schema("table_id string, title string, col_names array<string>").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").option("multiLine", "true").json(root)
    side = side.withColumn("stem", F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", "")).select("stem", F.col("table_id").alias("m_id"), F.col("title").alias("m_title"), "col_names")
    joined = files.withColumn("stem", F.regexp_replace(F.regexp_replace("path", r"\.csv$", ""), "^file:/+", "/")).join(side.withColumn("stem", F.regexp_replace("stem", "^file:/+", "/")), "stem", "left")
    name = F.regexp_replace(T.title_of_path(F.col("path")), "%20", " ")
    table_id, title = resolve_title(name, F.col("m_title"), F.col("m_id"))
    known = joined.select(table_id.alias("table_id"), title.alias("title"), "col_names", "content", "path")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for b in batches:
            for t, title_, own, data, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""))
                header = next(lines, None)
                if header is None:
                    continue
                out: list[list] = []
                for n, line in enumerate(lines):
                    if len(line) != len(header):
                        raise ValueError(f"{path}: record {n} has {len(line)} fields, the header {len(header)}")
                    out.append([t, title_, n, own or header, line])
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(("table_id", "title", "row", "names", "vals"), r, strict=True)) for r in out], _ARROW)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(("table_id", "title", "row", "names", "vals"), r, strict=True)) for r in out], _ARROW)

    return known.mapInArrow(parse, schema.ROWS)


_ARROW = pa.schema([("table_id", pa.string()), ("title", pa.string()), ("row", pa.int32()), ("names", pa.list_(pa.string())), ("vals", pa.list_(pa.string()))])


def read_jsonl_tables(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """ROWS of a JSON-lines file of tables, of the ids in `only` (table_id) if given."""
    tables = spark.read.schema(schema.TABLE).json(path)
    if only is not None:
        tables = tables.join(only.select(F.col("table_id").alias("tableId")), "tableId", "left_semi")
    return rows_of_tables(tables)


def rows_of_tables(tables: DataFrame) -> DataFrame:
    names = F.transform("columns", lambda c: c["text"])
    row = tables.select("tableId", "documentTitle", names.alias("names"), F.posexplode("rows").alias("row", "r"))
    return row.select(F.col("tableId").alias("table_id"), F.col("documentTitle").alias("title"), "row", "names", F.transform("r.cells", lambda c: c["text"]).alias("vals"))


def row_chunks(rows: DataFrame, size: int = 1000) -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col("row") / size).cast("int"))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.PASSAGE).json(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def number_examples(examples: DataFrame) -> DataFrame:
    """Fill a missing id by the ordinal, and a context's missing score by 1 / (ordinal + 1). examples: ord, id, ctxs."""
    fill = F.transform("ctxs", lambda c: c.withField("score", F.coalesce(c["score"], 1.0 / (F.col("ord") + 1))))
    return examples.withColumn("id", F.coalesce("id", F.col("ord").cast("string"))).withColumn("ctxs", fill)


def read_tsv(spark: SparkSession, path: str, ids: DataFrame | None = None, key: str = "id") -> DataFrame:
    out = spark.read.csv(path, sep="\t", header=True)
    return out if ids is None else out.join(ids.select(key), key, "left_semi")


def read_wiki_passages(spark: SparkSession, path: str) -> DataFrame:
    """(p_id, title, passage) of a TSV file of passages: id, text, title; a text may be quoted, with quotes doubled."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    return raw.select(F.col("id").cast("long").alias("p_id"), F.col("title"), F.col("text").alias("passage"))


def numbered_lines(spark: SparkSession, path: str, name: str = "text") -> DataFrame:
    """(line, text): the lines of a text file from 0, by the position of their block in the file and their place in it."""
    read = spark.read.text(path).select(F.col("value").alias(name), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    first = read.groupBy("_f", "_b").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))  # a row for each block
    offset = first.select(F.col("_f"), F.col("_b"), "_first", (F.sum("_n").over(Window.orderBy("_f", "_b")) - F.col("_n")).alias("_o"))
    return read.join(F.broadcast(offset), ["_f", "_b"]).select((F.col("_o") + F.col("_i") - F.col("_first")).alias("line"), name)


def zipped_lines(spark: SparkSession, meta: str, questions: str) -> DataFrame:
    """(line, meta, question) of two files whose lines belong together by position; unequal lengths are an error."""
    a, b = numbered_lines(spark, meta, "meta"), numbered_lines(spark, questions, "question")
    both = a.join(b, "line", "full")
    return both.select("line", *(F.coalesce(c, F.raise_error(F.lit(f"no {c} for a line"))).alias(c) for c in ("meta", "question")))


def relevance_lists(judged: DataFrame) -> DataFrame:
    """(qid, gold): the tables judged 1; a question without any keeps an empty list. judged: qid, table_id, label."""
    return judged.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("label") == 1, F.col("table_id")))).alias("gold"))


def interaction_questions(interactions: DataFrame) -> DataFrame:
    """(qid, question, table_id, answers) of recorded interactions."""
    q = interactions.select(F.col("table.tableId").alias("table_id"), F.explode("questions").alias("q"))
    extra = F.flatten(F.transform(F.coalesce("q.alternativeAnswers", F.array()), lambda a: a["answerTexts"]))
    return q.select(F.col("q.id").alias("qid"), F.col("q.originalText").alias("question"), "table_id", F.concat("q.answer.answerTexts", F.coalesce(extra, F.array())).alias("answers"))


def grid_tables(spark: SparkSession, path: str) -> DataFrame:
    """ROWS of JSON lines {id, caption, subcaption, data: [[...]]}; the first record is the header."""
    raw = spark.read.schema("id string, caption string, subcaption string, data array<array<string>>").json(path)
    title = F.concat("caption", F.when(F.coalesce("subcaption", F.lit("")) != "", F.concat(F.lit(" , "), F.col("subcaption"))).otherwise(""))
    body = raw.select(F.col("id").alias("table_id"), title.alias("title"), F.col("data")[0].alias("names"), F.posexplode(F.slice("data", F.lit(2), F.greatest(F.size("data") - 1, F.lit(0)))).alias("row", "vals"))
    return body.select("table_id", "title", "row", "names", "vals")


def graph_entries(spark: SparkSession, path: str) -> DataFrame:
    """(eid, triples, references) of an XML benchmark of triple sets."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema("_eid string, modifiedtripleset struct<mtriple: array<string>>, lex array<struct<_VALUE: string>>").load(path)
    return raw.select(F.col("_eid").alias("eid"), F.transform("modifiedtripleset.mtriple", lambda t: F.split(t, r" \| ")).alias("triples"), F.transform("lex", lambda x: x["_VALUE"]).alias("references"))


def dense_ids(df: DataFrame, keys: list[str], name: str, start: int = 1) -> DataFrame:
    """Gapless ids in the order of keys: a range partitioning, then each partition's offset; no single-task sort."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    held = placed.persist()
    sizes = held.groupBy("_p").count()  # a row for each partition
    offset = sizes.select(F.col("_p").alias("_q"), (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_o"))
    return held.join(F.broadcast(offset), F.col("_p") == F.col("_q")).withColumn(name, F.col("_o") + F.col("_i") + start).drop("_p", "_q", "_i", "_o")
