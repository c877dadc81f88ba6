"""Writers of the interchange files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseek.operators.profile import shuffled_parts


def tables_of_rows(rows: DataFrame) -> DataFrame:
    """One record per table, as the JSON-lines files have it. A table is one record there by definition."""
    cell = F.transform("vals", lambda v: F.struct(v.alias("text")))
    ordered = F.array_sort(F.collect_list(F.struct("row", F.struct(cell.alias("cells")).alias("r"))))
    out = rows.groupBy(F.col("table_id").alias("tableId"), F.col("title").alias("documentTitle")).agg(F.first("names").alias("names"), ordered.alias("rs"))
    return out.select("tableId", "documentTitle", F.transform("names", lambda n: F.struct(n.alias("text"))).alias("columns"), F.transform("rs", lambda x: x["r"]).alias("rows"))


def write_tables(rows: DataFrame, path: str) -> None:
    tables_of_rows(rows).write.mode("overwrite").json(path)


def write_passages(passages: DataFrame, path: str) -> None:
    """JSON lines {p_id, passage, tag}."""
    tag = F.struct("table_id", "row", "sub_col", "obj_col").alias("tag")
    passages.select("p_id", "passage", tag).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_passage_parts(passages: DataFrame, path: str, parts: int) -> None:
    """TSV files (id, text, title) of consecutive ids, nearly equal in size."""
    passages.select(F.col("p_id").alias("id"), F.col("passage").alias("text"), F.col("title")).repartitionByRange(parts, "id").sortWithinPartitions("id").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_shuffled_parts(df: DataFrame, key: str, path: str, size: int = 1000) -> None:
    shuffled_parts(df, key, size).write.mode("overwrite").partitionBy("part").json(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    df.select("p_id", "embedding").write.mode("overwrite").parquet(path)


def write_checked(df: DataFrame, path: str) -> int:
    """Write as Parquet and hold the number of rows read back against what was sent."""
    counted = df.persist()
    n = counted.count()
    counted.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path).count()
    counted.unpersist()
    if back != n:
        raise OSError(f"{path}: {back} rows of {n}")
    return n


def read_checked(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """An index read back, held against the ids (p_id) that it must have: each once, and no others."""
    back = spark.read.parquet(path)
    seen = back.groupBy("p_id").agg(F.count("*").alias("n")).join(ids.select("p_id").distinct().withColumn("known", F.lit(True)), "p_id", "full")
    missing, foreign, twice = seen.agg(F.count_if(F.col("n").isNull()), F.count_if(F.col("known").isNull()), F.count_if(F.col("n") > 1)).first()
    if missing or foreign or twice:
        raise OSError(f"{path}: {missing} ids missing, {foreign} unknown, {twice} repeated")
    return back


def write_predictions(retr: DataFrame, questions: DataFrame, path: str) -> None:
    """JSON lines with parallel arrays in the order of score."""
    nested = retr.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "p_id", "passage", "table_id", "score"))).alias("c"))
    arrays = [F.col(f"c.{n}").alias(m) for n, m in (("p_id", "p_id_lst"), ("passage", "passages"), ("table_id", "tags"), ("score", "scores"))]
    questions.join(nested, "qid").select("qid", "question", "table_id_lst", *arrays).write.mode("overwrite").json(path)


def wrong_answers(retr: DataFrame, questions: DataFrame) -> DataFrame:
    """For an error log: each question whose first table is wrong, then its passages; retr has correct."""
    wrong = retr.filter("rank = 1 AND correct = 0").select("qid")
    head = questions.join(wrong, "qid", "left_semi").select("qid", F.lit(0).alias("line"), F.col("question").alias("text"), F.lit(None).cast("string").alias("table_id"))
    body = retr.join(wrong, "qid", "left_semi").select("qid", F.col("rank").alias("line"), F.col("passage").alias("text"), F.col("table_id").cast("string"))
    return head.union(body)


def write_error_log(retr: DataFrame, questions: DataFrame, path: str) -> None:
    log = wrong_answers(retr, questions)
    log.repartitionByRange("qid").sortWithinPartitions("qid", "line").write.mode("overwrite").csv(f"{path}/log", header=True, quoteAll=True)
    log.filter("table_id IS NOT NULL").select("table_id").distinct().write.mode("overwrite").text(f"{path}/tables")


def write_query_files(queries: DataFrame, path: str) -> None:
    """The query texts, one line each, the questions for them (if they have a `question`) likewise, and the records they belong to, all in the order of qid."""
    ordered = queries.repartitionByRange("qid").sortWithinPartitions("qid")
    if "question" in queries.columns:
        ordered.select(F.regexp_replace("question", r"[\r\n]", " ")).write.mode("overwrite").text(f"{path}/target")
    ordered.select(F.regexp_replace("sql_text", r"[\r\n]", " ")).write.mode("overwrite").text(f"{path}/source")
    ordered.write.mode("overwrite").json(f"{path}/meta")


def write_splits(parts: DataFrame, path: str) -> None:
    """The tables of each part (table_id, part), one line each in order of the id, in a folder for each part."""
    parts.select("part", F.col("table_id").cast("string")).repartition("part").sortWithinPartitions("part", "table_id").write.mode("overwrite").partitionBy("part").text(path)


def quoted_csv(columns: list[Column]) -> Column:
    """Every field in quotes, quotes doubled."""
    return F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in columns))


def csv_name(title: str, table_id: str) -> str:
    """A file name: slashes become spaces, leading points go, the id's last part is the suffix."""
    return f"{re.sub(r'^[.]+', '', title.replace('/', ' '))}-{table_id.rsplit('-', 1)[-1]}.csv"


def csv_texts(rows: DataFrame) -> DataFrame:
    """(file, text): each table as the text of a CSV file."""
    line = lambda a: F.array_join(F.transform(a, lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    ordered = F.array_sort(F.collect_list(F.struct("row", line("vals").alias("l"))))
    out = rows.groupBy("table_id", "title").agg(F.first(line("names")).alias("head"), ordered.alias("ls"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [csv_name(t, i) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), b.column(2)], names=["file", "text"])

    text = F.concat_ws("\n", "head", F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    return out.select("table_id", "title", text.alias("text")).mapInArrow(name, "file string, text string")


def html_page(place: Column, title: Column, names: Column, first_rows: Column) -> Column:
    """A ranked table as HTML. first_rows: array of arrays of cells."""
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), safe(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<h2>"), place.cast("string"), F.lit(". "), safe(title), F.lit("</h2><table>"), row(names, "th"), F.array_join(F.transform(first_rows, lambda r: row(r, "td")), ""), F.lit("</table>"))
