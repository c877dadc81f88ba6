"""Incremental ingestion: new table files become passages as they arrive (an extension; the batch entries don't need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridseek import schema
from gridseek.operators.triples import relation_triples
from gridseek.sources.tables import rows_of_tables


def table_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """ROWS of the JSON-lines table files that arrive in a folder."""
    return rows_of_tables(spark.readStream.schema(schema.TABLE).option("maxFilesPerTrigger", files).json(folder))


def ingest_passages(spark: SparkSession, folder: str, out: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Append the passages of new tables to `out`; a row that comes again within the delay is taken once.

    The state of the deduplication is bounded by the watermark over arrival."""
    rows = table_stream(spark, folder).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay)
    once = rows.dropDuplicatesWithinWatermark(["table_id", "row"])
    passages = relation_triples(once)
    return passages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
