"""Profiles of columns: types, sizes, fences, fit columns, and splits by hash."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from gridseek.functions import text as T
from gridseek.functions.udf import size_in_tokens


def column_types(columns: DataFrame, cells: DataFrame) -> DataFrame:
    """float if every cell is digits, a point and digits, else text; a column without cells is float. columns: table_id, col, col_name."""
    seen = cells.groupBy("table_id", "col").agg(F.bool_and(T.is_float(F.col("value"))).alias("f"))
    kind = F.when(F.coalesce("f", F.lit(True)), "float").otherwise("text")
    return columns.join(seen, ["table_id", "col"], "left").select("table_id", "col", "col_name", kind.alias("type"))


#: Bins of a pass of `quantiles`.
BINS = 4096


def quantiles(sizes: DataFrame, shares: list[float], value: str = "size") -> tuple[Row, list[float]] | None:
    """(n, lo, hi, mean) of whole numbers, and their exact quantiles between neighbours. None without any.

    Selection by histograms: a pass counts the numbers in equal bins of the range, the next ones only in the bins that hold
    a rank asked for, until a bin is one number. A pass sends on a row for each bin and the driver holds no more."""
    x = sizes.select(F.col(value).cast("long").alias("x")).filter("x IS NOT NULL").persist()
    try:
        all_ = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean")).first()
        if not all_["n"]:
            return None
        spots = [s * (all_["n"] - 1) for s in shares]
        spans = {r: (all_["lo"], all_["hi"], 0) for spot in spots for r in (math.floor(spot), math.ceil(spot))}  # rank -> range, and how many are below it
        while wide := sorted({s for s in spans.values() if s[0] < s[1]}):
            steps = [-(-(hi - lo + 1) // BINS) for lo, hi, _ in wide]
            at = F.lit(None).cast("struct<i: int, b: long>")
            for i, ((lo, hi, _), step) in enumerate(zip(wide, steps, strict=True)):
                at = F.when(F.col("x").between(lo, hi), F.struct(F.lit(i).alias("i"), F.floor((F.col("x") - lo) / step).alias("b"))).otherwise(at)
            bins: list[dict[int, int]] = [{} for _ in wide]
            for r in x.select(at.alias("at")).filter("at IS NOT NULL").groupBy("at").count().collect():  # ranks times BINS at most
                bins[r["at"]["i"]][r["at"]["b"]] = r["count"]
            for rank, span in spans.items():
                if span[0] < span[1]:
                    i, below = wide.index(span), span[2]
                    for b in sorted(bins[i]):
                        if below + bins[i][b] > rank:
                            spans[rank] = (span[0] + b * steps[i], min(span[1], span[0] + (b + 1) * steps[i] - 1), below)
                            break
                        below += bins[i][b]
        low, high = ([spans[f(spot)][0] for spot in spots] for f in (math.floor, math.ceil))
        return all_, [a + (b - a) * (spot - math.floor(spot)) for a, b, spot in zip(low, high, spots, strict=True)]
    finally:
        x.unpersist()


def fences(sizes: DataFrame, value: str = "size") -> DataFrame:
    """(lo, hi): 1 and the third quartile plus 1.5 times the interquartile range; null without sizes."""
    got = quantiles(sizes, [0.25, 0.75], value)
    return sizes.sparkSession.createDataFrame([(1.0, got[1][1] + 1.5 * (got[1][1] - got[1][0]) if got else None)], "lo double, hi double")


def good_columns(columns: DataFrame, most: int = 20, vocabulary: frozenset[str] | None = None) -> DataFrame:
    """Columns with a name of at most `most` tokens, pieces of a vocabulary if one is given."""
    return columns.filter(F.col("col_name") != "").withColumn("_n", size_in_tokens(F.col("col_name"), vocabulary)).filter(F.col("_n") <= most).drop("_n")


def complete_rows(rows: DataFrame, columns: list[int]) -> DataFrame:
    """Rows without an empty cell among the columns."""
    return rows.filter(F.forall(F.array(*map(F.lit, columns)), lambda i: F.coalesce(F.get("vals", i), F.lit("")) != ""))


def length_distribution(sizes: DataFrame, value: str = "size") -> DataFrame:
    tenths = [i / 10 for i in range(1, 11)]
    got = quantiles(sizes, tenths, value)
    row = (got[0]["lo"], got[0]["hi"], round(got[0]["mean"], 6), *(round(float(q), 6) for q in got[1])) if got else (None,) * 13
    return sizes.sparkSession.createDataFrame([row], "min_size int, max_size int, mean_size double, " + ", ".join(f"p{10 * i} double" for i in range(1, 11)))


def train_dev_split(tables: DataFrame, share: float = 0.2, seed: str = "split") -> DataFrame:
    """(table_id, part): int(n * share) tables, the first by md5, are dev. tables: table_id, a row for each table."""
    from gridseek.sources.tables import dense_ids

    keyed = tables.select("table_id", F.md5(F.concat_ws("/", F.lit(seed), "table_id")).alias("_h"))
    ranked = dense_ids(keyed, ["_h", "table_id"], "k").crossJoin(F.broadcast(tables.agg(F.count("*").alias("n"))))
    return ranked.select("table_id", F.when(F.col("k") <= F.floor(F.col("n") * share), "dev").otherwise("train").alias("part"))


def shuffled_parts(df: DataFrame, key: str, size: int = 1000, seed: str = "parts") -> DataFrame:
    """Rows in the order of md5, `size` to a part: ids are dense over a range partitioning."""
    from gridseek.sources.tables import dense_ids

    keyed = df.withColumn("_h", F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"))))
    return dense_ids(keyed, ["_h", key], "nth", 0).withColumn("part", F.floor(F.col("nth") / size)).drop("_h")


def exact_sample(df: DataFrame, key: str, n: int, seed: str = "sample") -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def sortish_batches(df: DataFrame, key: str, size: str, batch: int, blocks: int = 50, seed: str = "sortish") -> DataFrame:
    """Shuffle, sort each block of `blocks` batches by falling size, and put the batch of the largest first: (key, size, batch)."""
    from gridseek.sources.tables import dense_ids

    keyed = df.select(key, size, F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"))).alias("_h"))
    numbered = dense_ids(keyed, ["_h", key], "nth", 0).withColumn("block", F.floor(F.col("nth") / (blocks * batch)))
    within = F.row_number().over(Window.partitionBy("block").orderBy(F.desc(size), key)) - 1
    batched = numbered.withColumn("batch", F.col("block") * blocks + F.floor(within / batch))
    first = batched.agg(F.max(F.struct(F.col(size).alias("s"), (-F.col("batch")).alias("b"))).alias("m")).select((-F.col("m.b")).alias("first"))
    return batched.join(F.broadcast(first)).select(key, size, F.when(F.col("batch") == F.col("first"), 0).when(F.col("batch") < F.col("first"), F.col("batch") + 1).otherwise(F.col("batch")).cast("long").alias("batch"))
