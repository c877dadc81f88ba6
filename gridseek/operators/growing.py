"""Inverted lists that take further vectors.

New vectors go to the lists of their nearest centroids as further files; nothing that is stored is read for that. Each
batch leaves what it brought a list: how many vectors, and how far from the centroid on average, so drift is known
without the vectors. Lists that have grown too large are split by k-means of their own vectors, and those that have too
few go to their neighbours; only these lists are read and written again. Changed lists get new numbers, and a
version of the centroids says which numbers count, so a reader or a rewriting that is lost midway sees the old ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseek.config import discard, exists
from gridseek.operators import retrieval as V

#: Vectors of a list that its split is fitted on, at most about.
SAMPLE = 4096


class GrowingIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, passages: DataFrame, path: str, lists: int, train: int = 65_536) -> GrowingIndex:
        """passages: p_id, table_id, embedding; the first batch, which the centroids are fitted on."""
        own = cls(passages.sparkSession, path)
        V.coarse_centroids(passages, lists, train).write.mode("overwrite").parquet(f"{path}/centroids-0")
        own.add(passages)
        return own

    @property
    def version(self) -> int:
        v = 0
        while exists(self.spark, f"{self.path}/centroids-{v + 1}/_SUCCESS"):
            v += 1
        return v

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids-{self.version}")

    @property
    def lists(self) -> DataFrame:
        """list, p_id, table_id, embedding of the current lists."""
        numbers = [r["list"] for r in self.centroids.select("list").collect()]  # a row a list
        return self.spark.read.parquet(f"{self.path}/lists").filter(F.col("list").isin(numbers))

    def _written(self, assigned: DataFrame, centroids: DataFrame) -> None:
        gap = F.sqrt(F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), "centroid", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x))
        rows = assigned.persist()
        rows.select("p_id", "table_id", "embedding", "list").repartition("list", F.pmod(F.xxhash64("p_id"), F.lit(16))).sortWithinPartitions("list", "p_id").write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")
        brought = rows.join(F.broadcast(centroids), "list").groupBy("list").agg(F.count("*").alias("n"), F.avg(gap).alias("gap")).withColumn("batch", F.current_timestamp())
        brought.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        rows.unpersist()

    def add(self, passages: DataFrame) -> None:
        centroids = self.centroids
        self._written(V.assign_lists(passages, centroids), centroids)

    def drift(self) -> DataFrame:
        """(list, n, first, last, drift): vectors, their mean distance from the centroid in the first and in the last batch, and how much that has grown."""
        numbers = self.centroids.select("list")
        seen = self.spark.read.parquet(f"{self.path}/batches").join(F.broadcast(numbers), "list")
        per = seen.groupBy("list").agg(F.sum("n").alias("n"), F.min_by("gap", "batch").alias("first"), F.max_by("gap", "batch").alias("last"))
        return per.withColumn("drift", F.col("last") / F.when(F.col("first") > 0, F.col("first")) - 1)

    def rebalance(self, most: int, least: int = 0, seed: int = 5) -> dict[str, int]:
        """Split lists of more than `most` vectors, and give those of fewer than `least` to their neighbours."""
        size = {r["list"]: r["n"] for r in self.drift().collect()}  # a row a list
        known = {r["list"]: r["centroid"] for r in self.centroids.collect()}
        large = {n: -(-size[n] // most) for n in known if size.get(n, 0) > most}
        small = [n for n in known if size.get(n, 0) < least and n not in large][: max(0, len(known) - 1)]
        if not large and not small:
            return {"split": 0, "merged": 0}
        read = self.lists
        # a small list goes to its nearest neighbour, which gets a new number too
        stays = np.array([n for n in known if n not in small])
        c = np.array([known[n] for n in stays])
        near = {int(stays[((c - np.array(known[n])) ** 2).sum(1).argmin()]) for n in small} - set(large)
        moving = {*large, *small, *near}
        new = {n: c for n, c in known.items() if n not in moving}
        stored = self.spark.read.parquet(f"{self.path}/lists").agg(F.max("list")).first()[0]
        free = 1 + max(*known, stored or 0)  # beyond what a lost rewriting may have left
        new |= {free + i: known[n] for i, n in enumerate(sorted(near))}
        if large:
            share = F.lit(1.0)
            for n in large:
                share = F.when(F.col("list") == n, min(1.0, SAMPLE / size[n])).otherwise(share)
            sample = read.filter(F.col("list").isin(list(large))).filter(F.pmod(F.xxhash64("p_id"), F.lit(1 << 30)) < share * (1 << 30))

            def fit(t: pa.Table) -> pa.Table:
                n = int(t.column("list")[0].as_py())
                c = V._centers(V._numbers(t.column("embedding")), large[n], 8, seed)
                return pa.table([pa.array(np.full(len(c), n, np.int32)), pa.array(c.tolist(), pa.list_(pa.float64()))], names=["list", "centroid"])

            parts = sample.select("list", "embedding").groupBy("list").applyInArrow(fit, "list int, centroid array<double>").orderBy("list", "centroid").collect()
            new |= {free + len(near) + i: r["centroid"] for i, r in enumerate(parts)}
        centroids = self.spark.createDataFrame([(n, list(c)) for n, c in sorted(new.items())], "list int, centroid array<double>")
        moved = read.filter(F.col("list").isin(sorted(moving))).select("p_id", "table_id", "embedding")
        self._written(V.assign_lists(moved, centroids.filter(F.col("list") >= free)), centroids)
        centroids.write.parquet(f"{self.path}/centroids-{self.version + 1}")
        for n in moving:
            discard(self.spark, f"{self.path}/lists/list={n}")
        return {"split": len(large), "merged": len(small)}

    def search(self, questions: DataFrame, k: int, nprobe: int) -> DataFrame:
        return V.ivf_search(self.lists, self.centroids, questions, k, nprobe)
