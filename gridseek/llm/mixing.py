"""Mixing sources to target weights with hash-threshold histograms.

A document's place in its source's order is a hash of the document, so nothing is sorted. Words are summed
by (source, hash bucket); running sums over the buckets of a source find the bucket where its budget ends.
Only that boundary bucket is split further, by the next bits of the hash, LEVELS times; at the last level
the boundary bucket goes in or out as a whole, whichever is nearer. A document is then taken iff its hash
is below its source's threshold. Budgets nest: a smaller target takes a subset of what a larger one takes.

Targets: sources in code-point order, null last, weigh `weights` in turn and share `share` times all
words; a target stops at `most` times its source's words and the excess is shared again by weight. The
fixed point is target = min(weight * level, most * words), and the level is found in one pass over the
sources in order of most * words / weight.

Cases: null text has size 0; null sources are one source, the last; null doc_ids hash like a value; equal
rows share a hash and stay together; a source without words has target 0; texts of any length are only
counted; an empty table gives none. Extra columns, of any name, are ignored by `mix_plan` and kept by `mix`.
The windows over sources hold a row a source in one task. All plain DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.llm.common import checkpointed, size_of_words

BITS, LEVELS = 12, 4
#: A table of sources up to this many rows is broadcast (about 100 bytes a row); beyond, it is a shuffled join.
BROADCAST_ROWS = 50_000


def bucket(level: int) -> Column:
    """The bucket of the hash `h` (60 bits) at a level, from the top bits down."""
    return F.shiftright("h", 60 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """A row for each source (s, words) with its target. Windows run over one row per source, never over documents."""
    by_name = Window.orderBy(F.col("s").asc_nulls_last())
    ring = F.array(*(F.lit(float(w)) for w in weights))
    by_fill = Window.orderBy("fill", F.col("s").asc_nulls_last())
    everything = Window.partitionBy()
    return (
        totals.withColumn("weight", ring[(F.row_number().over(by_name) - 1) % len(weights)])
        .withColumn("fill", F.lit(most) * F.col("words") / F.col("weight"))  # the level at which the source is full
        .withColumn("full", F.sum(F.lit(most) * F.col("words")).over(by_fill) - F.lit(most) * F.col("words"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(by_fill) + F.col("weight"))
        .withColumn("level", (F.lit(share) * F.sum("words").over(everything) - F.col("full")) / F.col("weight_left"))
        # it rises while the sources before are full, and falls from the first that isn't
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("weight") * F.col("level"), F.lit(most) * F.col("words")))
        .select("s", "words", "target")
    )


def _joined(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    right = F.broadcast(sources) if small else sources
    return rows.join(right.withColumnRenamed("s", "_s"), F.col("s").eqNullSafe(F.col("_s")), "inner").drop("_s")


def _thresholds(rows: DataFrame, targets: DataFrame, small: bool) -> DataFrame:
    """For each source the times that all of it is taken, and the hash below which it is taken once more."""
    targets = targets.withColumn("times", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(F.lit(0)).cast("long"))
    edge = targets.withColumn("left", F.col("target") - F.col("times") * F.col("words")).select("s", "times", "left", F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        last = level == LEVELS - 1
        # rows in the boundary so far: those whose top bits are those of `below`
        top = F.shiftright("h", 60 - BITS * level) if level else F.lit(0).cast("long")
        inside = _joined(rows, edge.select("s", "below"), small).filter(top == (F.shiftright("below", 60 - BITS * level) if level else F.lit(0).cast("long")))
        sums = inside.groupBy("s", bucket(level).alias("b")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s").orderBy("b")
        nested = sums.withColumnRenamed("s", "_s").join(F.broadcast(edge) if small else edge, F.col("s").eqNullSafe(F.col("_s")), "right").drop("_s")
        nested = nested.withColumn("upto", F.coalesce(F.sum("n").over(run), F.lit(0)))
        fits = F.col("upto") <= F.col("left") if not last else F.col("upto") - F.col("n") / 2 <= F.col("left")
        # the boundary is the first bucket that doesn't fit whole (after the last one, if all fit)
        edge = checkpointed(
            nested.groupBy("s", "times", "left", "below")
            .agg(F.coalesce(F.min(F.when(~fits, F.col("b"))), F.lit(1 << BITS)).alias("b"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("taken"))
            .select("s", "times", (F.col("left") - F.col("taken")).alias("left"), (F.col("below") + F.shiftleft(F.col("b"), 60 - BITS * (level + 1))).alias("below"))
        )
    return edge.select("s", "times", "below")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return _plan(docs.select(docs[id_col].alias("id"), docs[source_col].alias("s"), size_of_words(docs[text_col]).alias("size"), _hash(docs[id_col], docs[text_col])), weights, share, most).select(
        F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target", "taken"
    )


def _hash(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 over id and text, which other engines can compute too."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("h")


def _plan(slim: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    rows = checkpointed(slim)
    totals = checkpointed(rows.groupBy("s").agg(F.sum("size").alias("words")))
    small = totals.count() <= BROADCAST_ROWS
    targets = checkpointed(source_targets(totals, weights, share, most))
    edges = _thresholds(rows, targets, small)
    per_source = targets.withColumnRenamed("s", "_s").join(edges, F.col("s").eqNullSafe(F.col("_s"))).drop("_s")
    taken = F.col("size") * (F.col("times") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
    return _joined(rows, per_source, small).withColumn("taken", taken)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {c: plain[f"c{names.index(c)}"] for c in (id_col, text_col, source_col)}
    slim = plain.select(at[source_col].alias("s"), size_of_words(at[text_col]).alias("size"), _hash(at[id_col], at[text_col]))
    rows = checkpointed(slim)
    totals = checkpointed(rows.groupBy("s").agg(F.sum("size").alias("words")))
    small = totals.count() <= BROADCAST_ROWS
    edges = _thresholds(rows, source_targets(totals, weights, share, most), small)
    marked = _joined(plain.withColumn("s", at[source_col]).withColumn("h", _hash(at[id_col], at[text_col])), edges, small)
    times = (F.col("times") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).cast("int")
    copies = marked.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return copies.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)
