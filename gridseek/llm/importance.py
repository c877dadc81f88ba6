"""Importance resampling towards a target by hashed n-grams, over a dictionary of distinct features.

Each block of texts sends its distinct n-grams once to the parts of a global dictionary (`gridseek.llm.dictionary`),
with the documents that have them. A part counts its strings over the whole corpus and the target, hashes each
distinct string once, and adds the counts up by bucket. The buckets' gains (a table of fixed size) are then joined to
the documents' feature counts where these lie, with the dictionary's parts; what goes back to a block is a sum for
each of its documents. Ids never leave the block's own row until the sums come back.

A document is drawn by its weight, the floored mean gain of its features, plus Gumbel noise from a hash of its id;
ranks come from a range partitioning and an offset for each partition.

Cases: a null text has no features, and one without any has weight 0; a null doc_id hashes like an empty one and
sorts first among ties; repeated rows are rows of their own and count twice; an empty corpus gives an empty result,
an empty target or none of the features counts of 0; a text of any length is cut into pieces between words; extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.llm import dictionary as D
from gridseek.llm.common import Block, Hasher, U64, folder, kept_in, mix, remove, small_batches, utf8

#: Lower case of A-Z; what isn't a digit, a letter or beyond ASCII is a space.
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_WORD = _PLAIN != 32
_STEP = U64(0x9FB21C651E98DF25)
FEATURES, DOCS, BUCKETS, SUMS = range(4)


class Features:
    """Distinct words and pairs of neighbours of a block, with the documents that hold them."""

    def __init__(self, block: Block, ghost: bool):
        """ghost: the first word is there only as the second's neighbour."""
        b, doc = block, block.word_doc()
        key, first, word = np.unique(Hasher(b.buf).spans(b.starts, b.ends), return_index=True, return_inverse=True)
        n, docs = max(len(key), 1), max(b.n, 1)
        keep = np.ones(len(word), bool)
        keep[:1] = not ghost
        singles = np.sort(word[keep] * docs + doc[keep])
        near = doc[1:] == doc[:-1]
        pairs = np.sort(((word[:-1] * n + word[1:]) * docs + doc[1:])[near])
        self.n_words = np.bincount(doc[keep], minlength=b.n)
        self.n_features = self.n_words + np.bincount(doc[1:][near], minlength=b.n)
        # postings: equal neighbours are the times that a document has a feature
        flat = np.concatenate([singles, pairs])
        edge = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
        edge[len(singles) : len(singles) + 1] = True
        at = np.flatnonzero(edge)
        self.times = np.diff(np.append(at, len(flat)))
        posted, is_pair = flat[at], at >= len(singles)
        self.doc, feature = posted % docs, posted // docs
        edge = np.append(True, (feature[1:] != feature[:-1]) | (is_pair[1:] != is_pair[:-1]))[: len(feature)]
        at = np.flatnonzero(edge)
        self.df, feature, is_pair = np.diff(np.append(at, len(edge))), feature[at], is_pair[at]
        # each feature is one or two words of this text
        size = b.ends[first] - b.starts[first]
        self.text = D.gather(np.append(b.buf, np.uint8(32)), b.starts[first], size + 1)
        spots = np.cumsum(size + 1) - size - 1
        self.text[spots + size] = 32
        head, tail = np.where(is_pair, feature // n, feature), feature % n
        self.starts = np.stack([spots[head], spots[tail]], axis=1) if len(spots) else np.zeros((0, 2), np.int64)
        self.lengths = np.stack([size[head] + is_pair, size[tail] * is_pair], axis=1) if len(size) else np.zeros((0, 2), np.int64)
        self.hash = np.where(is_pair, mix(key[head] * _STEP + key[tail]), key[head]) if len(key) else np.zeros(0, U64)

    def packs(self, n_parts: int) -> Iterator[tuple[int, list[bytes]]]:
        """(part, data): the strings' bytes and lengths, how many documents have each, which, and how often. Strings come by their first document."""
        begin = np.cumsum(self.df) - self.df
        by_doc = np.argsort(self.doc[begin].astype(np.uint16), kind="stable")
        order, parts, edges = D.packs(D.spread(mix(self.hash), n_parts)[by_doc], n_parts)
        order = by_doc[order]
        size, df = self.lengths[order].sum(1), self.df[order]
        strings = D.gather(self.text, self.starts[order].ravel(), self.lengths[order].ravel())
        ends, upto = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(df))
        for part, lo, hi in zip(parts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own, to = df[lo:hi], upto[lo:hi] - upto[lo]
            posts = np.arange(upto[hi] - upto[lo]) + np.repeat(begin[order[lo:hi]] - to, own)
            gaps = np.diff(self.doc[posts], prepend=0)
            gaps[to] = np.diff(self.doc[posts[to]], prepend=0)
            yield part, [D.squeezed(strings[ends[lo] : ends[hi]].tobytes()), D.shrunk(size[lo:hi]), D.shrunk(own), D.shrunk(gaps), D.shrunk(self.times[posts])]


def _documents(df: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The documents of a pack's strings, from gaps: a string's first document follows that of the string before."""
    to = np.cumsum(df) - df
    rest = gaps.copy()
    rest[to] = 0
    rest = np.cumsum(rest)
    return np.repeat(np.cumsum(gaps[to]) - rest[to], df) + rest


def _packed(texts: DataFrame, n_parts: int, target: bool) -> DataFrame:
    """The packs of blocks of texts (id, text), and a row for each block with its documents' ids and sizes."""
    kind = texts.schema["id"].dataType.simpleString()

    def block(ids: pa.Array, buf: np.ndarray, offsets: np.ndarray, number: int, first: int, ghost: bool) -> pa.RecordBatch:
        found = Features(Block(buf, offsets), ghost)
        items = [(part, number, FEATURES, [*data, bytes([target])]) for part, data in found.packs(n_parts)]
        if not target:
            items.append((n_parts + number % n_parts, number, DOCS, [D.shrunk(found.n_features), D.shrunk(found.n_words), D.shrunk(np.array([first]))]))
        out = D.rows(items)
        empty = pa.array([None] * (len(items) - 1), pa.list_(ids.type))
        own = pa.concat_arrays([empty, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]) if not target else pa.array([None] * len(items), pa.list_(ids.type))
        return pa.RecordBatch.from_arrays([*out.columns, own], names=[*out.schema.names, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (2 * TaskContext.get().partitionId() + target) << 20
        held: list[pa.RecordBatch] = []

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            raw, offsets = utf8(t.column(1))
            ids, ghost, first = t.column(0).combine_chunks(), 0, 0
            for at, to, lo, hi in D.cuts(raw, offsets, _WORD, D.BLOCK_BYTES):
                whole = lo == offsets[at]
                first = number if whole else first
                start = lo if whole else ghost
                edges = np.clip(offsets[at : to + 1], start, hi) - start
                yield block(ids[at:to], _PLAIN[raw[start:hi]], edges, number, first, start < lo)
                inside = np.flatnonzero(_WORD[raw[lo:hi]]) if to == at + 1 and hi < offsets[to] else ()
                if len(inside):  # the piece's last word goes before the next one
                    last = lo + int(inside[-1])
                    before = np.flatnonzero(~_WORD[raw[start:last]])
                    ghost = start + int(before[-1]) + 1 if len(before) else start
                else:
                    ghost = hi
                number += 1

        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                held.append(s)
                size += int(utf8(s.column(1))[1][-1])
                if size >= D.BLOCK_BYTES or sum(x.num_rows for x in held) >= D.BLOCK_DOCS:
                    yield from settle()
                    size = 0
        if sum(x.num_rows for x in held):
            yield from settle()

    return texts.mapInArrow(run, f"{D.ROWS}, ids array<{kind}>")


def _counted(buckets: int):
    """A part of the dictionary: each distinct string is hashed once, its counts go to its bucket."""

    def run(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_pylist()
        if DOCS in kinds:  # parts beyond the dictionary's hand on the documents' rows
            return t
        data = t.column("data").to_pylist()
        buf, lengths = D.strings_of(data)
        number, lead = D.equal_strings(buf, lengths)
        text, ends = buf.tobytes(), np.cumsum(lengths)
        bucket = np.array([zlib.crc32(text[e - n : e]) % buckets for e, n in zip(ends[lead].tolist(), lengths[lead].tolist(), strict=True)], np.int64)[number]
        items, at, sums = [], 0, np.zeros((2, buckets), np.int64)
        for block, d in zip(t.column("block").to_pylist(), data, strict=True):
            df, times = D.widened(d[2]), D.widened(d[4])
            own = bucket[at : at + len(df)]
            at += len(df)
            np.add.at(sums[d[5][0]], own, np.add.reduceat(times, np.cumsum(df) - df))
            if not d[5][0]:
                items.append((0, block, FEATURES, [D.shrunk(own), *d[2:5]]))
        items.append((0, 0, BUCKETS, [D.shrunk(s) for s in sums]))
        out = D.rows(items)
        return pa.table([*out.columns, pa.nulls(len(items), t.schema.field("ids").type)], names=t.schema.names)

    return run


def _bucket_sums(counted: DataFrame, buckets: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            for d in b.column(0).to_pylist():
                total += np.stack([D.widened(x) for x in d])
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "s", "t"])

    out = np.zeros((2, buckets), np.int64)
    found = counted.filter(F.col("kind") == BUCKETS).select("data").mapInArrow(run, "bucket long, s long, t long")
    for r in found.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # a row for each bucket
        out[:, r["bucket"]] = r["s"], r["t"]
    return out


def bucket_gains(sums: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * ln of the target's share over the corpus's), each with one added to every bucket."""
    n, (s_all, t_all) = sums.shape[1], sums.sum(axis=1).tolist()
    return np.array([math.floor(scale * math.log((float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n)))) for s, t in sums.T.tolist()], np.int64)


def _summed(gains: np.ndarray):
    """The gains of a pack's features, added up by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = []
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bucket, df, gaps, times = map(D.widened, data)
                doc = _documents(df, gaps)
                total = np.bincount(doc, weights=np.repeat(gains[bucket], df) * times)  # integers below 2^53
                has = np.flatnonzero(np.bincount(doc))
                value = total[has].astype(np.int64)
                items.append((0, block, SUMS, [D.shrunk(has), D.shrunk(value << 1 ^ value >> 63)]))  # the sign in the last bit
            yield D.rows(items)

    return run


def _returned(t: pa.Table) -> pa.Table:
    """A block's documents with their sums: a row for each, with the number of the document's first piece."""
    kinds, data = t.column("kind").to_pylist(), t.column("data").to_pylist()
    own = kinds.index(DOCS)
    n_features, n_words, first = map(D.widened, data[own])
    total = np.zeros(len(n_features), np.int64)
    for k, d in zip(kinds, data, strict=True):
        if k == SUMS:
            doc, value = map(D.widened, d)
            total[doc] += value >> 1 ^ -(value & 1)
    ids = t.column("ids").combine_chunks()
    ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids)[own].values
    block = int(t.column("block")[own].as_py())
    key = (first[0] if len(n_features) == 1 else block) * D.BLOCK_DOCS * 2 + np.arange(len(n_features))
    return pa.table([pa.array(key), ids, pa.array(n_features), pa.array(n_words), pa.array(total)], names=["key", "id", "n_features", "n_words", "total"])


def feature_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = 10_000, scale: int = 1000) -> DataFrame:
    """id, n_features, n_words and weight of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    wanted = target.select(F.lit(None).cast(kind).alias("id"), target[target_text].alias("text"))
    n_parts = D.number_of_parts(texts)
    sent = _packed(texts, n_parts, False).union(_packed(wanted, n_parts, True))
    path = folder(spark)
    counted = kept_in(sent.groupBy("part").applyInArrow(_counted(buckets), sent.schema), path)
    gains = bucket_gains(_bucket_sums(counted, buckets), scale)
    sums = counted.filter(F.col("kind") == FEATURES).select("block", "data").mapInArrow(_summed(gains), D.ROWS).withColumn("ids", F.lit(None).cast(f"array<{kind}>"))
    back = counted.filter(F.col("kind") == DOCS).select(*sums.columns).union(sums)
    pieces = back.groupBy("block").applyInArrow(_returned, f"key long, id {kind}, n_features long, n_words long, total long")
    whole = pieces.groupBy("key").agg(F.first("id").alias("id"), F.sum("n_features").alias("n_features"), F.sum("n_words").alias("n_words"), F.sum("total").alias("total"))
    weight = F.when(F.col("n_features") > 0, (F.col("total") - F.pmod("total", "n_features")) / F.col("n_features")).otherwise(0).cast("long")
    out = kept_in(whole.select("id", "n_features", "n_words", weight.alias("weight")), folder(spark), listed=True)
    remove(spark, path)
    return out


def gumbel(doc_id: Column, seed: str, scale: int) -> Column:
    """Integer Gumbel noise from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 25, min_words: int = 20, seed: str = "7", buckets: int = 10_000, scale: int = 1000) -> DataFrame:
    """id, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    spark = docs.sparkSession
    found = feature_weights(docs, target, id_col, text_col, target_text, buckets, scale).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed, scale))
    able = found.filter(F.col("n_words") >= min_words)
    # places in a global order: sorted partitions, then an offset for each
    placed = able.withColumn("less", -F.col("score")).repartitionByRange("less", "id").sortWithinPartitions("less", "id")
    placed = kept_in(placed.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), folder(spark), listed=True)
    sizes = placed.groupBy("p").agg(F.count("*").alias("n"))  # a row for each partition
    offset = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    drawn = placed.count() * percent // 100
    rank = F.col("before") + F.col("i") + 1
    ranked = placed.join(F.broadcast(offset), "p").withColumn("rank", F.when(rank <= drawn, rank))
    out = ranked.select("id", "n_features", "weight", "score", "rank").union(found.filter(F.col("n_words") < min_words).select("id", "n_features", "weight", "score", F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id_col)
