"""Near-duplicate documents by Order MinHash.

A document is its 5-word shingles, each labelled with how often it has occurred before, so that all are
different. A sketch hashes the labelled shingles anew, takes the DEPTH smallest and keeps them in the
order of the text; two documents share a sketch if they have the same smallest shingles in the same order,
so it answers to edits and not to the mere set. Documents that share any of SKETCHES sketches are
candidates; equal word sequences are merged first and count once.

All candidates are compared (links.py): the labelled shingles that two share bound their alignment from above,
and pairs that pass are verified by banded alignment. A labelled shingle occurs once on each side, so the
longest common subsequence is a longest increasing run of positions, taken within a band about the diagonal
that no pair above the threshold leaves. Linked are those whose aligned shingles make up THRESHOLD of all.
A pair at exactly 0.8 shares a sketch with probability 1 - (1 - 0.8^4)^20 > 0.9999. Shingles are held as
64-bit hashes.

Cases: a text of one to four words is one shingle; a text without words (null, empty) is a class of its
own; a null doc_id is a row like others; rows of one doc_id with different texts are different documents;
repeated rows and equal texts are one class; of ties in doc_id the text of the least hash stays; a very long
text is a block of its own and takes some 100 bytes a word; an empty table gives an empty result; extra
columns, of any name, are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.llm.common import Block, Hasher, U64, blocks, mix, seeds, small_batches, stored, utf8
from gridseek.llm.links import Measure, attached, classes, entries, number_of_parts, small
from gridseek.llm.substring import window_hashes

WORDS, THRESHOLD = 5, 0.8
SKETCHES, DEPTH = 20, 4
#: No document's id; stands for null.
NO_ID = -(1 << 63)
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def labelled_shingles(block: Block, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (shingle, number of earlier ones) of all texts, and the bounds of each text's."""
    word, doc = Hasher(block.buf).spans(block.starts, block.ends), block.word_doc()
    left = np.repeat(block.word_lo[1:], block.n_words) - np.arange(len(doc))
    whole = window_hashes(word, width)
    at = np.flatnonzero((left[: len(whole)] >= width))
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < width))
    parts, owners = [whole[at]], [doc[at]]
    if len(short):
        parts.append(np.array([window_hashes(word[block.word_lo[i] : block.word_lo[i + 1]], int(block.n_words[i]))[0] for i in short], U64))
        owners.append(short)
    shingle, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    shingle, owner = shingle[order], owner[order]
    order = np.lexsort((shingle, owner))  # stable: equal shingles keep the order of the text
    s, o = shingle[order], owner[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])[: len(s)]
    run = np.flatnonzero(new)
    nth = np.empty(len(s), np.int64)
    nth[order] = np.arange(len(s)) - np.repeat(run, np.diff(np.append(run, len(s))))
    return mix(shingle + nth.astype(U64) * U64(0xC2B2AE3D27D4EB4F)), np.searchsorted(owner, np.arange(block.n + 1))


def order_sketches(labelled: np.ndarray, edges: np.ndarray, sketches: int = SKETCHES, depth: int = DEPTH) -> np.ndarray:
    """A row of sketches for each text that has shingles (edges: their bounds)."""
    size = np.diff(edges)
    owner = np.repeat(np.arange(len(size)), size)
    # of n hashes few lie below WANTED / n; those hold the smallest nearly always
    wanted = 8.0 * depth
    limit = np.where(size > wanted, np.minimum(wanted / np.maximum(size, 1), 1.0) * 2.0**64, 2.0**64 - 2048)
    limit = np.minimum(limit, 2.0**64 - 2048).astype(U64)
    out = np.empty((len(size), sketches), U64)
    per_shingle = np.repeat(limit, size)
    for j, seed in enumerate(seeds(sketches, 77)):
        v = mix(labelled ^ seed)
        low = v <= per_shingle
        got = np.bincount(owner[low], minlength=len(size))
        short = (got < np.minimum(depth, size))
        if short.any():
            low |= np.repeat(short, size)
        at = np.flatnonzero(low)
        own = owner[at]
        at = at[np.lexsort((v[at], own))]
        first = np.searchsorted(own, np.arange(len(size)))
        count = np.diff(np.append(first, len(at)))
        pick = first[:, None] + np.minimum(np.arange(depth), count[:, None] - 1)  # a text of few shingles repeats its last
        place = np.sort(at[pick], axis=1)
        h = np.full(len(size), seed)
        for d in range(depth):
            h = mix(h * U64(31) + labelled[place[:, d]])
        out[:, j] = h
    return out


#: A document (n and m are the digest of its words, null where it has none) or packed entries.
SIGNED = "id long, row_hash long, n long, m long, part int, entries binary"


def signatures(docs: DataFrame) -> DataFrame:
    """SIGNED of docs (id, row_hash, text)."""
    parts = number_of_parts(docs)
    names = [x.split()[0] for x in SIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, size = [], [], 0
        for part, block in blocks(batches):
            digests = [hashlib.md5(b" ".join(block.buf[block.offsets[i] : block.offsets[i + 1]].tobytes().split())).digest() for i in range(block.n)]
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            labelled, edges = labelled_shingles(block)
            without = np.diff(edges) == 0
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest[:, 0], mask=without), pa.array(digest[:, 1], mask=without), pa.nulls(block.n, pa.int32()), pa.nulls(block.n, pa.binary())], names=names)
            some = np.flatnonzero(~without)
            if len(some):
                nodes.append(digest[some, 0])
                keys.append(order_sketches(labelled, np.append(edges[some], edges[-1])))
                size += len(some)
            if size > 4096:
                yield strings(nodes, keys)
                nodes, keys, size = [], [], 0
        if size:
            yield strings(nodes, keys)

    def strings(nodes: list, keys: list) -> pa.RecordBatch:
        part, packs = zip(*entries(np.concatenate(nodes), np.concatenate(keys), parts), strict=True)
        none = pa.nulls(len(part), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(part, pa.int32()), pa.array(packs, pa.binary())], names=names)

    return docs.select("id", "row_hash", "text").mapInArrow(run, SIGNED)


def _elements(texts: list[str]) -> list[np.ndarray]:
    labelled, edges = labelled_shingles(Block(*utf8(pa.array(texts, pa.large_string()))))
    return np.split(labelled, edges[1:-1])


def aligned(left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned shingles over all shingles of both, each a text's labelled shingles in order."""
    a, b = len(left), len(right)
    if min(a, b) < threshold * max(a, b):
        return 0.0
    # of a pair above the threshold at most this many shingles are unmatched, so no match lies further off the diagonal
    band = int((1 - threshold) / (1 + threshold) * (a + b)) + 1
    at = dict(zip(right.tolist(), range(b), strict=True))
    places = [j for i, key in enumerate(left.tolist()) if (j := at.get(key)) is not None and abs(j - i) <= band]
    tails: list[int] = []
    for j in places:  # left's order; tails[k]: the least end of an increasing run of k + 1
        if not tails or j > tails[-1]:
            tails.append(j)
        else:
            tails[bisect_left(tails, j)] = j
    return len(tails) / (a + b - len(tails)) if a + b else 0.0


MEASURE = Measure(_elements, THRESHOLD, lambda a, b: aligned(a, b) >= THRESHOLD)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(docs[text_col]).alias("row_hash"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: id, row_hash, text. All documents with words (id, row_hash, label), stored, and those without (id, row_hash)."""
    small_batches(docs.sparkSession)
    signed = stored(signatures(docs))
    worded = signed.filter("n IS NOT NULL").select("id", "row_hash", "n", "m")

    def contents(wanted: DataFrame) -> DataFrame:
        one = worded.join(small(wanted), "n").groupBy("n").agg(F.min(F.struct("id", "row_hash")).alias("p"))
        at = stored(one.select("n", "p.id", "p.row_hash"))
        return docs.join(small(at), ["id", "row_hash"]).select("n", F.col("text").alias("content"))

    labels = classes(signed.filter("entries IS NOT NULL").select("part", "entries"), contents, MEASURE)
    # a node of its own is its texts of one digest, all 128 bits
    label = F.struct(F.coalesce("label", "n"), F.when(F.col("label").isNull(), F.col("m")).otherwise(F.lit(0)))
    named = worded.join(small(labels), "n", "left").select("id", "row_hash", label.alias("label"))
    return stored(named), signed.filter("n IS NULL AND part IS NULL").select("id", "row_hash")


def _null(name: str):
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_size of every document."""
    named, without = _classified(keyed(docs, id_col, text_col))
    per_class = stored(named.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("size")))
    with_words = attached(named, per_class, "label").select(_null("id").alias(id_col), _null("class_id"), F.col("size").alias("class_size"))
    return with_words.union(without.select(_null("id").alias(id_col), _null("id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of least id of each class, with all its columns; documents without words stay."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = [f"c{names.index(c)}" for c in (id_col, text_col)]
    full = plain.withColumns({"id": F.coalesce(F.col(at[0]).cast("long"), F.lit(NO_ID)), "row_hash": F.xxhash64(at[1])})
    named, _ = _classified(full.select("id", "row_hash", F.coalesce(at[1], F.lit("")).alias("text")))
    first = stored(named.groupBy("label").agg(F.min(F.struct("id", "row_hash")).alias("first"), F.count("*").alias("size")))
    several = attached(named, first.filter("size > 1"), "label")
    other = F.struct("id", "row_hash") != F.col("first")
    # a document that is neither dropped nor one of several equal rows is passed by
    known = stored(several.groupBy("id", "row_hash").agg(F.max(other).alias("drop"), F.count("*").alias("rows")).filter("drop OR rows > 1"))
    joined = full.join(small(known, 48), ["id", "row_hash"], "left").select(*full.columns, "drop")
    once = joined.filter("NOT drop").dropDuplicates(["id", "row_hash"])
    return joined.filter("drop IS NULL").union(once).select(*plain.columns).toDF(*names)
