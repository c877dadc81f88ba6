"""Log-likelihoods of documents by a gated recurrent language model.

Words are counted over all training documents by a global dictionary (`gridseek.llm.dictionary`): each block of
texts sends its distinct words once and gets their counts back. The most frequent words are symbols of the model;
other words share a symbol with those of about the same count (a band, by powers of two; unseen words and those seen
once are the first), within which a word has its share of the band's count. So every word has a probability, and
the model's and the base's are over the same outcomes.

The model (`gridseek.llm.recurrent`) is trained once over all training documents, in rounds: in each, every task
goes on from the common parameters with its documents of that round, and Spark averages the tasks' parameters by
their tokens, level by level. Then one pass scores all documents, each from its first token to its end with the
state carried along.

Cases: a null text is empty and its only token is its end; a null doc_id counts as an empty string where its hash
decides on training; repeated rows are rows of their own; a text of any length is one stream, which takes some 20
bytes a word where it is scored; without training documents all counts are 0 and the model is what it starts from; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.llm import dictionary as D
from gridseek.llm.common import Block, Hasher, U64, folder, kept_in, mix, remove, small_batches, utf8
from gridseek.llm.recurrent import Model, scores

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
WORDS, DOCS, TOP, BANDS, TRAINED = range(5)
PIECE_BYTES = 2 << 20
#: Bands of counts; a longer word than LONGEST bytes has its band's symbol, however frequent.
N_BANDS, LONGEST = 32, 64
#: Tokens that a task trains on or scores side by side, a longer text apart.
BATCH_TOKENS = 1 << 20
FANIN = 256
LN10 = math.log(10)


@dataclass(frozen=True)
class Params:
    words: int = 991  # with the bands and the end, 1024 symbols
    hidden: int = 16
    lanes: int = 1024
    window: int = 16
    rounds: int = 4
    rate: float = 0.3


def _band(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1, N_BANDS - 1)


def _words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one stream of local word numbers, the words of each text, and the distinct words: hashes, bytes and lengths."""
    n_words, keys, texts, sizes, streams, seen = np.zeros(len(offsets) - 1, np.int64), [], [], [], [], 0
    for at, to, lo, hi in D.cuts(raw, offsets, _WORD, PIECE_BYTES):
        b = Block(_LOWER[raw[lo:hi]], np.clip(offsets[at : to + 1], lo, hi) - lo)
        key, first, word = np.unique(Hasher(b.buf).spans(b.starts, b.ends), return_index=True, return_inverse=True)
        n_words[at:to] += b.n_words
        size = b.ends[first] - b.starts[first]
        keys.append(key)
        sizes.append(size)
        texts.append(D.gather(b.buf, b.starts[first], size))
        streams.append((word + seen).astype(np.int32))
        seen += len(key)
    if not keys:
        return np.zeros(0, np.int32), n_words, np.zeros(0, U64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    key, first, local = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    size = np.concatenate(sizes)
    text = D.gather(np.concatenate(texts), (np.cumsum(size) - size)[first], size[first])
    local = local.astype(np.int32)
    return np.concatenate([local[s] for s in streams]), n_words, key, text, size[first]


def _packed(texts: DataFrame, n_parts: int) -> DataFrame:
    """Blocks of texts (id, text, held): their distinct words with counts in training texts, by part, and their streams."""
    kind = texts.schema["id"].dataType.simpleString()

    def block(number: int, t: pa.Table) -> pa.RecordBatch:
        raw, offsets = utf8(t.column(1))
        held = t.column(2).to_numpy().astype(bool)
        stream, n_words, key, text, size = _words_of(raw, offsets)
        counts = np.bincount(stream[np.repeat(~held, n_words)], minlength=len(key))
        order, parts, edges = D.packs(D.spread(mix(key), n_parts), n_parts)
        starts, size, counts = (np.cumsum(size) - size)[order], size[order], counts[order]
        text, ends = D.gather(text, starts, size), np.append(0, np.cumsum(size))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        items = [(p, number, WORDS, [D.squeezed(text[ends[lo] : ends[hi]].tobytes()), D.shrunk(size[lo:hi]), D.shrunk(counts[lo:hi]), D.shrunk(np.array([lo]))]) for p, lo, hi in zip(parts, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        beyond = n_parts + number % n_parts
        items.append((beyond, number, TRAINED, [D.shrunk(np.array([(~held).sum()]))]))
        items.append((beyond, number, DOCS, [D.shrunk(held.astype(np.uint8)), D.shrunk(n_words), D.shrunk(place[stream])]))
        out = D.rows(items)
        ids = t.column(0).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        own = pa.concat_arrays([pa.array([None] * (len(items) - 1), pa.list_(ids.type)), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)])
        return pa.RecordBatch.from_arrays([*out.columns, own], names=[*out.schema.names, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, waiting = TaskContext.get().partitionId() << 20, 0, []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                waiting.append(b.slice(at, 256))
                size += int(utf8(waiting[-1].column(1))[1][-1])
                if size >= D.BLOCK_BYTES or sum(x.num_rows for x in waiting) >= D.BLOCK_DOCS:
                    yield block(number, pa.Table.from_batches(waiting))
                    number, size, waiting = number + 1, 0, []
        if sum(x.num_rows for x in waiting):
            yield block(number, pa.Table.from_batches(waiting))

    return texts.mapInArrow(run, f"{D.ROWS}, ids array<{kind}>")


def _counted(top: int):
    """A part of the dictionary: the count of each word, its place among the part's most frequent, and sums by band."""

    def run(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_pylist()
        if DOCS in kinds:  # parts beyond the dictionary's hand on the documents' rows
            return t
        part, data = int(t.column("part")[0].as_py()), t.column("data").to_pylist()
        buf, lengths = D.strings_of(data)
        number, lead = D.equal_strings(buf, lengths)
        counts = np.zeros(len(lead), np.int64)
        np.add.at(counts, number, np.concatenate([D.widened(d[2]) for d in data]))
        ends, size = np.cumsum(lengths)[lead], lengths[lead]
        able = np.flatnonzero((counts > 0) & (size <= LONGEST))
        if len(able) > top:  # ties at the last place are settled by the strings
            able = able[counts[able] >= np.partition(counts[able], len(able) - top)[len(able) - top]]
        names = [buf[e - n : e].tobytes() for e, n in zip(ends[able].tolist(), size[able].tolist(), strict=True)]
        best = sorted(range(len(able)), key=lambda i: (-int(counts[able[i]]), names[i]))[:top]
        code = np.zeros(len(lead), np.int64)
        code[able[best]] = np.arange(1, len(best) + 1)
        items, at = [], 0
        for block, d in zip(t.column("block").to_pylist(), data, strict=True):
            own = number[at : (at := at + len(D.widened(d[1])))]
            items.append((part, block, WORDS, [d[3], D.shrunk(counts[own]), D.shrunk(code[own])]))
        seen = counts[counts > 0]
        items.append((part, 0, TOP, [D.squeezed(b"".join(names[i] for i in best)), D.shrunk(size[able[best]]), D.shrunk(counts[able[best]])]))
        sums = np.zeros(N_BANDS, np.int64)
        np.add.at(sums, _band(seen), seen)
        items.append((part, 0, BANDS, [D.shrunk(np.bincount(_band(seen), minlength=N_BANDS)), D.shrunk(sums)]))
        out = D.rows(items)
        return pa.table([*out.columns, pa.nulls(len(items), t.schema.field("ids").type)], names=t.schema.names)

    return run


@dataclass
class Vocabulary:
    """What the whole corpus says: training tokens, distinct ones, documents; symbols of words and bands, most frequent first."""

    tokens: int
    distinct: int
    docs: int
    counts: np.ndarray  # by symbol
    end: int
    band_symbol: np.ndarray
    band_total: np.ndarray  # of count + 0.5 over the words of a band that have no symbol, and 0.5 for unseen ones
    words: dict[int, tuple[np.ndarray, np.ndarray]]  # part -> code, symbol


def _vocabulary(counted: DataFrame, top: int) -> Vocabulary:
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, size, counts = D.unsqueezed(d[0]).tobytes(), D.widened(d[1]), D.widened(d[2])
                ends = np.cumsum(size).tolist()
                words = [text[e - n : e] for e, n in zip(ends, size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts), pa.array(np.full(len(words), part)), pa.array(np.arange(1, len(words) + 1))], names=["word", "n", "part", "code"])

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, N_BANDS), np.int64)
        for b in batches:
            for kind, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if kind == BANDS:
                    total[:2] += np.stack([D.widened(d[0]), D.widened(d[1])])
                else:
                    total[2, 0] += D.widened(d[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_BANDS)), *map(pa.array, total)], names=["band", "words", "n", "docs"])

    best = counted.filter(F.col("kind") == TOP).select("part", "data").mapInArrow(named, "word binary, n long, part long, code long").orderBy(F.desc("n"), "word").limit(top).collect()
    per_band = counted.filter(F.col("kind").isin(BANDS, TRAINED)).select("kind", "data").mapInArrow(banded, "band long, words long, n long, docs long")
    words, n, docs = np.zeros(N_BANDS, np.int64), np.zeros(N_BANDS, np.int64), 0
    for r in per_band.groupBy("band").agg(F.sum("words").alias("words"), F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect():  # a row for each band
        words[r["band"]], n[r["band"]], docs = r["words"], r["n"], docs + r["docs"]
    tokens, distinct = int(n.sum()) + docs, int(words.sum()) + (docs > 0)
    for r in best:
        band = _band(np.array([r["n"]]))[0]
        words[band] -= 1
        n[band] -= r["n"]
    bands = np.flatnonzero((words > 0) | (np.arange(N_BANDS) == 0))
    own = [(r["n"], i) for i, r in enumerate(best)] + [(int(n[b]), len(best) + j) for j, b in enumerate(bands)] + [(docs, len(best) + len(bands))]
    own.sort(key=lambda x: (-x[0], x[1]))
    symbol = {i: s for s, (_, i) in enumerate(own)}
    band_symbol = np.zeros(N_BANDS, np.int64)
    band_symbol[bands] = [symbol[len(best) + j] for j in range(len(bands))]
    by_part: dict[int, list[tuple[int, int]]] = {}
    for i, r in enumerate(best):
        by_part.setdefault(r["part"], []).append((r["code"], symbol[i]))
    total = n + 0.5 * words
    total[0] += 0.5
    return Vocabulary(tokens, distinct, docs, np.array([c for c, _ in own]), symbol[len(best) + len(bands)], band_symbol, total, {p: tuple(map(np.array, zip(*x, strict=True))) for p, x in by_part.items()})


def _encoded(v: Vocabulary):
    """A block's documents with their figures, and their symbols as one stream."""

    def run(t: pa.Table) -> pa.Table:
        kinds, data = t.column("kind").to_pylist(), t.column("data").to_pylist()
        own = kinds.index(DOCS)
        held, n_words, stream = map(D.widened, data[own])
        size = sum(len(D.widened(d[1])) for k, d in zip(kinds, data, strict=True) if k == WORDS)
        counts, symbol, named = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
        for part, k, d in zip(t.column("part").to_pylist(), kinds, data, strict=True):
            if k == WORDS:
                first, c, code = map(D.widened, d)
                at = slice(int(first[0]), int(first[0]) + len(c))
                counts[at], symbol[at] = c, v.band_symbol[_band(c)]
                if part in v.words:
                    to = np.zeros(int(code.max()) + 2, np.int64) - 1
                    for x, s in zip(*v.words[part], strict=True):
                        if x < len(to):
                            to[x] = s
                    has = (code > 0) & (to[code] >= 0)
                    symbol[at][has], named[at][has] = to[code[has]], True
        base = np.log10((counts + 0.5) / (v.tokens + 0.5 * (v.distinct + 1)))
        within = np.where(named, 0.0, np.log10((counts + 0.5) / np.where(named, 1.0, v.band_total[_band(counts)])))
        ends = np.cumsum(n_words)

        def summed(per_word: np.ndarray) -> np.ndarray:
            return np.array([per_word[stream[e - n : e]].sum() for e, n in zip(ends.tolist(), n_words.tolist(), strict=True)])

        last = math.log10((v.docs + 0.5) / (v.tokens + 0.5 * (v.distinct + 1)))
        symbols = np.insert(symbol[stream], ends, v.end)
        ids = t.column("ids").combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids)[own]
        known = summed((counts > 0).astype(np.int64)) + (v.docs > 0) if len(ends) else ends
        row = [pa.array([t.column("block")[own].as_py()]), pa.array([ids], ids.type), pa.array([[D.shrunk(held), D.shrunk(n_words + 1), D.shrunk(known), D.shrunk(symbols)]], pa.list_(pa.binary()))]
        return pa.table([*row, pa.array([summed(base) + last]), pa.array([summed(within)])], names=["block", "ids", "data", "base", "within"])

    return run


def _round(encoded: DataFrame, model: bytes, v: Vocabulary, p: Params, number: int) -> bytes:
    """The parameters after a round: each task trains on its documents of that round, Spark averages what they come to."""
    symbols = len(v.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, tokens, size = Model.of(symbols, p.hidden, model), [], 0, 0
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held, n, _, stream = (D.widened(x.as_py()) for x in data.values)
                mine = (held == 0) & (mix(np.arange(len(n), dtype=U64) + U64(block << 16)) >> U64(32)) % U64(p.rounds) == U64(number)
                waiting.append(stream[np.repeat(mine, n)].astype(np.int16))
                size += len(waiting[-1])
                if size >= BATCH_TOKENS:
                    own.train(np.concatenate(waiting), v.end, p.lanes, p.window, p.rate)
                    waiting, tokens, size = [], tokens + size, 0
        if size:
            own.train(np.concatenate(waiting), v.end, p.lanes, p.window, p.rate)
        tokens += size
        if tokens:
            state = np.frombuffer(own.state(), np.float32).astype(np.float64) * tokens
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([float(tokens)]), pa.array([state.tobytes()])], names=["k", "weight", "state"])

    def added(t: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_py(), np.float64) for x in t.column("state")), np.zeros(1))
        return pa.table([t.column("k")[:1], pa.array([sum(t.column("weight").to_pylist())]), pa.array([total.tobytes()])], names=["k", "weight", "state"])

    found, left = encoded.select("block", "data").mapInArrow(run, "k long, weight double, state binary"), encoded.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FANIN)
        found = found.withColumn("k", F.floor(F.col("k") / FANIN)).groupBy("k").applyInArrow(added, "k long, weight double, state binary")
    got = found.collect()  # one row
    return (np.frombuffer(got[0]["state"], np.float64) / got[0]["weight"]).astype(np.float32).tobytes() if got else model


def _scored(encoded: DataFrame, model: bytes, v: Vocabulary, p: Params, kind: str) -> DataFrame:
    symbols = len(v.counts)

    def settled(own: Model, waiting: list) -> pa.RecordBatch:
        ids, held, n, known, base, within, stream = (list(x) for x in zip(*waiting, strict=True))
        n = np.concatenate(n)
        logs = scores(own, np.concatenate(stream), n, v.end, p.lanes) / LN10 + np.concatenate(within)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(held) > 0), pa.array(n), pa.array(np.concatenate(known)), pa.array(np.full(len(n), v.tokens)), pa.array(np.concatenate(base)), pa.array(logs)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, size = Model.of(symbols, p.hidden, model), [], 0
        for b in batches:
            for i in range(b.num_rows):
                held, n, known, stream = (D.widened(x.as_py()) for x in b.column("data")[i].values)
                waiting.append((b.column("ids")[i].values, held, n, known, np.array(b.column("base")[i].as_py()), np.array(b.column("within")[i].as_py()), stream.astype(np.int16)))
                size += len(stream)
                if size >= 4 * BATCH_TOKENS:
                    yield settled(own, waiting)
                    waiting, size = [], 0
        if waiting:
            yield settled(own, waiting)

    return encoded.select("ids", "data", "base", "within").mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """A row for each document: its id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10)."""
    spark, p = docs.sparkSession, params
    small_batches(spark)
    held = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")) % 5 == 1
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), held.alias("held"))
    kind = texts.schema["id"].dataType.simpleString()
    n_parts = D.number_of_parts(texts)
    sent = _packed(texts, n_parts)
    path, after = folder(spark), folder(spark)
    counted = kept_in(sent.groupBy("part").applyInArrow(_counted(p.words), sent.schema), path)
    v = _vocabulary(counted, p.words)
    blocks = counted.filter(F.col("kind").isin(WORDS, DOCS)).groupBy("block").applyInArrow(_encoded(v), f"block long, ids array<{kind}>, data array<binary>, base array<double>, within array<double>")
    encoded = kept_in(blocks, after)
    remove(spark, path)
    model = Model(len(v.counts), p.hidden).start(v.counts).state()
    for r in range(p.rounds):
        model = _round(encoded, model, v, p, r)
    out = kept_in(_scored(encoded, model, v, p, kind), folder(spark), listed=True)
    remove(spark, after)
    return out.withColumnRenamed("id", id_col)
