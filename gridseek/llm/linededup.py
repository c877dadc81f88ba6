"""Fuzzy removal of repeated lines by MinHash.

A line, less the white space at its ends, is its set of SHINGLE-character shingles. One hash per shingle
fills BINS bins with their least value (an empty bin borrows from the next full one), ROWS bins make a band,
and lines with a band in common are candidates: 1 - (1 - 0.8^3)^12 > 0.9998 of the pairs at the threshold,
and all of them are compared (links.py). Candidates are verified by the exact Jaccard similarity of their
shingle sets (shingles as 64-bit hashes). Union-find over the verified links gives the components, and each component keeps the one line
of least (doc_id, position). One changed character inside a line touches SHINGLE shingles on either side, so
it takes a line of 79 characters to be linked to its copy with such a change.

A block of texts first settles its own equal lines. The first of each goes, packed, to a part by its digest,
whose reader keeps the least place of each line and puts out the others; so a line that a third of all
documents hold comes once per block, and no reader holds more than one place a line. Equal lines are one
node for the bands. Texts travel only to verify candidates and to be rewritten.

Cases: lines of white space alone always stay; a line of fewer than SHINGLE characters is one shingle, so
equal short lines are repeats like others; null and empty texts have no lines; repeated rows (same id and
text) count as one document; of ties in doc_id the text of the least hash comes first; a null doc_id comes
first; a very long text or line is a block of its own and is signed in stretches; an empty table gives an
empty result; extra columns, of any name, are ignored by `line_report` and kept by `drop_repeated_lines`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.llm.common import U64, mix, seeds, slices, small_batches, stored
from gridseek.llm.links import BROADCAST_BYTES, Measure, attached, classes, entries, number_of_parts, packed, small
from gridseek.llm.neardup import NO_ID, keyed

#: SHINGLE is a power of two.
SHINGLE, THRESHOLD = 8, 0.8
ROWS, BANDS = 3, 12
BINS = ROWS * BANDS
#: Characters of texts whose lines are signed together, and of lines whose shingles are hashed at a time, so that a core's cache holds the hashes.
BLOCK_CHARS, STRETCH = 1 << 20, 1 << 16
#: Distinct lines whose entries are packed together.
PACKED_LINES = 30_000
WHITE = " \t\r\x0b\x0c"
_C = U64(0x9FB21C651E98DF25)
_FULL, _LOW = U64(0xFFFFFFFFFFFFFFFF), U64((1 << 40) - 1)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, repeats included, and how many each line has."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    n = np.maximum(size - SHINGLE + 1, 1)
    start = np.cumsum(size) - size
    grams = np.concatenate([points + U64(1), np.zeros(SHINGLE, U64)])
    width, step = 1, _C
    while width < SHINGLE:  # from one character to 2, 4, 8
        grams = grams[:-width] * step + grams[width:]
        width, step = 2 * width, U64(int(step) ** 2 % (1 << 64))
    whole = np.ones(len(grams), bool)  # shingles within a line
    over = np.flatnonzero(size >= SHINGLE)
    for j in range(1, SHINGLE):
        whole[(start + size)[over] - j] = False
    whole[len(points) :] = False
    short = np.flatnonzero(size < SHINGLE)
    for i in short:
        whole[start[i] : start[i] + size[i]] = np.arange(size[i]) == 0
    h = grams[: len(whole)][whole]
    for i in short:  # the whole line
        k = 0
        for c in lines[i]:
            k = (k * int(_C) + ord(c) + 1) % (1 << 64)
        h[(np.cumsum(n) - n)[i]] = k
    return h, n


def _stretches(lines: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The lines (their numbers and texts) some STRETCH at a time; a longer one in several pieces with the same shingles."""
    owner, texts, chars = [], [], 0
    for i, line in enumerate(lines):
        for at in range(0, max(1, len(line) - SHINGLE + 1), STRETCH):
            owner.append(i)
            texts.append(line[at : at + STRETCH + SHINGLE - 1])
            chars += len(texts[-1])
            if chars >= STRETCH:
                yield owner, texts
                owner, texts, chars = [], [], 0
    if texts:
        yield owner, texts


def band_keys(lines: list[str]) -> np.ndarray:
    """A row of BANDS keys for each line."""
    least = np.full(len(lines) * BINS, _FULL, U64)
    for of, texts in _stretches(lines):
        h, n = shingle_hashes(texts)
        h = (h ^ (h >> U64(29))) * _C
        h ^= h >> U64(32)
        bin_ = ((h >> U64(40)) * U64(BINS) >> U64(24)).astype(np.int64)
        np.minimum.at(least, np.repeat(np.array(of) * BINS, n) + bin_, h & _LOW)
    least = least.reshape(len(lines), BINS)
    empty = least == _FULL
    own, full = least.copy(), ~empty
    for step in range(1, BINS):  # an empty bin borrows from the next full one, marked by the distance
        if not empty.any():
            break
        lends = empty & np.roll(full, -step, axis=1)
        least[lends] = (np.roll(own, -step, axis=1) + U64(step * int(_C) % (1 << 64)))[lends]
        empty &= ~lends
    keys = np.empty((len(lines), BANDS), U64)
    for b, seed in enumerate(seeds(BANDS, 991)):
        k = np.full(len(lines), seed)
        for r in range(ROWS):
            k = mix(k * U64(31) + least[:, b * ROWS + r])
        keys[:, b] = k
    return keys


def _elements(lines: list[str]) -> list[np.ndarray]:
    h, n = shingle_hashes(lines)
    return np.split(h, np.cumsum(n)[:-1])


MEASURE = Measure(_elements, THRESHOLD)


def worded_lines(text: str) -> list[tuple[int, str]]:
    """(position, stripped line) of the lines that may be removed."""
    return [(i, x) for i, line in enumerate(text.split("\n")) if (x := line.strip(WHITE))]


def _table(names: str, **columns) -> pa.RecordBatch:
    """A batch of all `names` (name type, ...), null where no column is given."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    rows = len(next(iter(columns.values())))
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(rows, kinds[k]) for n, k in fields], names=[n for n, _ in fields])


#: A line's first place in its block (n and m are its digest), a place that is a repeat there (n is null), or packed strings.
SIGNED = "id long, row_hash long, pos int, n long, m long, part int, entries binary, firsts binary"


def sign_block(places: list[tuple[int, int, int, int]], lines: list[str]) -> Iterator[pa.RecordBatch | tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """SIGNED rows of a block, places (id, row_hash, pos, number of the line) and its distinct lines, and last what is to be packed of it."""
    doc, row, pos, which = np.array(places, np.int64).T
    order = np.lexsort((pos, row, doc, which))
    doc, row, pos, which = doc[order], row[order], pos[order], which[order]
    lead = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    digest = np.frombuffer(b"".join(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest() for x in lines), np.int64).reshape(-1, 2)
    yield _table(SIGNED, id=doc[lead], row_hash=row[lead], pos=pos[lead].astype(np.int32), n=digest[:, 0], m=digest[:, 1])
    first = lead[which]
    gone = np.flatnonzero((doc != doc[first]) | (row != row[first]) | (pos != pos[first]))
    if len(gone):
        yield _table(SIGNED, id=doc[gone], row_hash=row[gone], pos=pos[gone].astype(np.int32))
    yield digest, band_keys(lines), np.column_stack([digest, doc[lead], row[lead], pos[lead]])


def signed_lines(docs: DataFrame) -> DataFrame:
    """SIGNED of docs (id, row_hash, text)."""
    parts = number_of_parts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[tuple] = []
        lines: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def packs() -> Iterator[pa.RecordBatch]:
            digest, keys, firsts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            part, strings = zip(*entries(digest[:, 0], keys, parts), strict=True)
            yield _table(SIGNED, part=part, entries=strings)
            part, strings = zip(*packed(digest[:, 0], firsts, parts), strict=True)
            yield _table(SIGNED, part=part, firsts=strings)

        def close() -> Iterator[pa.RecordBatch]:
            *rows, own = sign_block(places, list(lines))
            held.append(own)
            places.clear()
            lines.clear()
            yield from rows
            if sum(len(x[0]) for x in held) > PACKED_LINES:
                yield from packs()

        for batch in slices(batches):
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for pos, line in worded_lines(text):
                    places.append((doc, row, pos, lines.setdefault(line, len(lines))))
                    size += len(line)
                if size > BLOCK_CHARS:
                    yield from close()
                    size = 0
        if lines:
            yield from close()
        if held:
            yield from packs()

    return docs.select("id", "row_hash", "text").mapInArrow(run, SIGNED)


def equal_lines(strings: DataFrame) -> DataFrame:
    """(id, row_hash, pos): all places of a line but its least, from packed firsts (part, firsts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, held, size = np.zeros((0, 5), np.int64), [], 0

        def settle() -> pa.RecordBatch:
            nonlocal least
            rows = np.concatenate([least, np.frombuffer(b"".join(held), np.int64).reshape(-1, 5)])
            held.clear()
            rows = rows[np.lexsort(rows.T[::-1])]
            lead = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
            first = np.repeat(lead, np.diff(np.append(lead, len(rows))))
            gone = rows[(rows != rows[first]).any(axis=1)]
            least = rows[lead]
            return pa.RecordBatch.from_arrays([pa.array(gone[:, 2]), pa.array(gone[:, 3]), pa.array(gone[:, 4].astype(np.int32))], names=["id", "row_hash", "pos"])

        for batch in batches:
            for rows in batch.column(1).to_pylist():
                held.append(rows)
                size += len(rows) // 40
                if size > max(1 << 18, len(least)):
                    yield settle()
                    size = 0
        if held:
            yield settle()

    return strings.repartition("part").mapInArrow(run, "id long, row_hash long, pos int")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(id, row_hash, gone): the positions of the lines to remove. docs: id, row_hash, text. Stored."""
    small_batches(docs.sparkSession)
    signed = stored(signed_lines(docs))
    places = signed.filter("n IS NOT NULL").select("n", "m", "id", "row_hash", "pos")

    def contents(wanted: DataFrame) -> DataFrame:
        one = places.join(small(wanted), "n").groupBy("n").agg(*(F.first(c).alias(c) for c in ("id", "row_hash", "pos")))
        at = stored(one.groupBy("id", "row_hash").agg(F.collect_list(F.struct("n", "pos")).alias("of")))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                n, lines = [], []
                for text, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    every = text.split("\n")
                    n += [x["n"] for x in of]
                    lines += [every[x["pos"]].strip(WHITE) for x in of]
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(lines, pa.string())], names=["n", "content"])

        found = docs.join(_small(at, "of"), ["id", "row_hash"]).select("text", "of")
        return found.mapInArrow(cut, "n long, content string")

    labels = classes(signed.filter("entries IS NOT NULL").select("part", "entries"), contents, MEASURE)
    of_node = places.join(small(labels), "n").groupBy("n", "label").agg(F.min(F.struct("id", "row_hash", "pos")).alias("own"), F.min("m").alias("m"), F.max("m").alias("last"))
    # two lines whose digests begin alike would be one node; such a node's links aren't used
    own = stored(of_node.filter("m = last").select("label", "own"))
    first = stored(own.groupBy("label").agg(F.min("own").alias("first"), F.count("*").alias("size")))
    alike = attached(own, first, "label").filter("own <> first").select("own.*")
    equal = equal_lines(signed.filter("firsts IS NOT NULL").select("part", "firsts"))
    inside = signed.filter("n IS NULL AND part IS NULL").select("id", "row_hash", "pos")
    return stored(inside.union(equal).union(alike).groupBy("id", "row_hash").agg(F.collect_set("pos").alias("gone")))


def _small(df: DataFrame, array: str) -> DataFrame:
    """df (id, row_hash, array of at most two numbers), to be broadcast if it is small. df should be stored."""
    rows, items = df.agg(F.count("*"), F.coalesce(F.sum(F.size(array)), F.lit(0))).first()
    return F.broadcast(df) if 48 * rows + 24 * items <= BROADCAST_BYTES else df


def _without(docs: DataFrame, gone: DataFrame, text: str) -> DataFrame:
    """docs (id, row_hash and others) with the text less its lines, and n_removed. Texts that lose nothing are passed by."""
    joined = docs.join(_small(gone, "gone"), ["id", "row_hash"], "left").select(*docs.columns, "gone")
    out = joined.filter("gone IS NULL").select(*docs.columns, F.lit(0).cast("long").alias("n_removed"))
    at, names = docs.columns.index(text), out.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept, lost = [], []
            for x, numbers in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                drop = set(numbers)
                kept.append("\n".join(line for i, line in enumerate(x.split("\n")) if i not in drop))
                lost.append(len(drop))
            columns = [pa.array(kept, c.type) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lost, pa.int64())], names=names)

    return out.union(joined.filter("gone IS NOT NULL").mapInArrow(cut, out.schema))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text of every document."""
    own = keyed(docs, id_col, text_col)
    counted = own.withColumn("n_lines", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long"))
    out = _without(counted, repeated_lines(own), "text")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_lines", "n_removed", F.col("text").alias("kept_text"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their repeated lines, with all their columns. A document that loses all its words goes."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = [f"c{names.index(c)}" for c in (id_col, text_col)]
    full = plain.withColumns({"id": F.coalesce(F.col(at[0]).cast("long"), F.lit(NO_ID)), "row_hash": F.xxhash64(at[1])})
    gone = repeated_lines(full.select("id", "row_hash", F.coalesce(at[1], F.lit("")).alias("text")))
    out = _without(full, gone, at[1]).filter((F.col("n_removed") == 0) | F.col(at[1]).rlike("[^\\x20\\x09-\\x0D]"))
    return out.select(*plain.columns).toDF(*names)
