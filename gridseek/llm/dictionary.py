"""Dictionaries of strings over blocks of text.

A block of texts sends each of its distinct strings once, in packs: one row for each part of the dictionary, chosen
by a hash, with the bytes of all its strings. A part joins the packs of all blocks and finds equal strings: by a
64-bit hash, then by their bytes. Parts follow the bytes of the corpus (`PART_BYTES` of text for each), so a task
holds one part, and a string that every document has is one entry a block.

Rows that travel are (part, block, kind, data): data holds numpy arrays in their least width, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.llm.common import Hasher, U64

#: Bytes of text for each part of a dictionary, and of a block.
PART_BYTES, BLOCK_BYTES = 16 << 20, 8 << 20
#: Documents of a block.
BLOCK_DOCS = 1 << 15
ROWS = "part long, block long, kind int, data array<binary>"


def number_of_parts(texts: DataFrame, text: str = "text") -> int:
    """As many as the bytes of the texts ask for, and one for each shuffle partition at least."""
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def shrunk(a: np.ndarray) -> bytes:
    """An array of numbers from 0 on in the least width, byte by byte, compressed."""
    a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return bytes([a.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def widened(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(flat.reshape(data[0], -1).T).view(f"u{data[0]}").ravel().astype(np.int64)


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of some spans, one after the other, some spans at a time."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, buf.dtype)
    for lo in range(0, len(starts), 1 << 16):
        some = slice(lo, lo + (1 << 16))
        first, last = int(ends[lo] - lengths[lo]), int(ends[some][-1])
        at = np.arange(first, last)
        at += np.repeat(starts[some] - (ends[some] - lengths[some]), lengths[some])
        np.take(buf, at, out=out[first:last])
    return out


def cuts(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, limit: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text after the last, first byte, byte after the last) of pieces of about `limit` bytes. inside: by byte, what belongs to words.

    A longer text is cut into pieces of its own, where no word is."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        while hi - lo > limit and to == at + 1:
            end = lo + limit
            while end < hi and inside[buf[end]]:  # on to the end of the word
                outside = np.flatnonzero(~inside[buf[end : end + 4096]])
                end += int(outside[0]) if len(outside) else min(4096, hi - end)
            if end >= hi:
                break
            yield at, to, lo, end
            lo = end
        yield at, to, lo, hi
        at = to


def packs(part: np.ndarray, n_parts: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """The order that puts the strings of a part together, the parts that have any, and where each begins in that order."""
    order = np.argsort(part.astype(np.min_scalar_type(n_parts)), kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(part[order]) > 0)) if len(part) else np.zeros(0, np.int64)
    return order, part[order[edges]].tolist(), np.append(edges, len(part))


def equal_strings(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string the number of its class, and for each class one of its strings. Strings that only share a hash are told apart."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    key = Hasher(buf).spans(starts, ends)
    order = np.argsort(key, kind="stable")
    s = key[order]
    fresh = np.append(True, s[1:] != s[:-1])[: len(s)]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(fresh) - 1
    lead = order[fresh]
    own = lead[number]
    later = np.flatnonzero(own != np.arange(len(key)))
    same = lengths[later] == lengths[own[later]]
    some = later[same]
    for at in range(0, len(some), 1 << 18):
        a = some[at : at + (1 << 18)]
        differs = gather(buf, starts[a], lengths[a]) != gather(buf, starts[own[a]], lengths[a])
        if differs.any():
            same[np.searchsorted(later, np.repeat(a, lengths[a])[differs])] = False
    if not same.all():  # a shared hash: by the strings themselves
        known: dict[bytes, int] = {}
        for i in later[~same].tolist():
            number[i] = known.setdefault(buf[starts[i] : ends[i]].tobytes(), len(lead) + len(known))
        first = {number[i]: i for i in reversed(later[~same].tolist())}
        lead = np.concatenate([lead, np.array([first[len(lead) + j] for j in range(len(known))], np.int64)])
    return number, lead


def strings_of(packs_: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The strings of all packs (data: bytes, lengths, ...) as one buffer, and their lengths."""
    if not packs_:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    return np.concatenate([unsqueezed(d[0]) for d in packs_]), np.concatenate([widened(d[1]) for d in packs_])


def spread(words: np.ndarray, n_parts: int) -> np.ndarray:
    """A part for each well-mixed 64-bit number."""
    return ((words >> U64(32)) % U64(n_parts)).astype(np.int64)


def rows(items: list[tuple[int, int, int, list[bytes]]]) -> pa.RecordBatch:
    """ROWS as Arrow."""
    part, block, kind, data = zip(*items, strict=True) if items else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.list_(pa.binary()))], names=["part", "block", "kind", "data"])
