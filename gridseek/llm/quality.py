"""Quality rules by repetition coverage.

Every text is read once as bytes. A prefix-sum rolling hash gives each word and line a 64-bit number,
n-grams of several lengths come from the next shorter ones by one multiply-add, and one sort per length
finds those that occur again. What counts is not how many n-grams repeat but how many characters lie in
the parts they cover. One narrow pass, no shuffle.

Cases: null text counts as empty (no words, so `base_failed`); a null or repeated doc_id is a row like
any other; other columns, of any name, are ignored by `quality_report` and kept by `quality_filter`; a very
long text is a block of its own and takes some 100 bytes a word; an empty table gives an empty result.
Equal hashes of different n-grams are as likely as 2^-64 for a pair in a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridseek.llm.common import Block, Hasher, U64, blocks, mix, small_batches

_STEP = U64(0x9FB21C651E98DF25)
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Percentages of a text's word characters (of its lines for `lines`) above which it is rejected."""

    min_words: int = 50
    repeat_words: int = 50  # words in 3-word windows that occur twice
    ngram_chars: dict[int, int] = field(default_factory=lambda: {5: 30, 6: 29, 8: 27, 10: 25})  # in repeated n-grams, every copy counted
    lines: int = 30  # lines equal to an earlier one
    line_chars: int = 30  # characters of such lines
    symbols: int = 20  # symbols for each 100 words


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_ngram_chars array<long>, base_failed boolean, kept boolean"


def _again(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one."""
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one before them."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(s), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def _per_doc(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[edges])


def measure(block: Block, limits: Limits) -> dict[str, np.ndarray]:
    """The figures of SCHEMA for each text of the block."""
    buf, offsets, hasher = block.buf, block.offsets, Hasher(block.buf)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    chars = points[block.ends] - points[block.starts]
    doc = block.word_doc()
    out = {"n_words": block.n_words.astype(np.int64), "word_chars": _per_doc(chars, block.word_lo)}
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = _per_doc(symbol[buf], offsets)

    # lines: each starts after a newline or with its text
    newline = np.flatnonzero(buf == 10)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], newline + 1)
    starts = starts[starts < len(buf)]
    starts = starts[np.searchsorted(offsets, starts, side="right") - 1 < block.n]
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    ends = ends - (buf[ends - 1] == 10)  # without its newline
    line_doc = np.searchsorted(offsets, starts, side="right") - 1
    worded = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends, line_doc = starts[worded], ends[worded], line_doc[worded]
    later = _later(hasher.spans(starts, ends) ^ mix(line_doc.astype(U64)))
    line_edges = np.searchsorted(line_doc, np.arange(block.n + 1))
    line_chars = _word_sum(chars, block.starts, starts, ends)
    out["n_dup_lines"], n_lines = _per_doc(later, line_edges), np.diff(line_edges)
    out["dup_line_chars"] = _per_doc(np.where(later, line_chars, 0), line_edges)

    # n-grams of words
    word = hasher.spans(block.starts, block.ends)
    salt, left = mix(doc.astype(U64)), np.repeat(block.word_lo[1:], block.n_words) - np.arange(len(doc))  # words from here to the text's end
    gram, covered = word, []
    for n in range(2, max(limits.ngram_chars) + 1):
        if len(gram) <= 1:
            gram = gram[:0]
        else:
            gram = gram[:-1] * _STEP + word[n - 1 :]
        if n != 3 and n not in limits.ngram_chars:
            continue
        at = np.flatnonzero(left[: len(gram)] >= n)
        hit = at[_again(mix(gram[at]) ^ salt[at])]
        edge = np.zeros(len(doc) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + n, -1)
        inside = np.cumsum(edge[:-1]) > 0
        if n == 3:
            out["n_repeat_words"] = _per_doc(inside, block.word_lo)
        if n in limits.ngram_chars:
            covered.append(_per_doc(np.where(inside, chars, 0), block.word_lo))
    out["dup_ngram_chars"] = np.stack(covered, axis=1)
    words, total = out["n_words"], out["word_chars"]
    out["base_failed"] = (words < limits.min_words) | (100 * out["n_repeat_words"] > limits.repeat_words * words)
    bad = out["base_failed"] | (100 * out["n_dup_lines"] > limits.lines * n_lines) | (100 * out["dup_line_chars"] > limits.line_chars * total) | (100 * out["n_symbols"] > limits.symbols * words)
    for column, most in zip(covered, limits.ngram_chars.values(), strict=True):
        bad = bad | (100 * column > most * total)
    out["kept"] = ~bad
    return out


def _word_sum(chars: np.ndarray, word_starts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(chars)])
    return sums[np.searchsorted(word_starts, hi)] - sums[np.searchsorted(word_starts, lo)]


def _arrow(figures: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    out = {}
    for name, values in figures.items():
        if values.ndim == 2:
            out[name] = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
        else:
            out[name] = pa.array(values)
    return out


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """A row for each document: its id, the figures of SCHEMA and the verdict."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches):
            got = _arrow(measure(block, limits))
            yield pa.RecordBatch.from_arrays([part.column(0), *(got[n] for n in names)], names=["id", *names])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, part_text(at)):
            yield part.filter(pa.array(measure(block, limits)["kept"]))

    def part_text(i: int) -> str:
        return f"c{i}"

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may clash
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
