"""Hierarchical packing into windows of several lengths.

Every task packs the documents of its own partition, so nothing is shuffled. A document gives whole long
windows first; what is left is routed to the shortest tier that holds it. Tiers are packed from the
longest down: a piece opens a window of its tier and the gap behind it is filled with pieces of shorter
tiers, the largest that fits first, the last one cut at the gap. What a batch can't fill waits for the
next batch; at a partition's end the rest is joined, and at most one window isn't full. Windows of a tier
are then dealt to step groups of equal tokens, in a snake by attention cost, so that all devices of a
step have the same length and nearly the same work. Windows that don't fill a group wait for the next batch:
a partition has at most one short group a tier.

Cases: null and empty texts are their end token alone; null or repeated doc_ids are rows like others; a
very long text is cut into as many windows as it needs; an empty table gives no windows; extra columns, of
any name, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridseek.llm.common import small_batches
from gridseek.llm.encode import encoder

TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 16 * 1024
#: Pieces that a task holds at once.
HELD = 4096
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"

#: A piece: (length, order, document's row, start in it, its ids, the document's tokens).
Piece = tuple[int, int, object, int, np.ndarray, int]


class Packer:
    """Packs pieces into windows; finished windows are (tier, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.longest, self.held, self.order = tiers, tiers[-1], [], 0
        self.done: list[tuple[int, list[Piece]]] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.longest
        for at in range(0, whole, self.longest):
            self.done.append((self.longest, [self._piece(doc, ids, at, self.longest)]))
        if whole < len(ids):
            self.held.append(self._piece(doc, ids, whole, len(ids) - whole))

    def _piece(self, doc: object, ids: np.ndarray, at: int, length: int) -> Piece:
        self.order += 1
        return (length, self.order, doc, at, ids[at : at + length], len(ids))

    def _cut(self, piece: Piece, length: int) -> tuple[Piece, Piece]:
        n, _, doc, at, ids, total = piece
        self.order += 2
        return (length, self.order - 1, doc, at, ids[:length], total), (n - length, self.order, doc, at + length, ids[length:], total)

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if t >= length)

    def pack(self, last: bool) -> None:
        """Close the windows that can be filled; the other pieces stay held, or at the end are joined."""
        pool = sorted(self.held)  # by length: tiers lie one behind the other
        wait: list[Piece] = []
        while pool:
            first = pool.pop()
            size = self.tier(first[0])
            window, gap = [first], size - first[0]
            if gap and not pool:
                wait += window
                break
            while gap and pool:
                i = bisect_right(pool, gap, key=lambda p: p[0])
                if i:
                    piece = pool.pop(i - 1)
                else:  # the shortest is too long for the gap
                    piece, rest = self._cut(pool.pop(0), gap)
                    insort(pool, rest)
                window.append(piece)
                gap -= piece[0]
            if gap:
                wait += window
            else:
                self.done.append((size, window))
        self.held = wait
        if last and wait:
            window, room = [], self.longest
            for piece in wait:
                while piece[0] > room:
                    head, piece = self._cut(piece, room)
                    self.done.append((self.longest, [*window, head] if room else window))
                    window, room = [], self.longest
                window.append(piece)
                room -= piece[0]
            if window:
                self.done.append((self.tier(self.longest - room) if self.longest - room in self.tiers else self.longest, window))
            self.held = []

    def take(self, step_tokens: int, last: bool) -> list[tuple[int, list[Piece]]]:
        """The closed windows that fill whole step groups of their tier; at the end all."""
        out, wait = [], []
        for tier in self.tiers:
            own = [w for w in self.done if w[0] == tier]
            each = max(1, step_tokens // tier)
            whole = len(own) if last else len(own) // each * each
            out += own[:whole]
            wait += own[whole:]
        self.done = wait
        return out


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A group number for each window: groups are of one tier and step_tokens long; costly windows are dealt in a snake."""
    out, base = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}):
        own = sorted((i for i, (t, _) in enumerate(windows) if t == tier), key=lambda i: -sum(p[0] * p[0] for p in windows[i][1]))
        groups = -(-len(own) * tier // step_tokens)
        for k, i in enumerate(own):
            lap, at = divmod(k, groups)
            out[i] = base + (at if lap % 2 == 0 else groups - 1 - at)
        base += groups
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: the document's id, SCHEMA; ids are little-endian unsigned 32-bit numbers."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(tiers)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        group, kind = number, None
        end = np.array([end_id], np.uint32)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, group
            packer.pack(last)
            windows = packer.take(step_tokens, last)
            rows: list[list] = [[] for _ in range(9)]
            size, groups = 0, step_groups(windows, step_tokens)
            for (tier, window), step in zip(windows, groups, strict=True):
                offset = 0
                for length, _, doc, at, ids, total in window:
                    for column, value in zip(rows, (doc, at, length, ids.tobytes(), total, number, offset, tier, group + step), strict=True):
                        column.append(value)
                    offset += length
                number, size = number + 1, size + offset
                if size > 1 << 20:
                    yield table(rows)
                    rows, size = [[] for _ in range(9)], 0
            group += max(groups, default=-1) + 1
            if rows[0]:
                yield table(rows)

        def table(rows: list[list]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["id", *(x.split()[0] for x in SCHEMA.split(", "))])

        held = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                ids = np.concatenate([encode(text), end])
                packer.add(batch.column(0)[i].as_py(), ids)
                held += len(ids)
                if len(packer.held) >= HELD or held > 2 << 20:
                    yield from flush(False)
                    held = 0
        yield from flush(True)

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)
