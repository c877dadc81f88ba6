"""Vector codes by Lloyd's rounds over heaps.

Vectors become integers and are cut into parts; each part position has a codebook. A block of vectors keeps,
for each position and entry, a heap of the parts assigned to that entry, keyed by the slack between the second
nearest entry (lower bound) and its own (upper bound) when it was last measured. When entries move, an entry's
own drift and the largest drift of the others add up to a bar; only the parts at the top of a heap whose slack the
bar has passed can have another nearest entry. These are popped and measured again, exactly and in integers; all
others keep their entry unread. A block also keeps its sums by entry and changes them by the parts that moved, so
a round aggregates a few numbers for each task and never the vectors. Blocks go from round to round as a table
in the shared folder; each round's table is deleted when the next one is written.

Heaps are arrays in level order: the popped places are a subtree from the root down, found level by level, and
places that change are sifted level by level from the deepest, all of a level at once.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do those of another
length than most (ties: the shorter), those that can't be cut into equal parts, and those with a component of
2^14 or more, whose squared distances wouldn't fit 64 bits. Rows of one id are rows of their own, a null id
sorts last; null labels are one label; fewer rows than entries give as many entries; an empty table gives an
empty result; extra columns are ignored. Sums are exact up to 2^36 vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.llm.common import folder, kept_in, remove
from gridseek.llm.links import attached

#: Vectors of a block.
BLOCK = 8192
#: What rounding can add to a bound, far more than it does: components are integers below 2^26.
TOLERANCE = 1e-3
BOUND = float(1 << 14)


@dataclass(frozen=True)
class Params:
    parts: int = 8
    entries: int = 16  # at most 256, for two hex digits
    rounds: int = 6
    scale: int = 4096


def popped(key: np.ndarray, bar: float) -> np.ndarray:
    """The places of a heap whose keys are `bar` at most: a subtree from the root down."""
    at, found = np.arange(min(1, len(key))), [np.zeros(0, np.int64)]
    while len(at):
        at = at[key[at] <= bar]
        found.append(at)
        at = np.concatenate([2 * at + 1, 2 * at + 2])
        at = at[at < len(key)]
    return np.concatenate(found)


def sift(key: np.ndarray, who: np.ndarray, changed: np.ndarray) -> None:
    """Make a heap of an array that is one but for the places `changed`."""
    n = len(key)
    for level in range(n.bit_length() - 1, -1, -1):
        here = changed[(changed >= (1 << level) - 1) & (changed < (2 << level) - 1)]
        at = here
        while len(at):  # places of one level have subtrees of their own
            at = at[2 * at + 1 < n]
            left = 2 * at + 1
            right = np.minimum(left + 1, n - 1)
            child = np.where(key[right] < key[left], right, left)
            down = key[child] < key[at]
            at, child = at[down], child[down]
            key[at], key[child] = key[child], key[at]
            who[at], who[child] = who[child], who[at]
            at = child
        changed = np.unique(np.concatenate([changed[changed < (1 << level) - 1], (here[here > 0] - 1) // 2]))


def exchanged(key: np.ndarray, who: np.ndarray, out: np.ndarray, new_key: np.ndarray, new_who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A heap without the places `out` and with new members."""
    fill = min(len(out), len(new_key))
    key, who, out = key.copy(), who.copy(), np.sort(out)
    key[out[:fill]], who[out[:fill]] = new_key[:fill], new_who[:fill]
    changed, holes = out[:fill], out[fill:]
    if len(holes):  # the last members that stay move into the holes
        n = len(key) - len(holes)
        stays = np.ones(len(key), bool)
        stays[holes] = False
        tail = np.flatnonzero(stays[n:]) + n
        holes = holes[holes < n]
        key[holes], who[holes] = key[tail], who[tail]
        key, who, changed = key[:n], who[:n], np.concatenate([changed[changed < n], holes])
    else:
        changed = np.concatenate([changed, np.arange(len(key), len(key) + len(new_key) - fill)])
        key, who = np.concatenate([key, new_key[fill:]]), np.concatenate([who, new_who[fill:]])
    sift(key, who, changed)
    return key, who


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts and entries, in integers."""
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        gap = x[:, j].astype(np.int64)[:, None] - book[:, j][None]
        out += gap * gap
    return out


class Block:
    """Vectors cut into parts (x: vector, position, component), the entry of each part, heaps and sums."""

    def __init__(self, x: np.ndarray, n_entries: int):
        self.x, self.k = x, n_entries
        n, parts, width = x.shape
        self.entry = np.full((parts, n), -1, np.int16)
        self.heaps = [[(np.zeros(0), np.zeros(0, np.int32)) for _ in range(n_entries)] for _ in range(parts)]
        self.sums = np.zeros((parts, n_entries, width + 1), np.int64)
        self.rescanned = 0

    def assign(self, books: np.ndarray, bars: np.ndarray) -> None:
        """books: position, entry, component; bars: position, entry, the drift so far."""
        for p, heaps in enumerate(self.heaps):
            out = [popped(key, bars[p, e] + TOLERANCE) for e, (key, _) in enumerate(heaps)]
            who = np.arange(len(self.x)) if (self.entry[p] < 0).any() else np.concatenate([heaps[e][1][o] for e, o in enumerate(out)])
            if not len(who):
                continue
            self.rescanned += len(who)
            d = squares(self.x[who, p], books[p])
            new = d.argmin(1)  # ties go to the lower entry
            two = np.partition(d, 1, axis=1)[:, :2] if d.shape[1] > 1 else np.stack([d[:, 0], np.full(len(d), np.iinfo(np.int64).max)], axis=1)
            root = np.sqrt(two.astype(np.float64))
            key = root[:, 1] - root[:, 0] + bars[p, new]
            old = self.entry[p, who]
            self._move(p, who[old != new], old[old != new], new[old != new])
            self.entry[p, who] = new
            order = np.argsort(new, kind="stable")
            edges = np.searchsorted(new[order], np.arange(self.k + 1))
            for e in range(self.k):
                into = order[edges[e] : edges[e + 1]]
                if len(into) or len(out[e]):
                    heaps[e] = exchanged(*heaps[e], out[e], key[into], who[into].astype(np.int32))

    def _move(self, p: int, who: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        x = np.concatenate([self.x[who, p].astype(np.int64), np.ones((len(who), 1), np.int64)], axis=1)
        np.add.at(self.sums[p], new, x)
        np.subtract.at(self.sums[p], old[old >= 0], x[old >= 0])

    def errors(self, books: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.x), np.int64)
        for p in range(len(books)):
            gap = self.x[:, p].astype(np.int64) - books[p][self.entry[p]]
            total += (gap * gap).sum(1)
        return total

    def state(self) -> dict[str, bytes]:
        each = [h for heaps in self.heaps for h in heaps]
        return {
            "x": self.x.tobytes(),
            "entry": self.entry.tobytes(),
            "sizes": np.array([len(k) for k, _ in each], np.int32).tobytes(),
            "keys": b"".join(k.tobytes() for k, _ in each),
            "members": b"".join(w.tobytes() for _, w in each),
            "sums": self.sums.tobytes(),
        }

    @classmethod
    def of(cls, row: dict[str, bytes], parts: int, width: int, n_entries: int) -> Block:
        x = np.frombuffer(row["x"], np.int32).reshape(-1, parts, width)
        own = cls(x, n_entries)
        if row["entry"]:
            own.entry = np.frombuffer(row["entry"], np.int16).reshape(parts, -1).copy()
            edges = np.cumsum(np.frombuffer(row["sizes"], np.int32))[:-1]
            keys, members = np.split(np.frombuffer(row["keys"], np.float64), edges), np.split(np.frombuffer(row["members"], np.int32), edges)
            own.heaps = [list(zip(keys[i : i + n_entries], members[i : i + n_entries], strict=True)) for i in range(0, parts * n_entries, n_entries)]
            own.sums = np.frombuffer(row["sums"], np.int64).reshape(parts, n_entries, width + 1).copy()
        return own


_STATE = ("x", "entry", "sizes", "keys", "members", "sums")


def _one_row(ids: pa.ListScalar, labels: pa.ListScalar, state: dict[str, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ids], ids.type), pa.array([labels], labels.type), *(pa.array([state[c]], pa.binary()) for c in _STATE)], names=["ids", "labels", *_STATE])


def _blocks(kept: DataFrame, p: Params, dim: int) -> DataFrame:
    """Rows of BLOCK vectors: ids, labels and the integers, as yet without entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def full(own: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(own).combine_chunks()
            for at in range(0, t.num_rows, BLOCK):
                s = t.slice(at, BLOCK).combine_chunks()
                v = s.column(2).chunk(0).flatten().to_numpy(zero_copy_only=False)
                state = dict.fromkeys(_STATE, b"") | {"x": np.floor(p.scale * v).astype(np.int32).tobytes()}
                ids, labels = (pa.scalar(s.column(i).to_pylist(), pa.list_(s.column(i).type)) for i in (0, 1))
                yield _one_row(ids, labels, state)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK:
                yield from full(held)
                held = []
        if held and sum(x.num_rows for x in held):
            yield from full(held)

    return kept.select("id", "label", "v").mapInArrow(run, _schema(kept))


def _schema(kept: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    return f"ids array<{kind['id']}>, labels array<{kind['label']}>, " + ", ".join(f"{c} binary" for c in _STATE)


def _assigned(blocks: DataFrame, schema: str, p: Params, books: np.ndarray, bars: np.ndarray) -> DataFrame:
    """The blocks after a round's assignment. Codebooks are of fixed size and travel with the function."""
    k, width = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = Block.of({c: b.column(c)[i].as_py() for c in _STATE}, p.parts, width, k)
                own.assign(books, bars)
                yield _one_row(b.column("ids")[i], b.column("labels")[i], own.state())

    return blocks.mapInArrow(run, schema)


def _totals(blocks: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums and counts by position and entry: a row of each for a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(np.prod(shape)), np.int64)
        for b in batches:
            for s in b.column(0):
                total += np.frombuffer(s.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in blocks.select("sums").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(shape)


def vector_codes(vectors: DataFrame, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """A row (id, code, error, label_error) for each vector that takes part, and the codebooks (position, entry, component)."""
    p, spark = params, vectors.sparkSession
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < BOUND)
    kept = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    kept = kept.filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % p.parts == 0) & F.forall("v", fits))
    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    most = kept.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()  # a row for each length
    if most is None:
        return spark.createDataFrame([], f"{id_col} {kind['id']}, code string, error long, label_error long"), np.zeros((p.parts, 0, 0), np.int64)
    dim = most["dim"]
    kept = kept.filter(F.size("v") == dim)
    first = kept.select("v", "id").orderBy(F.col("id").asc_nulls_last(), "v").limit(p.entries).collect()
    books = np.floor(p.scale * np.array([r["v"] for r in first])).astype(np.int64).reshape(len(first), p.parts, -1).transpose(1, 0, 2).copy()
    bars, shape = np.zeros(books.shape[:2]), (*books.shape[:2], books.shape[2] + 1)

    schema, path = _schema(kept), folder(spark)
    blocks = kept_in(_blocks(kept, p, dim), path)
    for _ in range(p.rounds):
        after = folder(spark)
        blocks = kept_in(_assigned(blocks, schema, p, books, bars), after)
        remove(spark, path)
        path, totals = after, _totals(blocks, shape)
        new = np.where(totals[..., -1:] > 0, totals[..., :-1] // np.maximum(totals[..., -1:], 1), books)
        drift = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64))
        if not drift.any():  # nothing changes any more
            break
        order = np.sort(drift, axis=1)
        others = np.where(drift == order[:, -1:], order[:, -2:-1] if drift.shape[1] > 1 else 0, order[:, -1:])
        others = np.where((drift == order[:, -1:]).sum(1, keepdims=True) > 1, order[:, -1:], others)
        books, bars = new, bars + drift + others

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = Block.of({c: b.column(c)[i].as_py() for c in _STATE}, p.parts, books.shape[2], books.shape[1])
                own.assign(books, bars)
                codes = np.ascontiguousarray(own.entry.T.astype(np.uint8)).tobytes().hex()
                text = pa.array([codes[at : at + 2 * p.parts] for at in range(0, len(codes), 2 * p.parts)])
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, text, pa.array(own.errors(books))], names=["id", "label", "code", "error"])

    label = F.concat(F.lit("="), F.col("label").cast("string"))  # of nulls: a string without the mark
    rows = kept_in(blocks.select("ids", "labels", *_STATE).mapInArrow(coded, f"id {kind['id']}, label {kind['label']}, code string, error long").withColumn("k", F.coalesce(label, F.lit(""))), folder(spark), listed=True)
    remove(spark, path)
    per_label = kept_in(rows.groupBy("k").agg(F.sum("error").alias("label_error"), F.count("*").alias("size")), folder(spark), listed=True)
    return attached(rows, per_label, "k").select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all components as decimal integers, by position, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
