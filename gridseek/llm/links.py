"""From signatures to classes: buckets, verified links, connected components.

Nodes with a signature value (a key) in common share a bucket. Keys travel packed: a block of texts sends
one string of (key, node) pairs to each part of the key space, and a part's reader, which keeps one entry a
key, passes on the nodes of the keys that a second node has. Buckets with the same members count once.

Every two members of a bucket are compared unless links already join them, so no link is lost that shares
a key; but no pair is listed. A bucket within BLOCK_ROWS members and BLOCK_CHARS of content is one cell: a
task holds it, counts what its members share and merges those that are linked. A larger one is
held against one leader first, the member of the fullest buckets, a cell for each block. What that doesn't
join to the bucket's largest class, its outsiders, meets all members, in cells of a block of outsiders and
a block of members. A block is chosen by hash, so that no bucket is ever gathered or sorted as a whole.

A task puts out a star for each component of its own. Classes come from the stars by hash-to-minimum with
pointer jumping. A join by a key that may be hot (a bucket, a label) broadcasts what belongs to the keys of more than
a thousandth of all rows, of which there are a thousand at most, and is shuffled for the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.llm.common import U64, slices, stored

#: Members of a block of a bucket and characters of their contents, about.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 19
#: Contents that a task works on at a time, whole cells.
GROUP_CHARS = 1 << 18
#: A table within so many bytes is broadcast; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: Keys of more than this part of all rows are hot.
HOT_PART = 1000
#: Pairs of a cell up to which they are compared one by one, and uses of an element up to which they are counted one by one.
FEW_PAIRS, FEW_USES = 16384, 2048
#: Sets that are held at a time.
SETS = 1024
#: Members of a bucket up to which it is settled together with others of its least member.
SHARED = 64
#: Bytes of the tables that bound what two members share.
SLOTS = 8 << 20
#: Slots that are set, and bytes of theirs that are compared, at a time: what a core's cache holds.
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Measure:
    """How two contents compare. elements: 64-bit hashes of what each content consists of; two contents are linked
    if their sets have a Jaccard similarity of `threshold` and `linked`, if given, says so of the elements."""

    elements: Callable[[list[str]], list[np.ndarray]]
    threshold: float = 0.8
    linked: Callable[[np.ndarray, np.ndarray], bool] | None = None


def small(df: DataFrame, row_bytes: int = 24) -> DataFrame:
    """df, to be broadcast if it takes BROADCAST_BYTES at most, counted here. df should be stored."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def attached(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """rows with what per_key says of their key. per_key: one row a key, `size` (the rows of that key) among its columns. Both stored."""
    keys, total = per_key.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if keys * 48 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_key), key)
    above = F.col("size") > max(64, total // HOT_PART)
    hot = F.broadcast(per_key.filter(above))
    return rows.join(hot, key).union(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.filter(~above), key))


# ---- buckets


def packed(spread: np.ndarray, rows: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Rows of 64-bit numbers as one string for each part; `spread`, 64 well-mixed bits a row, says which part."""
    part = ((spread.view(U64) >> U64(32)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[own[0]]), rows[own].tobytes()) for own in np.split(order, edge)] if len(part) else []


def entries(nodes: np.ndarray, keys: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """The packed (key, node) pairs of some nodes, which have a row of keys each."""
    flat = np.ascontiguousarray(keys).view(np.int64).ravel()
    return packed(flat, np.stack([flat, np.repeat(nodes, keys.shape[1])], axis=1), parts)


def number_of_parts(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class _Meetings:
    """One entry for each key seen; takes pairs in any order and gives back those of keys with two nodes or more.

    A node may be given back again if it comes again later."""

    def __init__(self) -> None:
        self.key, self.node, self.told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def take(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, node = np.concatenate([self.key, pairs[:, 0]]), np.concatenate([self.node, pairs[:, 1]])
        told = np.concatenate([self.told, np.zeros(len(pairs), bool)])
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        once, order = order[~several], order[several]
        lone, key = key[~several], key[several]
        node_, told_ = node[order], told[order]
        order = np.lexsort((~told_, node_, key))
        key, node_, told_ = key[order], node_[order], told_[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node_[1:] != node_[:-1])])[: len(key)]
        key, node_, told_ = key[new], node_[new], told_[new]
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        size = np.diff(np.append(lead, len(key)))
        many = (size > 1) | np.logical_or.reduceat(told_, lead) if len(lead) else np.zeros(0, bool)
        go = np.repeat(many, size) & ~told_
        self.key, self.node, self.told = np.concatenate([lone, key[lead]]), np.concatenate([node[once], node_[lead]]), np.concatenate([told[once], many])
        return key[go], node_[go]


def memberships(strings: DataFrame) -> DataFrame:
    """(key, n) for all keys of two nodes or more, from packed strings (part, entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = _Meetings(), [], 0

        def settle() -> pa.RecordBatch:
            key, node = seen.take(np.frombuffer(b"".join(held), np.int64).reshape(-1, 2))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "n"])

        for batch in batches:
            for pairs in batch.column(1).to_pylist():
                held.append(pairs)
                size += len(pairs) // 16
                if size > max(1 << 20, len(seen.key)):
                    yield settle()
                    size = 0
        if held:
            yield settle()

    return strings.repartition("part").mapInArrow(run, "key long, n long").distinct()


# ---- links


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    size = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)]
    _, token = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sides = token[: size[0].sum()], token[size[0].sum() :]
    owner = [np.repeat(np.arange(len(s)), s) for s in size]
    count = [np.bincount(x, minlength=len(token) and token.max() + 1) for x in sides]
    uses = count[0] * count[1]
    out = np.zeros((len(left), len(right)), np.float32)
    common = np.flatnonzero(uses > FEW_USES)
    nth = np.full(len(uses), -1)
    for lo in range(0, len(common), 2048):
        some = common[lo : lo + 2048]
        nth[:] = -1
        nth[some] = np.arange(len(some))
        a, b = (np.zeros((len(s), len(some)), np.float32) for s in size)
        for m, own, tok in ((a, owner[0], sides[0]), (b, owner[1], sides[1])):
            here = nth[tok] >= 0
            m[own[here], nth[tok[here]]] = 1
        out += a @ b.T
    rare = (uses > 0) & (uses <= FEW_USES)
    row, tok = owner[0][rare[sides[0]]], sides[0][rare[sides[0]]]
    order = np.argsort(sides[1], kind="stable")
    column, begin = owner[1][order], np.cumsum(count[1]) - count[1]
    times = count[1][tok]
    edges = np.append(np.searchsorted(np.cumsum(times), np.arange(0, times.sum(), 1 << 20), side="right"), len(tok))
    for lo, to in zip(edges[:-1], edges[1:], strict=True):
        t = times[lo:to]
        at = np.repeat(begin[tok[lo:to]] - (np.cumsum(t) - t), t) + np.arange(t.sum())
        out += np.bincount(np.repeat(row[lo:to], t) * len(right) + column[at], minlength=out.size).reshape(out.shape)
    return out


class _Group:
    """The elements of some cells' members, with a table of slots for each member that bounds what two share."""

    def __init__(self, nodes: list[int], elements: list[np.ndarray]):
        self.nodes, self.elements = nodes, elements
        self.size = np.fromiter(map(len, elements), np.int64, len(elements))
        slots = 64
        while slots < 16 * self.size.max() and 2 * slots * len(elements) <= 8 * SLOTS and slots < 1 << 24:
            slots *= 2
        slot = (np.concatenate(elements) * U64(0x9E3779B97F4A7C15) >> U64(40)).astype(np.int64) & (slots - 1)
        ends, parts, step = np.append(0, np.cumsum(self.size)), [], max(1, AT_ONCE // slots)
        table = np.zeros(min(step, len(elements)) * slots, bool)
        for lo in range(0, len(elements), step):
            to = min(lo + step, len(elements))
            table[:] = False
            table[np.repeat(np.arange(to - lo) * slots, self.size[lo:to]) + slot[ends[lo] : ends[to]]] = True
            parts.append(np.packbits(table[: (to - lo) * slots]).view(np.uint64).reshape(to - lo, -1))
        self.table = np.concatenate(parts)
        self.least = np.bitwise_count(self.table).sum(axis=1, dtype=np.int64)  # distinct elements, at least
        self.distinct: dict[int, np.ndarray] = {}

    def set_of(self, i: int) -> np.ndarray:
        """A node's elements, each once and sorted; it may be a member of several cells."""
        own = self.distinct.get(self.nodes[i])
        if own is None:
            if len(self.distinct) >= SETS:
                self.distinct.clear()
            own = np.sort(self.elements[i])
            own = self.distinct[self.nodes[i]] = own[np.append(True, own[1:] != own[:-1])[: len(own)]]
        return own

    def alike(self, i: int, j: int, threshold: float) -> bool:
        own, other = self.set_of(i), self.set_of(j)
        every = np.concatenate((own, other))
        every.sort()
        both = int(np.count_nonzero(every[1:] == every[:-1]))
        return both >= threshold * (len(every) - both)

    def most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements i and j share, at most: the slots that both have, and the elements beyond one a slot of the one with fewer such."""
        out, step, more = np.empty(len(i), np.int64), max(1, AT_ONCE // 16 // self.table.shape[1]), self.size - self.least
        for lo in range(0, len(i), step):
            a, b = i[lo : lo + step], j[lo : lo + step]
            out[lo : lo + step] = np.bitwise_count(self.table[a] & self.table[b]).sum(axis=1, dtype=np.int64) + np.minimum(more[a], more[b])
        return out


def link_group(cells: list[tuple[list[int], list[int]]], nodes: list[int], elements: list[np.ndarray], measure: Measure, forest: _Forest) -> None:
    """Join in `forest` what the links of some cells join: the sides and the places, in `nodes` and `elements`, of their members.

    A cell's links are those among its members of side 0 if there are no others, else those between side 0 and side 1."""
    todo: list[tuple[np.ndarray, np.ndarray]] = []
    group = _Group(nodes, elements)
    for sides, members in cells:
        member = np.array(members)
        if 1 in sides:
            side = np.array(sides)
            rows, columns = member[side == 0], member[side == 1]
            few = len(rows) * len(columns) <= FEW_PAIRS
            i, j = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
        else:
            rows = columns = member
            few = len(member) * len(member) <= FEW_PAIRS
            i, j = (member[x] for x in _PAIRS[len(member)]) if few else (member, member)
        if few:
            todo.append((i, j))
            continue
        left = [np.unique(elements[x]) for x in rows]
        right = left if columns is rows else [np.unique(elements[x]) for x in columns]
        both = overlaps(left, right).astype(np.float64)
        union = np.fromiter(map(len, left), float, len(left))[:, None] + np.fromiter(map(len, right), float, len(right)) - both
        i, j = np.nonzero((both >= measure.threshold * union) & (union > 0))
        if columns is rows:
            i, j = i[i < j], j[i < j]
        forest.grow(nodes, rows[i], columns[j], lambda x, y: measure.linked is None or measure.linked(elements[x], elements[y]))
    if not todo:
        return
    i, j = (np.concatenate([x[k] for x in todo]) for k in (0, 1))
    most = group.most(i, j)
    size, least = group.size, group.least
    share = measure.threshold / (1 + measure.threshold)
    good = (most >= share * (least[i] + least[j]) - 1e-6) & (np.minimum(size[i], size[j]) >= measure.threshold * np.maximum(least[i], least[j]) - 1e-6)
    edge = np.concatenate([[0], np.cumsum([len(x[0]) for x in todo])])
    kept = np.concatenate([[0], np.cumsum(good)])[edge]
    i, j = i[good], j[good]
    for k in np.flatnonzero(np.diff(kept)).tolist():
        cell = slice(int(kept[k]), int(kept[k + 1]))
        forest.grow(nodes, i[cell], j[cell], lambda x, y: group.alike(x, y, measure.threshold) and (measure.linked is None or measure.linked(elements[x], elements[y])))


#: All pairs of so many members.
_PAIRS = [np.triu_indices(n, 1) for n in range(int(FEW_PAIRS**0.5) + 1)]


class _Forest:
    """Union-find over the nodes of a task: what one cell has linked no other asks again."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, n: int) -> int:
        parent = self.parent
        while (up := parent.get(n, n)) != n:
            parent[n] = n = parent.get(up, up)
        return n

    def grow(self, nodes: list[int], i: np.ndarray, j: np.ndarray, linked: Callable[[int, int], bool]) -> None:
        """Join those of the pairs (i, j) of members of two components that are `linked`.

        The member of most pairs is held against the others first, then only pairs of two components are left."""
        while len(i):
            now, rest = np.ones(len(i), bool), None
            if len(i) > 4:
                hub = np.bincount(np.concatenate([i, j]) - (low := min(i.min(), j.min()))).argmax() + low
                now = (i == hub) | (j == hub)
                rest = ~now
            for x, y in zip(i[now].tolist(), j[now].tolist(), strict=True):
                a, b = self.find(nodes[x]), self.find(nodes[y])
                if a != b and linked(x, y):
                    self.parent[max(a, b)] = min(a, b)
            if rest is None:
                break
            i, j = i[rest], j[rest]
            if len(i):
                members = np.unique(np.concatenate([i, j]))
                root = np.array([self.find(nodes[x]) for x in members.tolist()])
                apart = root[np.searchsorted(members, i)] != root[np.searchsorted(members, j)]
                i, j = i[apart], j[apart]


def settled(cells: DataFrame, content: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): a star for each component that a task finds by the links of cells (key, lo, hi, side, n; `near`, cells of one value are settled together) on content (n, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        nodes, texts, chars, now = [], [], 0, None
        open_: dict[tuple[int, int, int], tuple[list[int], list[int]]] = {}

        def close() -> None:
            link_group(list(open_.values()), nodes, measure.elements(texts), measure, forest)
            for held in (nodes, texts, open_):
                held.clear()

        for batch in slices(batches):
            near, node, text, lists = batch.columns
            edges = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            flat = lists.flatten()
            of = list(zip(*(flat.field(k).to_pylist() for k in range(3)), strict=True))
            side = flat.field(3).to_pylist()
            for group, n, content, lo, hi in zip(near.to_pylist(), node.to_pylist(), text.to_pylist(), edges[:-1], edges[1:], strict=True):
                if group != now:
                    if chars > GROUP_CHARS:
                        close()
                        chars = 0
                    now = group
                for k in range(lo, hi):
                    sides, members = open_.setdefault(of[k], ([], []))
                    sides.append(side[k])
                    members.append(len(nodes))
                nodes.append(n)
                texts.append(content)
                chars += len(content)
        if nodes:
            close()
        if forest.parent:
            yield pa.RecordBatch.from_arrays([pa.array([forest.find(n) for n in forest.parent], pa.int64()), pa.array(list(forest.parent), pa.int64())], names=["a", "b"])

    # a node's content travels once for all its cells of one `near`
    by_node = cells.groupBy("near", "n").agg(F.collect_list(F.struct("key", "lo", "hi", "side")).alias("cells"))
    full = by_node.join(content, "n").select("near", "n", "content", "cells")
    return full.repartition("near").sortWithinPartitions("near").mapInArrow(run, "a long, b long")


def large_bucket_links(members: DataFrame, sizes: DataFrame, content: DataFrame, measure: Measure) -> DataFrame:
    """Links of the buckets of several blocks. members: key, n; sizes: key, size, blocks."""
    member = stored(attached(members, sizes, "key"))
    content = content.join(small(stored(member.select("n").distinct())), "n", "left_semi")  # all others needn't be shuffled
    support = member.groupBy("n").agg(F.sum("size").alias("support"))
    leads = stored(member.join(support, "n").groupBy("key", "size", "blocks").agg(F.max(F.struct("support", "n")).getField("n").alias("a")))

    def crossed(cells: DataFrame) -> DataFrame:
        return settled(cells.withColumn("near", F.xxhash64("key", "lo", "hi")), content, measure)

    def of(hashed: int, count: str):
        return F.pmod(F.xxhash64("n", F.lit(hashed)), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    zero, one = F.lit(0), F.lit(1)
    others = attached(member.select("key", "n"), leads, "key").filter("n <> a")
    cells = others.select("key", zero.alias("lo"), of(1, "blocks").alias("hi"), one.alias("side"), "n")
    cells = cells.union(leads.select("key", zero.alias("lo"), every("blocks").alias("hi"), zero.alias("side"), F.col("a").alias("n")))
    first = stored(crossed(cells))
    named = stored(member.select("key", "n").join(components(first), "n", "left").select("key", "n", F.coalesce("label", "n").alias("label")))
    kinds = named.groupBy("key", "label").agg(F.count("*").alias("own")).groupBy("key").agg(F.max(F.struct("own", "label")).alias("main"))
    mixed = kinds.join(leads.drop("a"), "key").withColumn("out", F.col("size") - F.col("main.own")).filter("out > 0")
    mixed = stored(mixed.select("key", "size", "blocks", F.col("main.label").alias("main"), F.least("out", F.ceil(F.col("out") * F.col("blocks") / F.col("size"))).cast("int").alias("rows")))
    open_ = stored(attached(named, mixed, "key"))
    cells = open_.select("key", every("rows").alias("lo"), of(1, "blocks").alias("hi"), one.alias("side"), "n")
    cells = cells.union(open_.filter("label <> main").select("key", of(2, "rows").alias("lo"), every("blocks").alias("hi"), zero.alias("side"), "n"))
    return first.union(crossed(cells))


def classes(strings: DataFrame, contents: Callable[[DataFrame], DataFrame], measure: Measure) -> DataFrame:
    """(n, label) for the nodes that are linked to others: label is the least of its class.

    strings: packed entries (part, entries). contents: from a table of n to (n, content)."""
    member = stored(memberships(strings))
    nodes = stored(member.select("n").distinct())
    content = stored(contents(nodes))
    if content.count() > nodes.count():  # documents that are there several times
        content = stored(content.dropDuplicates(["n"]))
    length = small(content.select("n", F.length("content").alias("chars")))
    about = member.join(length, "n").groupBy("key")
    # sums of hashes tell sets of members apart; a sum that overflows stands for its key alone
    seal = [F.coalesce(F.try_sum(F.shiftright(F.xxhash64("n", F.lit(s)), 20)), F.col("key")).alias(f"seal{s}") for s in (0, 1)]
    # the small buckets of a family mostly have its least member, and a node has few buckets: these are dealt to one task
    sizes = about.agg(F.count("*").alias("size"), F.sum("chars").alias("chars"), F.min("n").alias("near"), *seal).groupBy("size", "chars", "near", "seal0", "seal1").agg(F.min("key").alias("key"))
    blocks = F.least("size", F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("chars") / BLOCK_CHARS))).cast("int")
    near = F.when(F.col("size") <= SHARED, F.col("near")).otherwise(F.col("key"))
    sizes = stored(sizes.select("key", "size", near.alias("near"), blocks.alias("blocks")))
    inner = attached(member, sizes.filter("blocks = 1"), "key")
    zero = F.lit(0)
    links = settled(inner.select("near", "key", zero.alias("lo"), zero.alias("hi"), zero.alias("side"), "n"), content, measure)
    large = sizes.filter("blocks > 1").select("key", "size", "blocks")
    if not large.isEmpty():
        links = links.union(large_bucket_links(member, large, content, measure))
    return components(links)


# ---- classes


def components(edges: DataFrame) -> DataFrame:
    """(n, label) for the nodes of edges (a, b): the least node of each connected component."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = stored(both.groupBy("b").agg(F.count("*").alias("size")))
    labels = stored(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        told = stored(degree.join(labels.withColumnRenamed("n", "b"), "b"))
        near = attached(both, told, "b").groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        lower = stored(labels.join(near, "n").select("n", F.least("label", "near").alias("low"), "label"))
        tops = lower.groupBy("low").agg(F.count("*").alias("size")).join(labels.select(F.col("n").alias("low"), F.col("label").alias("top")), "low", "left")
        tops = stored(tops.select("low", "size", F.coalesce("top", "low").alias("top")))
        new = stored(attached(lower, tops, "low").select("n", F.least("low", "top").alias("label"), F.col("label").alias("was")))
        labels = new.select("n", "label")
        if new.filter("label <> was").isEmpty():
            return labels
