"""Removal of repeated word windows by super-k-mer partitioning.

A window is K consecutive words. Its minimiser is the least hash of its M-word parts, and equal windows
have equal minimisers. Consecutive windows with one minimiser form a super-k-mer. Where its minimiser
comes more than once (the minimisers alone are counted first), it travels as one packed string, its words
as numbers in a small vocabulary, to the minimiser's bucket. There the windows are sorted and counted, and
all but the first are reported. Hashes only order the windows: equality is decided on the words.

Before anything travels, each block of texts settles what it can alone: a window that starts earlier in
the same block is a repeat whatever the others hold, so a block sends each distinct window once. A
passage that a third of all documents share reaches its bucket once per block, not once per document. A
minimiser that still comes very often has several first buckets, by document; the windows that they leave are
dealt one by one, by a hash of their words, to several last ones, so a phrase that very many different texts share
fills no bucket. The number of buckets follows the words that travel. The reports come back as word ranges, keyed
by document, and meet the texts in one join.

Cases: null text has no words; words differ if any byte differs; rows with one doc_id count as one
document in the order (neither of two equal (doc_id, start) is earlier), and a null doc_id comes first;
texts shorter than a window keep all words; a very long text is a block of its own and takes some 100 bytes
a word; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseek.llm.common import Block, Hasher, U64, blocks, mix, small_batches, stored

K, M = 20, 6
BLOCK = 2 << 20
#: Words of a bucket, about; a task holds one bucket at a time.
BUCKET_WORDS = 1 << 20
#: Buckets for each shuffle partition, at least.
BUCKETS_PER_PARTITION = 4
#: Super-k-mers of one minimiser beyond which it has several first buckets, and last ones for each of these.
HEAVY, LAST = 4096, 8
#: One document in so many is looked at for very frequent minimisers; those that hold a larger share than 1 in HOT_KEYS are counted apart.
SAMPLED, HOT_KEYS = 64, 1000
#: Document keys up to this many (16 bytes each) are broadcast, so that other texts needn't be shuffled.
BROADCAST_ROWS = 2_000_000
_UP, _STEP = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)
NO_ID = -(1 << 63)


def window_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, by doubling: O(log k) passes."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, step, have = word, _UP, 0
    out = None
    rest, width = k, 1
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = power[have : have + n] if out is not None else power[:n]
                out = part.copy() if out is None else out * step + part
                have += width
            rest >>= 1
            if rest:
                power = power[: len(power) - width] * step + power[width:]
                step = step * step + U64(2)
                width *= 2
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    got, width = x, 1
    while width * 2 <= w:
        got = np.minimum(got[:-width], got[width:])
        width *= 2
    return np.minimum(got[: len(x) - w + 1], got[w - width : w - width + len(x) - w + 1])


def word_numbers(block: Block) -> np.ndarray:
    """A number for each word, equal for equal words only: hashes propose, bytes decide."""
    h = Hasher(block.buf).spans(block.starts, block.ends)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    size, lead = block.ends - block.starts, first[number]
    differ = size != size[lead]
    suspects = np.flatnonzero((lead != np.arange(len(lead))) & ~differ)
    for lo in range(0, len(suspects), 1 << 16):  # the others lead their kind
        some = suspects[lo : lo + (1 << 16)]
        of = np.repeat(some, size[some])
        shift = np.arange(len(of)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        unlike = block.buf[block.starts[of] + shift] != block.buf[block.starts[lead[of]] + shift]
        differ[of[unlike]] = True
    if differ.any():  # practically never
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(block.buf[s:e].tobytes(), len(known)) for s, e in zip(block.starts, block.ends, strict=True)])
    return number


def not_first(words: np.ndarray, at: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Which windows (words[at : at + k]) have an equal one with a smaller key."""
    if not len(at):
        return np.zeros(0, bool)
    h = window_hashes(mix(words.astype(U64)), k)[at]
    order = np.argsort(h, kind="stable")
    s = h[order]
    lead = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    group = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(s))))
    many = np.flatnonzero(np.diff(np.append(lead, len(s)))[group] > 1)
    out = np.zeros(len(at), bool)
    if not len(many):
        return out
    for lo in range(0, len(many), 1 << 18):
        some = many[lo : lo + (1 << 18)]
        here, there = at[order[some]], at[order[lead[group[some]]]]
        if any((words[here + j] != words[there + j]).any() for j in range(k)):  # two windows with one hash: compare words alone
            rows = np.stack([words[at + j] for j in range(k)], axis=1)
            group = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(group, kind="stable")
            s = group[order]
            lead = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            break
    least = np.minimum.reduceat(key[order], lead)
    out[order] = key[order] > np.repeat(least, np.diff(np.append(lead, len(s))))
    return out


def ranges(starts: np.ndarray, k: int) -> np.ndarray:
    """Sorted window starts as [from, to) ranges of words."""
    cut = np.flatnonzero(np.diff(starts) > k) + 1
    return np.stack([starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + k], axis=1).astype(np.int32)


def pack(numbers: np.ndarray, spell: Callable[[np.ndarray], list[bytes]], begin: np.ndarray, size: np.ndarray, doc_id: np.ndarray, row_hash: np.ndarray, start: np.ndarray) -> bytes:
    """Super-k-mers (spans of numbered words) as one string. spell: the words at these places."""
    flat = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    _, first, code = np.unique(numbers[flat], return_index=True, return_inverse=True)
    vocabulary = b" ".join(spell(flat[first]))
    kind = np.uint16 if len(first) < 1 << 16 else np.uint32
    head = np.array([len(size), len(flat), len(vocabulary), kind().itemsize], np.int64)
    raw = b"".join([head.tobytes(), doc_id.tobytes(), row_hash.tobytes(), start.astype(np.int32).tobytes(), size.astype(np.int32).tobytes(), code.astype(kind).tobytes(), vocabulary])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, words, letters, width = np.frombuffer(raw, np.int64, 4).tolist()
    at, out = 32, []
    for kind, count in ((np.int64, n), (np.int64, n), (np.int32, n), (np.int32, n), (np.uint16 if width == 2 else np.uint32, words)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return (*out, raw[at : at + letters].split(b" "))


SCANNED = "id long, row_hash long, key long, start int, windows int, ranges binary"


def _report(ids: np.ndarray, hashes: np.ndarray, start: np.ndarray, k: int) -> tuple[list, list, list]:
    """Repeated windows by document."""
    if not len(ids):
        return [], [], []
    order = np.lexsort((start, hashes, ids))
    ids, hashes, start = ids[order], hashes[order], start[order]
    edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])]))
    return ids[edge].tolist(), hashes[edge].tolist(), [ranges(x, k).tobytes() for x in np.split(start, edge[1:])]


def scan_block(part: pa.RecordBatch, block: Block, k: int, m: int) -> Iterator[pa.RecordBatch]:
    """What a block settles alone, as ranges, and the super-k-mers of its other windows, as places."""
    ids, hashes = part.column(0).to_numpy(), part.column(1).to_numpy()
    numbers, doc = word_numbers(block), block.word_doc()
    left = np.repeat(block.word_lo[1:], block.n_words) - np.arange(len(doc))
    at = np.flatnonzero(left >= k)
    if not len(at):
        return
    names = [x.split()[0] for x in SCANNED.split(", ")]
    start = at - block.word_lo[doc[at]]
    rank = np.unique(ids, return_inverse=True)[1]
    repeat = not_first(numbers, at, rank[doc[at]].astype(np.int64) << 32 | start, k)
    gone = at[repeat]
    own, rows, spans = _report(ids[doc[gone]], hashes[doc[gone]], start[repeat], k)
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rows, pa.int64()), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.int32()), pa.array(spans, pa.binary())], names=names)
    go = at[~repeat]
    if not len(go):
        return
    word = Hasher(block.buf).spans(block.starts, block.ends)
    minimiser = sliding_min(window_hashes(word, m), k - m + 1)[go]
    edge = np.flatnonzero(np.concatenate([[True], (go[1:] != go[:-1] + 1) | (minimiser[1:] != minimiser[:-1]) | (doc[go[1:]] != doc[go[:-1]])]))
    begin, windows = go[edge], np.diff(np.append(edge, len(go)))
    of = doc[begin]
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[of]), pa.array(hashes[of]), pa.array(minimiser[edge].view(np.int64)), pa.array((begin - block.word_lo[of]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.nulls(len(of), pa.binary())], names=names
    )


SENT = "bucket long, key long, salts int, blob binary"


def _sent(rows: list[tuple[int, int | None, int | None, bytes]]) -> pa.RecordBatch:
    bucket, key, salts, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(key, pa.int64()), pa.array(salts, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "key", "salts", "blob"])


def pack_block(part: pa.RecordBatch, block: Block, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The wanted super-k-mers of a block of (id, row_hash, text, kmers), a string for each bucket.

    A heavy minimiser's go to one of its `salts` first buckets, by document, in strings of their own that carry it and their number."""
    lists = part.column(3)
    owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    key, start, windows, salts = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
    ids, hashes = part.column(0).to_numpy()[owner], part.column(1).to_numpy()[owner]
    numbers = word_numbers(block)
    begin, size = block.word_lo[owner] + start, windows.astype(np.int64) + k - 1
    heavy = salts > 1
    salt = mix(ids.view(U64) ^ hashes.view(U64)) % np.maximum(salts, 1).astype(U64)
    bucket = (mix(key.view(U64) + salt * _STEP) % U64(buckets)).astype(np.int64)
    group = np.where(heavy, key, 0)
    order = np.lexsort((group, heavy, bucket))
    b, g, h = bucket[order], group[order], heavy[order]
    edge = np.flatnonzero((b[1:] != b[:-1]) | (g[1:] != g[:-1]) | (h[1:] != h[:-1])) + 1
    groups = np.split(order, edge)

    def spell(at: np.ndarray) -> list[bytes]:
        return [block.buf[s:e].tobytes() for s, e in zip(block.starts[at], block.ends[at], strict=True)]

    for lo in range(0, len(groups), 256):
        yield _sent([(int(bucket[i[0]]), *((int(key[i[0]]), int(salts[i[0]])) if heavy[i[0]] else (None, None)), pack(numbers, spell, begin[i], size[i], ids[i], hashes[i], start[i])) for i in groups[lo : lo + 256] if len(i)])


def settle_bucket(blobs: list[bytes], k: int, keys: list[tuple[int | None, int | None]], buckets: int) -> tuple[tuple[list, list, list], list[tuple[int, bytes]]]:
    """The windows of a bucket that aren't the first of their kind, by document, and those that are of a heavy minimiser (key, salts), packed again for its last buckets."""
    vocabulary: dict[bytes, int] = {}
    parts, heavy = [], []
    for blob, (key, salts) in zip(blobs, keys, strict=True):
        ids, hashes, start, size, code, words = unpack(blob)
        number = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words))
        parts.append((ids, hashes, start, size, number[code].astype(np.int32)))
        heavy.append((np.full(len(ids), key or 0), np.full(len(ids), salts or 0)))
    ids, hashes, start, size, words = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, salts = (np.concatenate(x) for x in zip(*heavy, strict=True))
    size = size.astype(np.int64)
    base = np.cumsum(size) - size
    n = size - k + 1
    piece = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    begins = start[piece] + nth
    rank = np.unique(ids, return_inverse=True)[1]
    repeat = not_first(words, base[piece] + nth, rank[piece].astype(np.int64) << 32 | begins, k)
    again = []
    go = np.flatnonzero(~repeat & (salts[piece] > 0))
    if len(go):
        known = list(vocabulary)
        sizes = np.array([len(w) for w in known])
        ends = np.cumsum(sizes)
        word = Hasher(np.frombuffer(b"".join(known), np.uint8)).spans(ends - sizes, ends)[words]
        at, of = (base[piece] + nth)[go], piece[go]
        deal = window_hashes(word, k)[at] % (LAST * salts[of]).astype(U64)  # equal windows have equal words
        bucket = (mix(key[of].view(U64) + (deal + U64(1)) * _UP) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for i in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            blob = pack(words, lambda spots: [known[x] for x in words[spots]], at[i], np.full(len(i), k), ids[of[i]], hashes[of[i]], begins[go[i]])
            again.append((int(bucket[i[0]]), blob))
    gone = piece[repeat]
    return _report(ids[gone], hashes[gone], begins[repeat], k), again


def few(rows: DataFrame) -> DataFrame | None:
    """The document keys of a stored table, to be broadcast; None if they are too many for that."""
    return F.broadcast(rows.select("id", "row_hash")) if rows.count() <= BROADCAST_ROWS else None


def _with_times(kmers: DataFrame) -> DataFrame:
    """kmers with the rows of their key. A block sends a window once, so a key comes from each block a few times at most.

    The few keys that would still fill a task (found by a sample, so that the others are shuffled once) are counted by an
    aggregate and joined back; whether a key is among them changes no count."""
    sample = kmers.filter(F.pmod(F.xxhash64("id", "row_hash"), F.lit(SAMPLED)) == 0)
    common = sample.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > max(64, sample.count() // HOT_KEYS)).select("key").collect()  # fewer than HOT_KEYS
    counted = lambda df: df.withColumn("times", F.count("*").over(Window.partitionBy("key")))
    if not common:
        return counted(kmers)
    keys = F.broadcast(kmers.sparkSession.createDataFrame(common, "key long"))
    own = kmers.join(keys, "key", "left_semi")
    return counted(kmers.join(keys, "key", "left_anti")).union(own.join(F.broadcast(own.groupBy("key").agg(F.count("*").alias("times"))), "key"))


def repeated_ranges(docs: DataFrame, k: int = K, m: int = M, heavy: int = HEAVY) -> DataFrame:
    """(id, row_hash, ranges): word ranges to remove, as little-endian pairs of 32-bit numbers. docs: id, row_hash, text."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, limit=BLOCK):
            yield from scan_block(part, block, k, m)

    scanned = stored(docs.select("id", "row_hash", "text").mapInArrow(scan, SCANNED))
    kmers = scanned.filter("key IS NOT NULL").select("key", "id", "row_hash", "start", "windows")
    again = _with_times(kmers).filter("times > 1")
    one = F.struct("key", "start", "windows", F.ceil(F.col("times") / heavy).cast("int").alias("salts"))
    wanted = stored(again.groupBy("id", "row_hash").agg(F.collect_list(one).alias("kmers"), F.sum(F.col("windows") + k - 1).alias("words"), F.max(F.col("times") > heavy).alias("heavy")))
    words, any_heavy = wanted.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("heavy"), F.lit(False))).first()
    buckets = max(BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), words // BUCKET_WORDS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, limit=BLOCK):
            yield from pack_block(part, block, k, buckets)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, tuple[int | None, int | None]]] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            (ids, hashes, spans), later = settle_bucket([x for x, _ in held], k, [x for _, x in held], buckets)
            held.clear()
            n, rest = len(ids), len(later)
            none = [None] * (n + rest)
            columns = [ids + [None] * rest, hashes + [None] * rest, spans + [None] * rest, [None] * n + [x for x, _ in later], none, none, [None] * n + [x for _, x in later]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            if n + rest:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["id", "row_hash", "ranges", "bucket", "key", "salts", "blob"])

        for batch in batches:
            for bucket, key, salts, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from close()
                    now = bucket
                held.append((blob, (key, salts)))
        yield from close()

    def settled(strings: DataFrame) -> DataFrame:
        return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settle, f"id long, row_hash long, ranges binary, {SENT}")

    keys = few(wanted)
    # only texts that hold such a window are shuffled
    source = docs if keys is None else docs.join(keys, ["id", "row_hash"], "left_semi")
    found = settled(source.join(wanted.drop("words", "heavy"), ["id", "row_hash"]).select("id", "row_hash", "text", "kmers").mapInArrow(send, SENT))
    if any_heavy:  # what the first buckets of a heavy minimiser leave meets in its last ones
        found = stored(found)
        found = found.filter("bucket IS NULL").union(settled(found.filter("bucket IS NOT NULL").select("bucket", "key", "salts", "blob")))
    return found.select("id", "row_hash", "ranges").union(scanned.filter("key IS NULL").select("id", "row_hash", "ranges"))


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """id, n_words, n_removed and kept_text (the words left, joined by one space; binary UTF-8) of every document."""
    keyed = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    keyed = keyed.select("doc", F.coalesce("doc", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("row_hash"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(repeated_ranges(keyed, k, m, heavy).groupBy("id", "row_hash").agg(F.collect_list("ranges").alias("ranges")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, limit=BLOCK):
            removed, kept = [], []
            spans = part.column(2).to_pylist()
            for i, own in enumerate(spans):
                words = block.buf[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
                keep = np.ones(len(words), bool)
                for a, b in (np.frombuffer(b"".join(own), np.int32).reshape(-1, 2) if own else ()):
                    keep[a:b] = False
                removed.append(int((~keep).sum()))
                kept.append(b" ".join(w for w, good in zip(words, keep.tolist(), strict=True) if good) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(block.n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "n_words", "n_removed", "kept_text"])

    keys = few(found)
    if keys is None:
        joined = keyed.join(found, ["id", "row_hash"], "left").select("doc", "text", "ranges")
    else:  # a text that loses nothing stays where it is
        changed = keyed.join(keys, ["id", "row_hash"], "left_semi").join(found, ["id", "row_hash"]).select("doc", "text", "ranges")
        joined = changed.union(keyed.join(keys, ["id", "row_hash"], "left_anti").select("doc", "text", F.lit(None).cast("array<binary>")))
    return joined.mapInArrow(finish, "doc long, n_words long, n_removed long, kept_text binary").withColumnRenamed("doc", id_col)


