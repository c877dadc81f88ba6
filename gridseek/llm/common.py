"""What several operators share: reading, checkpoints, word spans and 64-bit hashes in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels take at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
BATCH_ROWS = 1000
U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; set here only where a local session has none, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="gridseek-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: The tables that `stored` has written and `discard_stored` hasn't yet removed.
_STORED: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def kept_in(df: DataFrame, path: str, listed: bool = False) -> DataFrame:
    """Cut the lineage with a table in a folder, which the caller removes, or `discard_stored` if it is listed."""
    df.write.option("compression", "zstd").parquet(path)
    if listed:
        _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: columns compress there, so for what is long."""
    return kept_in(df, folder(df.sparkSession), listed=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark keeps it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard_stored(spark: SparkSession) -> None:
    """Delete what `stored` has written so far, for a driver that has written its results and reads none of it any more."""
    while _STORED:
        remove(spark, _STORED.pop())


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, unless the session says otherwise: with the default of 10,000 whole texts, buffers outside the heap and workers grow by many times the batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_ROWS)


def size_of_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, 0 for null, without making an array of the words."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE = seeds(256, 11)
_BASE = U64(0xD6E8FEB86659FD93)
_BASE_INV = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_POW = {"n": 0, "up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size + 1, base, U64)
            p[0] = 1
            _POW[key] = np.cumprod(p, dtype=U64)
        _POW["n"] = size
    return _POW["up"], _POW["down"]


class Hasher:
    """Hashes of spans of a byte buffer by prefix sums (a rolling hash), a stretch of STRETCH bytes at a time."""

    STRETCH = 1 << 20

    def __init__(self, buf: np.ndarray):
        self.buf = buf

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each span; it depends on the bytes alone. The starts ascend."""
        out = np.empty(len(start), U64)
        at = 0
        while at < len(start):
            low = int(start[at])
            to = max(at + 1, int(np.searchsorted(start, low + self.STRETCH)))
            high = int(end[at:to].max())
            up, down = _powers(high - low + 1)
            sums = np.zeros(high - low + 1, U64)
            np.cumsum(_BYTE[self.buf[low:high]] * up[: high - low], dtype=U64, out=sums[1:])
            a, b = start[at:to] - low, end[at:to] - low
            out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64))
            at = to
        return out


class Block:
    """Some texts as one byte buffer, with the spans of their words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self.n = buf, offsets, len(offsets) - 1
        white = (buf == 32) | ((buf >= 9) & (buf <= 13))
        before, after = np.ones(len(buf), bool), np.ones(len(buf), bool)  # at the edge of a text or of white space
        before[1:], after[:-1] = white[:-1], white[1:]
        edges = offsets[(offsets > 0) & (offsets < len(buf))]
        before[edges] = after[edges - 1] = True
        self.starts, self.ends = np.flatnonzero(before & ~white), np.flatnonzero(after & ~white) + 1
        self.word_lo = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.word_lo)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, for what becomes Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of at most `limit` bytes of text (one row at least), each with its Block."""
    for batch in batches:
        buf, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), Block(buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
