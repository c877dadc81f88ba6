"""Retrieval: exact inner products, inverted lists, quantised codes, and words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from gridseek.functions.vectors import dot
from gridseek.operators.ranking import ranked

#: Questions that are broadcast to the passages at most; beyond, questions and passages meet in cells of these many.
QUESTION_BLOCK, PASSAGE_BLOCK = 4096, 16_384
#: Probes (a question in a list) that are broadcast to the lists at most; beyond, they meet the lists' rows in cells.
PROBES = 200_000
#: Products of questions and vectors that a task holds at once, and questions that it takes together.
PRODUCTS, TOGETHER = 1 << 20, 256
#: Words that are broadcast to the passages; more are matched by a join.
TERMS = 500_000


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _nearest(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores, ties to the least id."""
    top = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
    row, col = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]


def _hits(qids: pa.Array, q: np.ndarray, part: pa.RecordBatch | pa.Table, k: int) -> list[pa.Array]:
    """qid, p_id, table_id and score of the k nearest of some passages (p_id, table_id, embedding) for each question; the products are taken PRODUCTS at a time."""
    x, ids = _numbers(part.column(2)).T, part.column(0).to_numpy()
    step, found = max(1, PRODUCTS // max(1, len(ids))), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(q), step):
        scores = np.round(q[at : at + step] @ x, 6) + 0.0
        row, col = _nearest(scores, ids, k)
        found.append((row + at, col, scores[row, col]))
    row, col, score = map(np.concatenate, zip(*found, strict=True))
    return [qids.take(pa.array(row)), part.column(0).take(pa.array(col)), part.column(1).take(pa.array(col)), pa.array(score)]


_HIT = ["qid", "p_id", "table_id", "score"]


def _first_ranked(passages: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """(qid, p_id, table_id, score): of each batch of passages a question's k nearest, so that little is shuffled."""
    question = passages.sparkSession.sparkContext.broadcast((asked.column("qid").combine_chunks(), _numbers(asked.column("q").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = question.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(_hits(qids, q, b, k), names=_HIT)

    qid = {"int64": "long", "int32": "int", "string": "string"}[str(asked.schema.field("qid").type)]
    return passages.mapInArrow(run, _hit_schema(passages, qid))


def _hit_schema(passages: DataFrame, qid: str) -> str:
    kind = {f.name: f.dataType.simpleString() for f in passages.schema}
    return f"qid {qid}, p_id {kind['p_id']}, table_id {kind['table_id']}, score double"


def _in_cells(passages: DataFrame, asked: DataFrame, n_passages: int, n_questions: int, k: int) -> DataFrame:
    """As _first_ranked where the questions are too many to travel: a grid of cells, each of a block of passages and one of questions."""
    across, down = -(-n_passages // PASSAGE_BLOCK), -(-n_questions // QUESTION_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = passages.withColumn("a", F.pmod(F.xxhash64("p_id"), F.lit(across)).cast("int")).withColumn("d", every(down))
    right = asked.withColumn("d", F.pmod(F.xxhash64("qid"), F.lit(down)).cast("int")).withColumn("a", every(across))

    def run(rows: pa.Table, questions: pa.Table) -> pa.Table:
        qids = questions.column("qid").combine_chunks()
        part = rows.select(["p_id", "table_id", "embedding"]).combine_chunks()
        if not rows.num_rows or not questions.num_rows:
            return pa.table([qids.slice(0, 0), part.column(0).slice(0, 0), part.column(1).slice(0, 0), pa.array([], pa.float64())], names=_HIT)
        q = _numbers(questions.column("q").combine_chunks())
        return pa.table(_hits(qids, q, part, k), names=_HIT)

    return left.groupBy("a", "d").cogroup(right.groupBy("a", "d")).applyInArrow(run, _hit_schema(passages, asked.schema["qid"].dataType.simpleString()))


def flat_knn(passages: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, rank, p_id, table_id, score): exact. passages: p_id, table_id, embedding; questions: qid, q.

    Every question meets every passage by definition. Up to QUESTION_BLOCK questions travel to the passages; more meet
    them in a grid of cells, without passing through the driver. Either way a matrix product, of which the k nearest go on."""
    asked = questions.select("qid", F.col("q").cast("array<double>").alias("q"))
    slim = passages.select("p_id", "table_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = asked.count()
    if not n:
        found = slim.select(F.lit(None).cast(asked.schema["qid"].dataType).alias("qid"), "p_id", "table_id", F.lit(0.0).alias("score")).limit(0)
    elif n <= QUESTION_BLOCK:
        found = _first_ranked(slim, asked.toArrow(), k)
    else:
        found = _in_cells(slim, asked, max(1, slim.count()), n, k)
    return ranked(found, top=k)


def index_options(n: int) -> dict:
    """Lists, codes and training rows for a collection of n vectors."""
    if n < 1_000_000:
        lists, codes, per_list = max(1, n // 50), None, 50
    elif n < 50_000_000:
        lists, codes, per_list = 4096, 384, 1024
    else:
        lists, codes, per_list = 12288, 384, 512
    return {"lists": lists, "codes": codes, "train": min(n, per_list * lists)}


def coarse_centroids(passages: DataFrame, lists: int, train: int, seed: int = 1) -> DataFrame:
    """(list, centroid) by k-means on a sample of about `train` rows, by a hash of the id."""
    n = passages.count()
    if lists < 2:  # one list: any centroid does
        return hashed_centroids(passages, 1)
    part = F.pmod(F.xxhash64("p_id"), F.lit(1 << 30)) < int(min(1.0, train / max(n, 1)) * (1 << 30))
    sample = passages.filter(part).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10, initSteps=1).fit(sample)
    return passages.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centroid array<double>")


def hashed_centroids(passages: DataFrame, lists: int) -> DataFrame:
    """(list, centroid): the vectors of least md5, the same in any engine."""
    key = F.md5(F.col("p_id").cast("string"))
    top = passages.orderBy(key, "p_id").limit(lists)
    return top.select((F.row_number().over(Window.orderBy(key, "p_id")) - 1).cast("int").alias("list"), F.col("embedding").cast("array<double>").alias("centroid"))


def assign_lists(passages: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each passage with the list of its nearest centroid; the centroids (index_options bounds them) are broadcast and a batch meets them in one matrix product."""
    rows = centroids.orderBy("list").collect()
    known = passages.sparkSession.sparkContext.broadcast((np.array([r["list"] for r in rows], np.int32), np.array([r["centroid"] for r in rows], np.float64)))
    at = passages.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, c = known.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                x = _numbers(part.column(at))
                d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
                near = lists[np.round(d, 9).argmin(1)]  # ties go to the first list
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near)], names=[*part.schema.names, "list"])

    return passages.mapInArrow(run, StructType([*passages.schema.fields, StructField("list", IntegerType())]))


def write_lists(assigned: DataFrame, path: str) -> None:
    """The index: a folder for each list, so that a probe prunes to its lists. Large lists get several files."""
    spread = F.pmod(F.xxhash64("p_id"), F.lit(16))
    assigned.repartition("list", spread).sortWithinPartitions("list", "p_id").write.mode("overwrite").partitionBy("list").parquet(path)


def probes_of(questions: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(list, bias, qid, q): the nprobe lists of largest inner product (bias) with each question; a matrix product a batch."""
    rows = centroids.orderBy("list").collect()  # index_options bounds them
    known = questions.sparkSession.sparkContext.broadcast((np.array([r["list"] for r in rows], np.int32), np.array([r["centroid"] for r in rows], np.float64)))
    asked = questions.select("qid", F.col("q").cast("array<double>").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, c = known.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                bias = np.round(_numbers(part.column(1)) @ c.T, 9)
                row, col = _nearest(bias, lists, nprobe)
                yield pa.RecordBatch.from_arrays([pa.array(lists[col]), pa.array(bias[row, col]), *(x.take(pa.array(row)) for x in part.columns)], names=["list", "bias", "qid", "q"])

    return asked.mapInArrow(run, f"list int, bias double, qid {asked.schema['qid'].dataType.simpleString()}, q array<double>")


def _probed(lists: DataFrame, probes: DataFrame, ready: Callable, score: Callable, keep: int | None) -> DataFrame:
    """(qid, list, p_id, table_id, score): of the probed lists' rows each question's `keep` best in a batch, or with None those that reach the probe's `least`.

    lists: list, p_id, table_id, x; score is of (bias, q, ready(x)). Only the probed lists are read: their numbers become a filter of the scan. Up to PROBES
    probes travel to the lists, whose rows stay where they are; a batch's rows are put in the order of their lists, and
    what a question finds in several of them is cut to `keep` before it is shuffled. More probes meet the rows in cells of bounded size."""
    wanted = [r["list"] for r in probes.select("list").distinct().collect()]  # a row a list
    read = lists.filter(F.col("list").isin(wanted)).select("list", "p_id", "table_id", "x")
    kind = {f.name: f.dataType.simpleString() for f in read.schema}
    schema = f"qid {probes.schema['qid'].dataType.simpleString()}, list int, p_id {kind['p_id']}, table_id {kind['table_id']}, score double"
    names = ["qid", "list", "p_id", "table_id", "score"]
    probes = probes if keep is None else probes.withColumn("least", F.lit(0.0))
    none = np.zeros(0, np.int64)

    def best(bias: np.ndarray, q: np.ndarray, least: np.ndarray, x, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        step, found = max(1, min(TOGETHER, PRODUCTS // max(1, len(ids)))), [(none, none, np.zeros(0))]
        for at in range(0, len(q), step):
            values = score(bias[at : at + step], q[at : at + step], x)
            row, col = np.nonzero(values >= least[at : at + step, None]) if keep is None else _nearest(values, ids, keep)
            found.append((row + at, col, values[row, col]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    n = probes.count()
    if n <= PROBES:
        t = probes.select("list", "bias", "qid", "q", "least").toArrow()
        coded = t.column("qid").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        asks = coded.indices.to_numpy().astype(np.int64)
        q = _numbers(t.column("q"))[np.unique(asks, return_index=True)[1]] if n else None
        number = t.column("list").to_numpy()
        order = np.lexsort((number, asks // TOGETHER))
        of = np.stack([asks[order] // TOGETHER, number[order]], 1)
        cuts = np.append(np.flatnonzero(np.append(True, (of[1:] != of[:-1]).any(1))), n).tolist() if n else [0]
        spans: dict[int, list] = {}  # for each block of questions the places of its probes by list
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            spans.setdefault(int(of[lo, 0]), []).append((int(of[lo, 1]), lo, hi))
        held = lists.sparkSession.sparkContext.broadcast((list(spans.values()), asks[order], t.column("bias").to_numpy()[order], t.column("least").to_numpy()[order], coded.dictionary, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spans, asks, bias, least, qids, q = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                b = b.take(pa.array(np.argsort(b.column("list").to_numpy(), kind="stable")))
                number, ids = b.column("list").to_numpy(), b.column("p_id").to_numpy()
                cuts = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number)).tolist()
                own = {int(number[lo]): (lo, ready(b.column("x").slice(lo, hi - lo)), ids[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)}
                for block in spans:
                    found = [(none, none, np.zeros(0))]
                    for of, lo, hi in block:
                        if of in own:
                            first, x, some = own[of]
                            row, col, value = best(bias[lo:hi], q[asks[lo:hi]], least[lo:hi], x, some)
                            found.append((asks[lo:hi][row], col + first, value))
                    row, col, value = map(np.concatenate, zip(*found, strict=True))
                    if keep is not None:
                        order = np.lexsort((ids[col], -value, row))
                        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < keep]
                        row, col, value = row[order], col[order], value[order]
                    at = pa.array(col)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), pa.array(number[col]), b.column("p_id").take(at), b.column("table_id").take(at), pa.array(value)], names=names)

        return read.mapInArrow(run, schema)

    asks = probes.groupBy("list").agg(F.count("*").alias("asks"))
    sizes = read.groupBy("list").agg(F.count("*").alias("n")).join(asks, "list").select("list", F.ceil(F.col("n") / PASSAGE_BLOCK).alias("parts"), F.ceil(F.col("asks") / QUESTION_BLOCK).alias("copies"))
    sizes = F.broadcast(sizes)  # a row a list
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = read.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("p_id"), "parts")).withColumn("copy", every("copies"))
    right = probes.join(sizes, "list").withColumn("copy", F.pmod(F.xxhash64("qid"), "copies")).withColumn("part", every("parts"))

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        qids = asked.column("qid").combine_chunks()
        part = rows.select(["p_id", "table_id", "x"]).combine_chunks()
        if not rows.num_rows or not asked.num_rows:
            return pa.table([qids.slice(0, 0), pa.array([], pa.int32()), part.column(0).slice(0, 0), part.column(1).slice(0, 0), pa.array([], pa.float64())], names=names)
        part = part.to_batches()[0]
        row, col, value = best(asked.column("bias").to_numpy(), _numbers(asked.column("q")), asked.column("least").to_numpy(), ready(part.column("x")), part.column("p_id").to_numpy())
        at = pa.array(col)
        return pa.table([qids.take(pa.array(row)), pa.array(np.full(len(row), asked.column("list")[0].as_py(), np.int32)), part.column("p_id").take(at), part.column("table_id").take(at), pa.array(value)], names=names)

    keys = ["list", "part", "copy"]
    return left.select(*keys, "p_id", "table_id", "x").groupBy(*keys).cogroup(right.select(*keys, "bias", "qid", "q", "least").groupBy(*keys)).applyInArrow(cell, schema)


def ivf_search(assigned: DataFrame, centroids: DataFrame, questions: DataFrame, k: int, nprobe: int) -> DataFrame:
    """As flat_knn over the nprobe lists of largest inner product with the question. assigned: p_id, table_id, embedding, list."""
    lists = assigned.select("list", "p_id", "table_id", F.col("embedding").cast("array<double>").alias("x"))
    exact = lambda bias, q, x: np.round(q @ x.T, 6) + 0.0
    return ranked(_probed(lists, probes_of(questions, centroids, nprobe), _numbers, exact, k).drop("list"), top=k)


def _centers(x: np.ndarray, codes: int, rounds: int, seed: int) -> np.ndarray:
    """k-means of a bounded sample, at most `codes` centers."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:codes]].copy()
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1)[None] - 2 * x[at : at + 4096] @ c.T).argmin(1) for at in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def residual_codes(assigned: DataFrame, centroids: DataFrame, parts: int, codes: int = 256, train: int = 65_536, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """What the lists' centroids leave of the vectors, cut into `parts` slices and coded by k-means of each slice's own: the rows with codes (a byte a slice) and `off` (how far the codes are from the vector), and (part, code, center).

    The codebooks are fitted on a sample of about `train` rows, by a hash of the id, a slice a task; every row is coded."""
    n, dim = assigned.count(), len(centroids.first()["centroid"])
    if dim % parts or codes > 256:
        raise ValueError(f"{dim} components in {parts} slices of at most 256 codes")
    width = dim // parts
    left = assigned.join(F.broadcast(centroids), "list").withColumn("rest", F.zip_with(F.col("embedding").cast("array<double>"), "centroid", lambda x, c: x - c)).drop("centroid")
    chosen = F.pmod(F.xxhash64("p_id"), F.lit(1 << 30)) < int(min(1.0, train / max(n, 1)) * (1 << 30))
    slices = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.slice("rest", j * width + 1, F.lit(width)))
    sample = left.filter(chosen).select(F.posexplode(slices).alias("part", "x"))

    def fit(t: pa.Table) -> pa.Table:
        part = int(t.column("part")[0].as_py())
        c = _centers(_numbers(t.column("x")), codes, 8, seed + part)
        return pa.table([pa.array(np.full(len(c), part, np.int32)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(c.tolist(), pa.list_(pa.float64()))], names=["part", "code", "center"])

    rows = sample.groupBy("part").applyInArrow(fit, "part int, code int, center array<double>").collect()  # parts * codes
    table = np.full((parts, codes, width), np.inf)  # slices with fewer centers never choose the others
    for r in rows:
        table[r["part"], r["code"]] = r["center"]
    known = assigned.sparkSession.sparkContext.broadcast(table)
    at = left.columns.index("rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded, off = [], []
            for lo in range(0, b.num_rows, 512):
                x = _numbers(b.column(at).slice(lo, 512))
                apart = [((x[:, None, j * width : (j + 1) * width] - c[None]) ** 2).sum(2) for j, c in enumerate(known.value)]
                near = [d.argmin(1) for d in apart]
                off.append(np.sqrt(sum(d.min(1) for d in apart)))
                coded += [r.tobytes() for r in np.stack(near, 1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(coded, pa.binary()), pa.array(np.concatenate([*off, np.zeros(0)]))], names=[*(c for c in b.schema.names if c != "rest"), "codes", "off"])

    schema = StructType([*(f for f in left.schema.fields if f.name != "rest"), StructField("codes", BinaryType()), StructField("off", DoubleType())])
    books = assigned.sparkSession.createDataFrame([(r["part"], r["code"], r["center"]) for r in rows], "part int, code int, center array<double>")
    return left.mapInArrow(run, schema), books


def coded_search(lists: DataFrame, centroids: DataFrame, books: DataFrame, questions: DataFrame, k: int, nprobe: int, refine: int = 8, exact: bool = False) -> DataFrame:
    """As ivf_search by the codes of the probed lists; the refine * k best by code are measured again by their vectors.

    With `exact` the k-th of these is only a bound: a product by code errs by at most the question's length times the row's `off`,
    so the codes are read again and every row that could still reach the bound is measured. That is ivf_search's result.

    lists: list, p_id, table_id, codes, embedding. A question's products with all centers are one table of
    parts * codes numbers; a row's value is the product of its list's centroid and a sum of look-ups. The codes' column is read of the
    probed lists alone, the vectors' of those lists alone that hold a candidate."""
    rows = books.collect()  # parts * codes
    parts, codes = 1 + max(r["part"] for r in rows), 1 + max(r["code"] for r in rows)
    table = np.zeros((parts, codes, len(rows[0]["center"])))
    for r in rows:
        table[r["part"], r["code"]] = r["center"]
    known = lists.sparkSession.sparkContext.broadcast(table)

    def opened(x: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        codes, off = x.flatten()
        return np.frombuffer(b"".join(v.as_py() for v in codes), np.uint8).reshape(len(x), -1), off.to_numpy(zero_copy_only=False)

    def by_code(bias: np.ndarray, q: np.ndarray, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        code = x[0]
        look = np.einsum("npw,pcw->npc", q.reshape(len(q), parts, -1), known.value)
        out = np.repeat(bias[:, None], len(code), axis=1)
        for j in range(parts):
            out += look[:, j][:, code[:, j]]
        return out

    def at_most(bias: np.ndarray, q: np.ndarray, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return by_code(bias, q, x) + np.sqrt((q * q).sum(1))[:, None] * x[1][None]

    def measured(near: DataFrame) -> DataFrame:
        near = near.select("qid", "list", "p_id").persist()
        held = [r["list"] for r in near.select("list").distinct().collect()]  # a row a list
        few = near.count() <= PROBES
        vectors = lists.filter(F.col("list").isin(held)).select("list", "p_id", "table_id", "embedding")
        pairs = vectors.join(F.broadcast(near) if few else near, ["list", "p_id"]).join(questions.select("qid", "q"), "qid")
        return ranked(pairs.select("qid", "p_id", "table_id", (F.round(dot(F.col("q"), F.col("embedding")), 6) + 0.0).alias("score")), top=k)

    off = F.col("off") if exact else F.lit(0.0)
    slim = lists.select("list", "p_id", "table_id", F.struct("codes", off.alias("off")).alias("x"))
    probes = probes_of(questions, centroids, nprobe)
    found = measured(ranked(_probed(slim, probes, opened, by_code, refine * k), top=refine * k))
    if not exact:
        return found
    least = found.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score") - 2e-6).alias("least"))  # scores have six digits
    bounded = probes.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return measured(_probed(slim, bounded, opened, at_most, None))


def _bare(text: Column) -> Column:
    """Lower case with spaces for punctuation."""
    return F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " ")


def terms(text: Column) -> Column:
    return F.filter(F.split(_bare(text), r"[ \n]+"), lambda t: t != "")


def _counted_terms(passages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(p_id, table_id, len, term, tf): a row for each wanted term of a passage, and one of a null term for the passage itself."""
    if wanted.count() > TERMS:
        each = passages.select("p_id", "table_id", terms(F.col("text")).alias("words")).select("p_id", "table_id", F.size("words").alias("len"), F.explode("words").alias("term"))
        whole = passages.select("p_id", "table_id", F.size(terms(F.col("text"))).alias("len"), F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf"))
        return each.join(wanted, "term", "left_semi").groupBy("p_id", "table_id", "len", "term").agg(F.count("*").alias("tf")).union(whole)
    known = passages.sparkSession.sparkContext.broadcast({r["term"] for r in wanted.collect()})
    slim = passages.select("p_id", "table_id", _bare(F.col("text")).alias("text"))
    kind = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lens, found, tf = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                words = [w for w in (text or "").replace("\n", " ").split(" ") if w]
                own = Counter(w for w in words if w in known.value)
                at += [i] * (1 + len(own))
                lens += [len(words)] * (1 + len(own))
                found += [None, *own]
                tf += [1, *own.values()]
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(lens, pa.int32()), pa.array(found, pa.string()), pa.array(tf, pa.int64())], names=["p_id", "table_id", "len", "term", "tf"])

    return slim.mapInArrow(run, f"{', '.join(kind)}, len int, term string, tf long")


def rounded(scores: np.ndarray) -> np.ndarray:
    """To six places, as SQL does."""
    return np.floor(scores * 1e6 + 0.5) / 1e6


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class Asked:
    """Questions by their words: word i is asked for in the pairs ptr[i] to ptr[i + 1], a pair being a question, and a row of `order` in the table (qid, term) given."""

    def __init__(self, pairs: pa.Table):
        qid, term = (_whole(pairs.column(n)).dictionary_encode(null_encoding="encode") for n in ("qid", "term"))
        self.qids, self.words = qid.dictionary, term.dictionary.to_pylist()
        word = term.indices.to_numpy()
        self.order = np.argsort(word, kind="stable")
        self.ptr = np.searchsorted(word[self.order], np.arange(len(self.words) + 1))
        self.q = qid.indices.to_numpy()[self.order].astype(np.int64)

    def met(self, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which, pair): each of some rows with each of its pairs, which are those from its begin to its end, some PRODUCTS at a time."""
        n = end - begin
        upto, lo = np.cumsum(n), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PRODUCTS, side="right")))
            own = n[lo:hi]
            yield np.repeat(np.arange(lo, hi), own), np.repeat(begin[lo:hi] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            lo = hi


class Best:
    """Each question's k best passages of those added so far, ties to the smaller id; a question's bar is the k-th score, once it has k."""

    def __init__(self, asked: Asked, k: int, columns: list[str]):
        self.asked, self.k, self.columns = asked, k, columns
        self.bar, self.parts, self.held, self.limit = np.zeros(len(asked.qids)), [], 0, PRODUCTS

    def add(self, q: np.ndarray, score: np.ndarray, at: np.ndarray, *about: pa.Array) -> Iterator[pa.RecordBatch]:
        """The passages' columns, ids first, are taken at `at`. What is too much to hold comes out."""
        if len(q):
            self.parts.append((q, score, *(a.take(pa.array(at)) for a in about)))
            self.held += len(q)
        if self.held > self.limit:
            self._settle()
            if self.held > PRODUCTS:
                yield from self.out()
            self.limit = self.held + PRODUCTS

    def _settle(self) -> None:
        q, score, *about = (np.concatenate(x) if isinstance(x[0], np.ndarray) else pa.concat_arrays(x) for x in zip(*self.parts, strict=True))
        place = np.empty(len(q), np.int64)
        place[pc.array_sort_indices(about[0], null_placement="at_start").to_numpy()] = np.arange(len(q))
        order = np.lexsort((place, -score, q))
        nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        last = order[nth == self.k - 1]
        self.bar[q[last]] = np.maximum(self.bar[q[last]], score[last])
        keep = order[nth < self.k]
        self.parts, self.held = [(q[keep], score[keep], *(a.take(pa.array(keep)) for a in about))], len(keep)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._settle()
            q, score, *about = self.parts[0]
            self.parts, self.held = [], 0
            yield pa.RecordBatch.from_arrays([self.asked.qids.take(pa.array(q)), *about, pa.array(score)], names=["qid", *self.columns, "score"])


def _scored_in_place(passages: DataFrame, questions: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(qid, p_id, table_id, score): each task's k best passages for each question. Texts are read twice, for the words' frequencies and to score them."""
    spark = passages.sparkSession
    asked = spark.sparkContext.broadcast(Asked(questions.toArrow()))
    slim = passages.select("p_id", "table_id", _bare(F.col("text")).alias("text"))

    def counted(index: dict[str, int], batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some passages, their lengths, and (passage, word, how often)."""
        step = max(1, min(256, PRODUCTS // max(1, len(asked.value.qids))))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            at, word, tf, lens = [], [], [], []
            for i, whole in enumerate(part.column(text).to_pylist()):
                words = (whole or "").replace("\n", " ").split(" ")
                own = Counter(map(index.get, words))
                own.pop(None, None)
                at += [i] * len(own)
                word += own.keys()
                tf += own.values()
                lens.append(len(words) - words.count(""))
            yield part, np.array(lens, np.int64), np.array(at, np.int64), np.array(word, np.int64), np.array(tf, np.int64)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(asked.value.words)}
        df, n, total = np.zeros(len(asked.value.words), np.int64), 0, 0
        for whole in batches:
            for part, lens, _, word, _ in counted(index, whole, 0):
                df += np.bincount(word, minlength=len(df))
                n, total = n + part.num_rows, total + int(lens.sum())
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n)), pa.array(np.append(0 * hit, total))], names=["word", "df", "words"])

    rows = slim.select("text").mapInArrow(frequencies, "word long, df long, words long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).toArrow()  # a row for each word asked for
    word, df, total = (_whole(rows.column(c)).to_numpy() for c in ("word", "df", "words"))
    n, length = int(df[word < 0].sum()), int(total.sum())
    per_word = np.zeros(len(asked.value.words))
    per_word[word[word >= 0]] = np.log(1 + (n - df[word >= 0] + 0.5) / (df[word >= 0] + 0.5))
    idf, mean = spark.sparkContext.broadcast(per_word), length / max(1, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(asked.value.qids):
            return
        index = {w: i for i, w in enumerate(asked.value.words)}
        best, m = Best(asked.value, k, ["p_id", "table_id"]), len(asked.value.qids)
        for whole in batches:
            for part, lens, at, word, tf in counted(index, whole, 2):
                gives = idf.value[word] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[at] / (mean or 1)))
                sums = np.zeros(part.num_rows * m)
                for which, pair in asked.value.met(asked.value.ptr[word], asked.value.ptr[word + 1]):
                    sums += np.bincount(at[which] * m + asked.value.q[pair], gives[which], len(sums))
                score = rounded(sums)
                cell = np.flatnonzero((sums.reshape(-1, m) > 0) & (score.reshape(-1, m) >= best.bar))
                yield from best.add(cell % m, score[cell], cell // m, part.column(0), part.column(1))
        yield from best.out()

    return slim.mapInArrow(run, _hit_schema(passages, questions.schema["qid"].dataType.simpleString()))


def bm25(passages: DataFrame, questions: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, rank, p_id, table_id, score) by words. passages: p_id (unique), table_id, text; questions: qid, text.

    Only the questions' terms count. Up to TERMS pairs of a question and a term travel to the passages, which are scored where
    they lie; of a task's passages, each question's k best go on, so no pair of question and passage is a row.
    More pairs than that are matched by joins."""
    asked = questions.select("qid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    if asked.count() <= TERMS:
        return ranked(_scored_in_place(passages, asked, k, k1, b), top=k)
    found = _counted_terms(passages, asked.select("term").distinct())
    stats = found.groupBy("term").agg(F.count("*").alias("df"), F.sum("len").alias("words"))  # a row for each term asked for
    total = stats.filter("term IS NULL").select(F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("mean"))
    idf = stats.filter("term IS NOT NULL").crossJoin(F.broadcast(total)).select("term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = found.join(asked.join(idf, "term"), "term").groupBy("qid", "p_id", "table_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return ranked(scored, top=k)


def nested_contexts(retr: DataFrame) -> DataFrame:
    """(qid, ctxs): the retrieved rows as an ordered array."""
    return retr.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "p_id", "score", "table_id"))).alias("ctxs"))


def hashing_encoder(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for a text encoder: signed counts of hashed words, of length 1."""
    slots = F.transform(terms(text), lambda t: F.struct(F.pmod(F.crc32(t.cast("binary")), F.lit(dim)).cast("int").alias("i"), F.when(F.pmod(F.crc32(F.reverse(t).cast("binary")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(F.filter(slots, lambda x: x["i"] == d), F.lit(0.0), lambda a, x: a + x["s"]))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(sums, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
