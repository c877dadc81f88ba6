"""Language-model scores, importance resampling and vector codes against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridseek.llm import ann, dictionary, importance, quantise, recurrent, scoring
from gridseek.llm.common import U64

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, id long, key string, part int"


def prose(rng, n):
    return " ".join(rng.choice("The of and A river, stone; wind over-under LIGHT dark É 7 far near".split()) + rng.choice(["", "s", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 12, 25, 60, 200])) for _ in range(60)]
    texts += [None, "", " \n\t", "x", texts[5], texts[5], "a b " * 90, "é" * 50, "ÀB c1 " * 8, "\x00\x01 z\x7f", "w" * 3000 + " tail", prose(rng, 4000)]
    out = [(i, t, 1, "k", 2) for i, t in enumerate(texts)]
    return [*out, out[4], (None, texts[3], 1, "k", 2), (7, "Another text of one id", 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


# ---- op 12


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resample(rows, wanted):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [(i, *features(t)) for i, t, *_ in rows]
    s = collections.Counter(bucket(f) for *_, fs in own for f in fs)
    t = collections.Counter(bucket(f) for x in wanted for f in features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((float(t[b] + 1) * float(n + 10_000)) / (float(s[b] + 1) * float(m + 10_000)))) for b in range(10_000)]
    out = []
    for i, words, fs in own:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[4], -1 if o[0] is None else o[0]))
    ranks = {}
    for place, o in enumerate(able[: 25 * len(able) // 100]):
        ranks.setdefault(o, []).append(place + 1)
    return collections.Counter((*(o[j] for j in (0, 2, 3, 4)), ranks[o].pop() if ranks.get(o) else None) for o in out)


@pytest.mark.parametrize("block", [1 << 23, 700])
def test_resampling(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(dictionary, "BLOCK_BYTES", block)  # long texts are cut too
    wanted = [prose(random.Random(8), 90), "river stone É 7", None, ""]
    target = spark.createDataFrame([(t, 3) for t in wanted], "text string, doc_id int")
    got = importance.resample(docs, target).collect()
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == plain_resample(rows, wanted)


def test_resampling_of_empty_tables(spark, docs, rows):
    none = docs.filter("false")
    assert importance.resample(none, docs).count() == 0
    got = importance.resample(docs, none).collect()
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == plain_resample(rows, [])


def test_strings_that_share_a_hash(monkeypatch):
    words = [b"ab", b"c", b"ab", b"xyz", b"c", b"", b"cd", b""]
    buf, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])

    class Blind:
        def __init__(self, buf):
            pass

        def spans(self, start, end):
            return (end - start).astype(U64) // U64(2)

    for kind in (dictionary.Hasher, Blind):
        monkeypatch.setattr(dictionary, "Hasher", kind)
        number, lead = dictionary.equal_strings(buf, size)
        assert [words[lead[n]] for n in number] == words and len(lead) == len(set(words)) == len(set(number.tolist()))


def test_numbers_and_pieces_survive():
    rng = np.random.default_rng(1)
    for top in (1, 200, 70_000, 1 << 40):
        a = rng.integers(0, top, 999)
        assert (dictionary.widened(dictionary.shrunk(a)) == a).all()
    texts = ["ab cd " * 40, "", "x" * 300, "é " * 90, "end"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    pieces = list(dictionary.cuts(buf, offsets, scoring._WORD, 64))
    assert b"".join(buf[lo:hi].tobytes() for *_, lo, hi in pieces) == buf.tobytes()
    assert [w for *_, lo, hi in pieces for w in buf[lo:hi].tobytes().decode().split()] == [w for t in texts for w in t.split()]


# ---- op 11


PLAIN_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_scores(rows):
    own = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, PLAIN_WORD.findall((t or "").translate(LOWER))) for i, t, *_ in rows]
    c = collections.Counter(w for _, held, ws in own if not held for w in ws)
    ends = sum(not held for _, held, _ in own)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    p = lambda x: math.log10((x + 0.5) / (n + 0.5 * (v + 1)))
    return collections.Counter((i, held, len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, round(sum(p(c[w]) for w in ws) + p(ends), 6)) for i, held, ws in own)


@pytest.mark.parametrize("piece", [1 << 21, 300])
def test_base_scores(docs, rows, monkeypatch, piece):
    monkeypatch.setattr(scoring, "PIECE_BYTES", piece)
    got = scoring.language_scores(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain_scores(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_scores_without_training_documents_and_of_an_empty_table(spark, docs):
    assert scoring.language_scores(docs.filter("false")).count() == 0
    held = [(i, "some words here", 1, "k", 2) for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = scoring.language_scores(spark.createDataFrame(held, SCHEMA)).collect()
    assert len(got) == len(held) and all(r.train_tokens == 0 and r.n_known == 0 for r in got)


def test_the_model_beats_the_counts_on_held_out_texts(spark, data):
    got = [r for r in scoring.language_scores(spark.read.parquet(f"{data}/../sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.98 * sum(r.base_score for r in got)
    assert sum(r.score > r.base_score for r in got) > 0.9 * len(got)


def test_probabilities_add_up_to_one():
    m = recurrent.Model(40, 5).start(np.arange(40, 0, -1))
    rng = np.random.default_rng(2)
    for name in m.p:
        m.p[name][...] += rng.normal(0, 0.5, m.p[name].shape)
    h = rng.normal(0, 0.5, (5, 3)).astype(np.float32)
    total = sum(np.exp(m.outputs(h, np.full(3, s))) for s in range(m.classes * recurrent.WIDTH))
    assert np.allclose(total, 1, atol=1e-5)


def test_gradients_are_slopes(monkeypatch):
    monkeypatch.setattr(recurrent, "F32", np.float64)
    rng = np.random.default_rng(1)
    m = recurrent.Model(40, 4)
    m.flat, m.seen = m.flat.astype(float), m.seen.astype(float)
    m._views()
    m.start(np.arange(40, 0, -1))
    x, y, end, h0 = rng.integers(0, 40, (5, 4)), rng.integers(0, 40, (5, 4)), 3, rng.normal(0, 0.3, (4, 4))
    x[2, 1] = end

    def total():
        h, logs = h0, 0.0
        m.p["x"] += m.p["b"]
        for t in range(len(x)):
            h = m.step(x[t], h, x[t] == end)[0]
            logs += m.outputs(h, y[t]).sum()
        m.p["x"] -= m.p["b"]
        return logs

    start = m.flat.copy()
    m._window(x, y, h0, end, 1e-30)
    slopes = np.sqrt((m.seen - 1e-4) * x.size)
    for i in rng.choice(m.size, 150, replace=False):
        m.flat[...] = start
        m.flat[i] += 1e-5
        up = total()
        m.flat[i] -= 2e-5
        assert abs(abs(up - total()) / 2e-5 - slopes[i]) < 1e-4 * (1 + slopes[i])


def test_scores_of_lanes_are_those_of_single_texts():
    rng = np.random.default_rng(4)
    m = recurrent.Model(30, 6).start(np.arange(30, 0, -1))
    for name in m.p:
        m.p[name][...] += rng.normal(0, 0.3, m.p[name].shape)
    lengths = rng.integers(1, 90, 40)
    stream = np.concatenate([np.append(rng.integers(1, 30, n - 1), 0) for n in lengths])
    many = recurrent.scores(m, stream, lengths, 0, 7, chunk=50)
    one = [recurrent.scores(m, s, np.array([len(s)]), 0, 1)[0] for s in np.split(stream, np.cumsum(lengths)[:-1])]
    assert np.allclose(many, one, rtol=1e-4)


# ---- op 13


def plain_codes(rows, parts, entries, rounds):
    """rows: (id, label, vector), all of one length."""
    x = np.floor(4096 * np.array([v for *_, v in rows])).astype(np.int64).reshape(len(rows), parts, -1)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], rows[i][2]))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    near = lambda: ((x[:, :, None] - books[None]) ** 2).sum(3)
    for _ in range(rounds):
        at = near().argmin(2)
        for p in range(parts):
            for e in range(books.shape[1]):
                if (at[:, p] == e).any():
                    books[p, e] = x[at[:, p] == e, p].sum(0) // (at[:, p] == e).sum()
    d = near()
    errors, total = d.min(2).sum(1), collections.Counter()
    for (_, label, _), e in zip(rows, errors, strict=True):
        total[label] += int(e)
    codes = ["".join(f"{c:02x}" for c in r) for r in d.argmin(2)]
    return collections.Counter((i, c, int(e), total[label]) for (i, label, _), c, e in zip(rows, codes, errors, strict=True)), books


@pytest.mark.parametrize(("n", "dim", "parts", "entries", "block"), [(700, 64, 8, 16, 8192), (900, 16, 8, 256, 100), (40, 8, 4, 3, 7), (5, 8, 8, 16, 8192)])
def test_vector_codes(spark, monkeypatch, n, dim, parts, entries, block):
    monkeypatch.setattr(quantise, "BLOCK", block)
    rng = np.random.default_rng(n)
    v = rng.normal(0, 0.3, (n, dim)).astype(np.float32).astype(float)
    v[1::9] = v[0]
    v[2::11] = 0
    good = [(None if i == 3 else int(i % (n - 2)), None if i % 7 == 0 else int(i % 5), v[i].tolist()) for i in range(n)]
    odd = [(900, 1, None), (901, 1, [None] * dim), (902, 1, [float("nan")] * dim), (903, 1, [float("inf")] * dim), (904, 1, [1.0] * (dim - 1)), (905, 1, []), (906, 2, [1.0] * 2 * dim), (907, 1, [2.0**14] * dim)]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + odd], "vec_id long, label int, embedding array<double>, id string, code int")
    p = quantise.Params(parts=parts, entries=entries)
    got, books = quantise.vector_codes(df.repartition(3), p)
    want, plain_books = plain_codes(good, parts, entries, 6)
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()) == want
    assert (books == plain_books).all()


def test_codes_of_an_empty_table(spark):
    got, _ = quantise.vector_codes(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error"]


def test_heaps_leave_most_parts_unread():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 3000, (16, 4, 8))
    x = (centres[rng.integers(0, 16, 4000)] + rng.normal(0, 200, (4000, 4, 8))).astype(np.int32)
    block, books = quantise.Block(x, 16), x[:16].transpose(1, 0, 2).astype(np.int64)
    bars = np.zeros((4, 16))
    for _ in range(8):
        block.assign(books, bars)
        assert all((k[1:] >= k[(np.arange(1, len(k)) - 1) // 2]).all() for heaps in block.heaps for k, _ in heaps)
        assert all(sorted(np.concatenate([w for _, w in heaps]).tolist()) == list(range(4000)) for heaps in block.heaps)
        assert (block.entry.T == ((x[:, :, None] - books[None]) ** 2).sum(3).argmin(2)).all()
        new = np.where(block.sums[..., -1:] > 0, block.sums[..., :-1] // np.maximum(block.sums[..., -1:], 1), books)
        drift = np.sqrt(((new - books) ** 2).sum(2))
        books, bars = new, bars + drift + drift.max(1, keepdims=True)
    assert block.rescanned < 0.6 * 8 * 4 * 4000


# ---- op 5: repeated rows


@pytest.mark.parametrize("copies", [10, 40, 60])
def test_neighbours_among_repeated_rows(spark, copies):
    rng = np.random.default_rng(copies)
    v = rng.normal(0, 1, (300, 8)).round(3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1, v[1].tolist())] * copies + [(2, (v[2] + j / 50).tolist()) for j in range(copies)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 300, 20):
        best = {}
        for i, x in rows:
            if i != q:
                best[i] = max(best.get(i, -math.inf), float(ann.dots(v[q], np.array([x]))[0]))
        want = [i for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]]
        found = sorted(got[q])
        assert [x[0] for x in found] == list(range(1, 21)) and all(best[i] == s for _, i, s in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * 15


def test_an_id_of_many_vectors_does_not_hide_the_others(spark):
    rng = np.random.default_rng(9)
    many = rng.normal(5, 0.1, (2000, 4))
    rows = [(1, x.tolist()) for x in many] + [(i, rng.normal(0, 1, 4).tolist()) for i in range(2, 40)] + [(0, [5.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ann.search(df, df.filter("vec_id = 0"), 20, ann.Params(list_rows=16)).count() == 20


def test_the_language_model_gains_over_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = scoring.language_scores(docs).filter("held_out").selectExpr("sum(score - base_score) / sum(n_tokens) AS gain").first()
    assert held["gain"] > 0.22  # 223 words and 8 units: 0.175
