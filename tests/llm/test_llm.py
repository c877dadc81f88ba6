"""The operators of gridseek.llm against plain versions, with nulls, empty and repeated rows, ties and extra columns."""

import collections
import hashlib
import itertools
import json
import os
import random
import re
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridseek.llm import ann, encode, linededup, mixing, neardup, packing, preference, quality, sharding, substring, tokencount
from gridseek.llm import common, links, sql
from gridseek.llm.common import Block, blocks
from gridseek.llm.links import classes, components
from gridseek.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, id long, label string, n long"


def words(t):
    return WORD.findall(t or "")


def prose(rng, n):
    return " ".join(rng.choice("the of and a river stone wind over under light dark seven far near old new".split()) + rng.choice(["", "", "s", "er", "ing"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, shared passages, repeated lines, nulls, empty texts and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 20, 60, 150])) for _ in range(40)]
    shared = prose(rng, 60)
    texts = [*base, *base[:4], base[5].replace("river", "brook", 1), f"{base[6]}\n{shared}", f"{shared}\n{base[7]}", None, "", " \n\t ", "x", "a b c a b c " * 30, "line one is long enough to count\n" * 4, "é " * 70, base[8][: len(base[8]) // 2] + " word " + base[8][len(base[8]) // 2 :]]
    texts.append("\n".join(prose(rng, 12) for _ in range(400)))
    rows = [(i, t, None if i % 9 == 0 else f"s{i % 5}", 7, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[3], (None, base[9], "s1", 7, "x", 1), (2, "another text of the same id " * 5, "s2", 7, "x", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).persist()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def block_of(*texts):
    return next(blocks(iter([pa.record_batch({"text": pa.array(texts)})])))[1]


def test_words_of_a_block():
    texts = ["a bb  ccc", "", None, "xx", " y\n z", "é　q", "end "]
    b = block_of(*texts)
    assert [bytes(b.buf[s:e]).decode() for s, e in zip(b.starts, b.ends)] == [w for t in texts for w in words(t)]
    assert b.n_words.tolist() == [len(words(t)) for t in texts]
    assert isinstance(b, Block)


# ---- op 6


def plain_quality(t):
    w = words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(grams)
    cover = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs, corpus):
    got = quality.quality_report(docs).collect()
    want = collections.Counter((r[0], *plain_quality(r[1])) for r in corpus)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.quality_report(empty(spark)).count() == 0


def plain_coverage(text, limits):
    """Characters of repeated lines, and of the words in repeated n-grams, by n; and the verdict."""
    text = text or ""
    w = words(text)
    seen, dup_lines, line_chars, n_lines = set(), 0, 0, 0
    for line in text.split("\n"):
        if words(line):
            n_lines += 1
            if line in seen:
                dup_lines, line_chars = dup_lines + 1, line_chars + sum(map(len, words(line)))
            seen.add(line)
    covered = []
    for n in limits.ngram_chars:
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        often = collections.Counter(grams)
        inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + n)}
        covered.append(sum(len(w[j]) for j in inside))
    total, three = sum(map(len, w)), collections.Counter(zip(w, w[1:], w[2:]))
    repeat = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if three[g] > 1 for j in range(i, i + 3)}
    bad = len(w) < 50 or 100 * len(repeat) > 50 * len(w) or 100 * dup_lines > limits.lines * n_lines or 100 * line_chars > limits.line_chars * total
    bad = bad or 100 * sum(text.count(c) for c in "#*$%&|<>") > limits.symbols * len(w)
    return line_chars, tuple(covered), not (bad or any(100 * c > m * total for c, m in zip(covered, limits.ngram_chars.values(), strict=True)))


def test_repetition_coverage(spark, corpus):
    rng = random.Random(31)
    rows = [(i, r[1]) for i, r in enumerate(corpus)]
    for i in range(60):
        text = prose(rng, 80).split()
        for _ in range(i % 6):
            at, n = rng.randrange(60), rng.choice([4, 5, 6, 9, 11])
            text[rng.randrange(len(text)) : 0] = text[at : at + n]
        rows.append((1000 + i, " ".join(text) + "\nthe same line\n" * (i % 5)))
    limits = quality.Limits()
    got = {r.doc_id: (r.dup_line_chars, tuple(r.dup_ngram_chars), r.kept) for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_coverage(t, limits) for i, t in rows}
    assert 5 < sum(k for *_, k in got.values()) < len(got) - 5


# ---- op 9


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_token_counts_like_the_library(library):
    rng = random.Random(2)
    parts = list("aest'  \n\t\r1290.,!?-_  　éßñ日本語😀٣ᾈ​lLvVrRdDmM") + ["'s", "'re", "'ll", "<|endoftext|>", " the", "'ve", "  ", "\n\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["", "a" * 3000, "ab1" * 2000, " " * 700, "\n" * 500 + "x", "x" * 191 + "'s" + "y" * 300]
    got = tokencount.counter(tokenizer_path()).count(texts)
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_without_boundaries(library):
    rng = random.Random(2)
    texts = ["a" * 1_000_000, "".join(rng.choices("acgt", k=200_000)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), " " * 300_000, "-=" * 40_001, f"one two {'x' * 1000} three {'0123456789' * 300}\n{'y' * 193} z", "b" * 192, "b" * 193]
    began = time.time()
    got = tokencount.counter(tokenizer_path()).count(texts)
    assert time.time() - began < 20
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ids_of_long_white_space_and_special_strings(library):
    own = encode.encoder(tokenizer_path())
    for text in (" " * 2_000_000, "a" + "\t" * 2_000_000 + "b", "\n" * 2_000_000, f"{' ' * 999}x" * 50, f"{' ' * 1001}x", "<|endoftext|>a <|endoftext|><|endoftext|> b", "x" * 50_000):
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts_of_long_texts_in_pieces(library, monkeypatch):
    monkeypatch.setattr(tokencount, "PIECE", 40)
    monkeypatch.setattr(tokencount, "BLOCK", 300)
    draw = random.Random(9)
    bits = ["word", "don't", "we'll", "'re", "'s", " ", "  ", "\n", "\n\n ", "\t", "\r\n", ".", ",", "...", "、", "。", "漢字", "かな", "한글", "_", "12", "3.4", "é", "\x1c", "\x85", "\xa0", "\u3000", "🙂", "<|endoftext|>", "x" * 90]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 400))) for _ in range(300)] + ["", "a" * 1000, " " * 1000, "a " * 500, ("漢" * 30 + "。") * 40]
    assert sum(len(list(tokencount.cut(t))) > 1 for t in texts) > 200 and all("".join(tokencount.cut(t)) == t for t in texts)
    assert tokencount.counter(tokenizer_path()).count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memory_of_a_long_text_is_bounded():
    own = tokencount.counter(tokenizer_path())
    text = " some words, and more of them;\n 12 lines." * 200
    one, _ = own.count([text])[0], own.count([text * 300])  # compiled by now
    tracemalloc.start()
    got = own.count([text * 3000])[0]  # 25 million characters
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 3000 * one and most < 12 * len(text) * 3000


def test_other_vocabularies_are_refused():
    path = os.path.join(os.path.dirname(tokenizer_path()), "word_bpe_49k.json")
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.Counter(path)
    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError, match="byte-level"):
            tokencount.require_byte_level(spec | change, "changed")
    tokencount.require_byte_level(spec, "as it is")


def test_token_count_rows(spark, docs, corpus, library):
    got = collections.Counter(map(tuple, tokencount.token_counts(docs, tokenizer_path()).collect()))
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == collections.Counter((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 512) for r in corpus)
    assert tokencount.token_counts(empty(spark), tokenizer_path()).count() == 0


# ---- op 3


def test_packing_is_an_exact_cover(spark, docs, corpus, library):
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    by_window = collections.defaultdict(list)
    for r in got:
        by_window[r.sequence_id].append(r)
    short = 0
    for pieces in by_window.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at and len(p.ids) == 4 * p.length > 0
            at += p.length
        assert at <= 1024
        short += at & (at - 1) != 0
    assert short <= docs.rdd.getNumPartitions()
    want = collections.Counter()
    for r in corpus:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.update((r[0], len(ids), i, t) for i, t in enumerate(ids))
    have = collections.Counter()
    for r in got:
        have.update((r.doc_id, r.doc_tokens, r.start + i, int(t)) for i, t in enumerate(np.frombuffer(r.ids, np.uint32)))
    assert have == want
    assert packing.pack_documents(empty(spark), tokenizer_path()).count() == 0


def test_step_groups_have_equal_tokens():
    packer = packing.Packer()
    rng = random.Random(1)
    for i in range(6000):
        packer.add(i, np.zeros(rng.choice([120, 128, 250, 256, 500, rng.randint(1, 1500)]), np.uint32))
    packer.pack(True)
    windows = packer.take(8192, False)
    assert {t for t, _ in windows} == set(packing.TIERS)
    groups, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for g, (tier, w) in zip(packing.step_groups(windows, 8192), windows):
        groups[g].append((tier, w))
    for g, own in groups.items():
        assert len({t for t, _ in own}) == 1 and sum(t for t, _ in own) == 8192
        pieces[own[0][0]].append(sum(p[0] ** 2 for _, w in own for p in w))
    for costs in pieces.values():  # nearly the same work
        assert max(costs) <= 1.15 * min(costs)
    rest = packer.take(8192, True)
    assert all(sum(t for t, _ in rest if t == tier) < 8192 for tier in packing.TIERS)


# ---- op 4


def plain_repeats(rows, k):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for d, t in ordered:
        w = words(t)
        for i in range(len(w) - k + 1):
            key = (d is not None, d or 0, i)
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, key), key)
    out = collections.Counter()
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < (d is not None, d or 0, i) for j in range(i, i + k)}
        out[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("k, m", [(20, 6), (8, 3)])
def test_repeated_windows(spark, docs, corpus, k, m):
    got = substring.remove_repeats(docs, k, m).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats([(r[0], r[1]) for r in corpus], k)
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_repeated_windows_without_broadcast(docs, corpus, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_ROWS", -1)
    got = substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats([(r[0], r[1]) for r in corpus], 20)


@pytest.mark.parametrize("heavy", [1, 3])
def test_heavy_minimisers_have_several_first_buckets(spark, docs, corpus, monkeypatch, heavy):
    monkeypatch.setattr(substring, "BLOCK", 1 << 11)  # or a block would settle the most
    rng = random.Random(8)
    passage = prose(rng, 45)
    rows = [(i, f"{prose(rng, i % 30)} {passage} {prose(rng, 5)}") for i in range(60)] + [(r[0], r[1]) for r in corpus]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring.remove_repeats(frame, heavy=heavy).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows, 20)


def test_frequent_keys_are_counted_apart(spark, monkeypatch):
    rows = [(i, i * 7, 5 if i % 3 else i, 0, 1) for i in range(3000)] + [(i, 1, 8, 0, 1) for i in range(2)]
    kmers = spark.createDataFrame(rows, "id long, row_hash long, key long, start int, windows int")
    want = collections.Counter(r[2] for r in rows)
    for share in (64, 1, 10**9):
        monkeypatch.setattr(substring, "SAMPLED", share)
        got = substring._with_times(kmers).select("id", "key", "times").collect()
        assert len(got) == len(rows) and all(r.times == want[r.key] for r in got)


def test_a_common_phrase_in_different_texts_fills_no_bucket():
    """Each text holds one phrase among other words: as many different windows of one minimiser as texts."""
    rng, k = random.Random(4), 20
    phrase = [f"p{j}" for j in range(6)]
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(17)] + phrase + [f"w{rng.randrange(10**6)}" for _ in range(17)] for _ in range(400)]
    blobs = []
    for i, text in enumerate(texts):
        known = sorted(set(text))
        numbers = np.array([known.index(w) for w in text])
        one = lambda x: np.array([x])
        blobs.append(substring.pack(numbers, lambda at, t=text: [t[j].encode() for j in at], one(0), one(len(text)), one(i), one(0), one(0)))
    (ids, _, _), later = substring.settle_bucket(blobs, k, [(77, 16)] * 400, 1000)
    assert not ids
    windows = [len(substring.unpack(b)[0]) for _, b in later]
    assert sum(windows) == 400 * (40 - k + 1) and len(later) > 100 and max(windows) < 3 * np.median(windows)
    again, rest = substring.settle_bucket([b for _, b in later] * 2, k, [(None, None)] * 2 * len(later), 1000)
    assert not rest and not again[0]  # equal (id, start): neither is earlier


def test_a_text_of_millions_of_characters(spark):
    rng = random.Random(9)
    page = prose(rng, 90_000)
    rows = [(2, page), (1, page[: len(page) // 2]), (3, f"{page} {prose(rng, 400_000)}")]
    assert len(rows[2][1]) > 3_500_000
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows, 20)


def test_sliding_min_and_window_hashes():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for w in range(1, 20):
        assert substring.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(50 - w + 1)]
        h = substring.window_hashes(x, w)
        assert len(h) == 50 - w + 1 and len(set(h.tolist())) == len({tuple(x[i : i + w]) for i in range(50 - w + 1)})


# ---- op 1


def classes_of(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return sorted(sorted(g) for g in groups.values())


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, corpus):
    rng = random.Random(8)
    rows = {r[0]: r[1] for r in corpus if r[0] is not None}
    family = prose(rng, 120).split()
    for i in range(25):  # a family of near copies, too many for pairs to be listed by a bucket
        w = family[:]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(120)] = f"edit{i}"
        rows[1000 + i] = " ".join(w)
    df = spark.createDataFrame([(i, t, "s", 0, "", 0) for i, t in rows.items()], SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    sets = {i: shingle_set(t) for i, t in rows.items()}
    linked = [(a, b) for a, b in itertools.combinations(rows, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = collections.defaultdict(list)
    for i, c in got.items():
        groups[c].append(i)
    assert sorted(sorted(g) for g in groups.values()) == classes_of(rows, linked)
    assert all(c == min(g) for c, g in groups.items())


def test_near_duplicates_odd_rows(spark, docs, corpus):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    by_text = collections.defaultdict(set)
    for (doc, text, *_) in corpus:
        if words(text):
            by_text[tuple(words(text))].add(doc)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [tuple(words(r.text)) for r in kept.collect()]
    assert max(collections.Counter(t for t in texts if t).values()) == 1
    assert sum(not t for t in texts) == sum(not words(r[1]) for r in corpus)
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.drop_near_duplicates(empty(spark)).count() == 0


def plain_alignment(a, b):
    """Labelled shingles in common, in order, over all: the whole table of a longest common subsequence."""

    def labelled(t):
        w, seen, out = words(t), collections.Counter(), []
        for i in range(max(1, len(w) - 4)):
            g = tuple(w[i : i + 5])
            out.append((g, seen[g]))
            seen[g] += 1
        return out

    x, y = labelled(a), labelled(b)
    row = [0] * (len(y) + 1)
    for i in x:
        new = [0]
        for k, j in enumerate(y):
            new.append(row[k] + 1 if i == j else max(row[k + 1], new[k]))
        row = new
    return row[-1] / (len(x) + len(y) - row[-1])


def alignment(a, b, threshold=0.8):
    return neardup.aligned(*neardup._elements([a, b]), threshold)


def test_alignment_is_a_common_subsequence():
    text = "a b c d e f g h i j k l"
    assert alignment(text, text) == 1.0
    assert alignment(text, "a b c d e f g h i j k z", 0.5) == pytest.approx(7 / 9)
    assert alignment(text, "g h i j k l a b c d e f", 0.1) < 0.4
    rng = random.Random(6)
    for _ in range(200):
        w = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 90))]
        v = w[:]
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(v))
            v[at : at + rng.randint(0, 2)] = [rng.choice("abcxyz") for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.2:
            v = v[len(v) // 2 :] + v[: len(v) // 2]
        if not v:
            continue
        want = plain_alignment(" ".join(w), " ".join(v))
        assert (alignment(" ".join(w), " ".join(v)) >= 0.8) == (want >= 0.8)


def stem_family(rng, unit, stems, classes_, length, own, edits, copies=1):
    """Texts of `length` units with a common start; each class ends in units of its own and has copies with some edits."""
    out = []
    for _ in range(stems):
        stem = [unit(rng) for _ in range(length - own)]
        for _ in range(classes_):
            text = stem + [unit(rng) for _ in range(own)]
            out.append(text)
            for _ in range(copies):
                copy = text[:]
                for _ in range(edits):
                    copy[rng.randrange(length)] = unit(rng)
                out.append(copy)
    rng.shuffle(out)
    return out


def test_near_duplicates_of_texts_with_a_common_stem(spark):
    rng = random.Random(12)
    texts = [" ".join(t) for t in stem_family(rng, lambda r: f"w{r.randrange(9999)}", 2, 150, 220, 32, 3)]
    sets = [shingle_set(t) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    linked = [(a, b) for a, b in near if alignment(texts[a], texts[b]) >= 0.8]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.class_id].append(r.doc_id)
    assert sorted(sorted(g) for g in groups.values()) == classes_of(range(len(texts)), linked)
    assert 200 < len(groups) < 600 and all(r.class_size == len(groups[r.class_id]) for r in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201)]
    got = {r.n: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[201] == 200


# ---- op 10


def of_numbers(texts):
    return [np.array([int(x) for x in t.split()], np.uint64) for t in texts]


#: Contents are sets of numbers; linked are those that share 4 in 5 of them.
NUMBERS = links.Measure(of_numbers)


@pytest.mark.parametrize("rows, broadcast", [(1024, 1 << 25), (16, 1 << 25), (5, -1), (16, -1)])
def test_buckets_of_many_small_classes(spark, monkeypatch, rows, broadcast):
    """Families whose buckets hold mostly unrelated members, of one block or many: no link between members of a bucket is lost."""
    monkeypatch.setattr(links, "BLOCK_ROWS", rows)
    monkeypatch.setattr(links, "BROADCAST_BYTES", broadcast)
    rng = random.Random(4)
    contents, keys = {}, {}
    for n in range(300):
        family = n % 3
        own = set(range(family * 100, family * 100 + 30)) | {1000 + 20 * (n // 6) + i for i in range(9)}
        own -= set(rng.sample(sorted(own), rng.randint(0, 3)))
        contents[n] = " ".join(map(str, own))
        keys[n] = [rng.randrange(3) << 32, (10 + family * 5 + rng.randrange(5)) << 32, (100 + n) << 32]
    sets = {n: set(c.split()) for n, c in contents.items()}
    shared = [(a, b) for a, b in itertools.combinations(contents, 2) if set(keys[a]) & set(keys[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    packs = links.entries(np.array(list(keys)), np.array(list(keys.values())), 7)
    strings = spark.createDataFrame([(p, bytearray(b)) for p, b in packs], "part int, entries binary")
    names = spark.createDataFrame(list(contents.items()), "n long, content string")
    got = {r.n: r.label for r in classes(strings, lambda wanted: names.join(wanted, "n"), NUMBERS).collect()}
    want = {n: g[0] for g in classes_of(contents, shared) if len(g) > 1 for n in g}
    assert got == want and len(set(want.values())) > 30


def test_meetings_in_any_order():
    rng = np.random.default_rng(3)
    pairs = np.column_stack([rng.integers(0, 300, 3000), rng.integers(0, 5, 3000) * rng.integers(0, 2, 3000)])
    seen, got = links._Meetings(), set()
    for at in range(0, 3000, 170):
        got |= set(zip(*(x.tolist() for x in seen.take(pairs[at : at + 170])), strict=True))
    of = collections.defaultdict(set)
    for k, n in pairs.tolist():
        of[k].add(n)
    assert got == {(k, n) for k, own in of.items() if len(own) > 1 for n in own} and len(seen.key) == len(of)


def test_overlaps_of_rare_and_common_elements():
    rng = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(100, 5000, 60)])).astype(np.uint64) for _ in range(130)]
    got = links.overlaps(sets[:60], sets[60:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[60:]] for a in sets[:60]]


def test_lines_with_a_common_stem(spark):
    rng = random.Random(21)
    letter = lambda r: chr(r.randrange(97, 123))
    lines = ["".join(t) for t in stem_family(rng, letter, 2, 150, 350, 50, 3) + stem_family(rng, letter, 2, 150, 375, 45, 3)]
    rows = [(i, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 3)]
    got = linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert collections.Counter((r.doc_id, r.kept_text) for r in got) == plain_lines(rows)
    assert 300 < sum(len(r.kept_text.split("\n")) for r in got if r.kept_text) < 1000


def line_shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def plain_lines(rows):
    occ = [((d is not None, d or 0), i, x.strip(linededup.WHITE)) for d, t in rows for i, x in enumerate((t or "").split("\n"))]
    occ = [o for o in occ if o[2]]
    lines = sorted({o[2] for o in occ})
    sets = {x: line_shingles(x) for x in lines}
    linked = [(a, b) for a, b in itertools.combinations(lines, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = {x: n for n, g in enumerate(classes_of(lines, linked)) for x in g}
    first = {}
    for d, i, x in occ:
        first[group[x]] = min(first.get(group[x], (d, i)), (d, i))
    keep = {(d, i) for d, i, x in occ if first[group[x]] == (d, i)}
    out = collections.Counter()
    for d, t in rows:
        key = (d is not None, d or 0)
        kept = [x for i, x in enumerate((t or "").split("\n")) if not x.strip(linededup.WHITE) or (key, i) in keep]
        out[d, "\n".join(kept)] += 1
    return out


def test_line_dedup(spark, corpus):
    rows = {r[0]: r for r in corpus if r[0] is not None and len(r[1] or "") < 20_000}
    rows[500] = (500, rows[10][1].replace("the", "thy", 1) + "\nshort\nshort", "s", 0, "", 0)
    df = spark.createDataFrame(list(rows.values()), SCHEMA).repartition(3)
    got = linededup.line_report(df).collect()
    assert collections.Counter((r.doc_id, r.kept_text) for r in got) == plain_lines([(r[0], r[1]) for r in rows.values()])


def test_lines_at_the_threshold_share_a_band():
    """Of pairs at Jaccard 0.8 about 0.02 % share no band; with 9 bands it was eight times as many."""
    rng = random.Random(8)
    pairs = []
    for _ in range(20000):
        a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=79))
        pairs.append((a, a[:39] + "#" + a[40:]))  # 64 of 80 shingles
    assert all(len(line_shingles(a) & line_shingles(b)) == 0.8 * len(line_shingles(a) | line_shingles(b)) for a, b in pairs[:100])
    left, right = (linededup.band_keys(list(x)) for x in zip(*pairs, strict=True))
    missed = (left != right).all(axis=1).sum()
    assert missed <= 3


def test_line_dedup_odd_rows(spark, docs, corpus):
    assert linededup.line_report(docs).count() == len(corpus)
    own = [r for r in corpus if not (r[1] or "").startswith("another text of the same id")]  # rows that tie in doc_id only by being equal
    got = linededup.line_report(spark.createDataFrame(own, SCHEMA).repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.kept_text) for r in got) == plain_lines([(r[0], r[1]) for r in own])
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() <= len(corpus)
    assert linededup.line_report(empty(spark)).count() == 0


# ---- op 8


def test_mixing(spark, docs, corpus):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(corpus)
    sizes = collections.Counter()
    for r in corpus:
        sizes[r[2]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = dict(zip(names, itertools.cycle((3, 1, 2))))
    full, want = set(), {}
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        want = {s: 2 * sizes[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and want[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    source = collections.defaultdict(set)
    for r in corpus:
        source[r[0]].add(r[2])
    taken = collections.Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        if len(source[r.doc_id]) == 1:
            s = next(iter(source[r.doc_id]))
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    longest = max(len(words(r[1])) for r in corpus)
    total = sum(r.taken for r in got)
    assert abs(total - 1.5 * sum(sizes.values())) <= longest * len(names)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_plan(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == total
    assert mixing.mix_plan(empty(spark)).count() == 0 and taken is not None


def test_mixing_with_many_sources(spark, docs, monkeypatch):
    want = sorted(map(repr, mixing.mix_plan(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    assert sorted(map(repr, mixing.mix_plan(docs).collect())) == want


# ---- op 7


def test_lookup_table():
    t = sharding.lookup_table([f"s{i}" for i in range(9)], 997)
    c = collections.Counter(t)
    assert max(c.values()) - min(c.values()) <= 1
    less = sharding.lookup_table([f"s{i}" for i in range(8)], 997)
    assert sum(a != b for a, b in zip(t, less)) < 0.25 * 997
    heavy = collections.Counter(sharding.lookup_table(["a", "b"], 997, [2, 1]))
    assert 1.9 < heavy[0] / heavy[1] < 2.1
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_sharding_rows(spark, docs, corpus, tmp_path):
    t = sharding.lookup_table([f"s{i}" for i in range(5)], 997)
    got = sharding.place(docs, t).collect()
    assert len(got) == len(corpus) and all(r.shard == t[r.slot] for r in got)
    sharding.write_shards(docs, t, str(tmp_path / "x"), files=2)
    assert spark.read.parquet(str(tmp_path / "x")).count() == len(corpus)
    assert sharding.place(empty(spark), t).count() == 0


# ---- op 5


def test_most_lists_are_skipped(spark):
    """50,000 vectors in general position: they go to several lists, queries read a few, and the nearest are found."""
    rng = np.random.default_rng(17)
    v = rng.normal(size=(50_000, 64)) + 0.5 * rng.normal(size=(10, 64))[rng.integers(0, 10, 50_000)]
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(v))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 64).cast(pa.list_(pa.float64()))}))
    asks = np.arange(0, 50_000, 200)
    got = ann.search(df.repartition(8), df.filter("vec_id % 200 = 0")).collect()
    scores = v[asks] @ v.T
    scores[np.arange(len(asks)), asks] = -np.inf
    want = {(int(q), int(c)) for q, row in zip(asks, np.argsort(-scores, axis=1)[:, :20], strict=True) for c in row}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    p = ann.Params()
    x = ann.augment(v[rng.permutation(len(v))[: p.sample]], 1.0)
    graph = ann.CentroidGraph(ann.balanced_centroids(x, len(v) // p.list_rows, p.iterations), p.degree)
    row, lists = ann.closure_lists(graph, ann.augment(v[:2000], 1.0), p)
    own = np.bincount(lists[np.append(True, row[1:] != row[:-1])], minlength=len(graph.c)) * 25
    at, _ = ann.lists_to_read(graph, v[asks], 1.0, own, 20, p)
    assert len(row) > 2 * 2000 and len(at) < 0.4 * len(graph.c) * len(asks)
    assert np.bincount(at, minlength=len(asks)).std() > 5  # the ratio, not the beam, says how many


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)) * rng.uniform(0.2, 2, (700, 1))
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)]
    rows += [(700 + i, [float(v) for v in x[0]]) for i in range(300)]  # a hot vector, ties by id
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] * 16), (2004, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("list", F.lit("x"))
    got = ann.search(df, df.filter("vec_id % 20 = 0"), 20).collect()
    by_query = collections.defaultdict(dict)
    for r in got:
        by_query[r.query_id][r.rank] = (r.vec_id, r.score)
    good = [(i, np.array(v)) for i, v in rows[:1000]]
    matrix, ids = np.stack([v for _, v in good]), np.array([i for i, _ in good])
    assert set(by_query) == {i for i, _ in good if i % 20 == 0}
    hits = 0
    for q, found in by_query.items():
        score = ann.dots(matrix[q], matrix)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        assert sorted(found) == list(range(1, 21))
        assert [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda p: (-p[1], p[0]))
        assert all(score[i] == s for i, s in found.values())
        hits += len({i for i, _ in found.values()} & set(ids[order].tolist()))
    assert hits / (20 * len(by_query)) >= 0.9
    few = df.filter("vec_id < 8")
    assert ann.search(few, few.filter("vec_id = 0"), 20).count() == 7
    assert ann.search(df.filter("false"), df.filter("false")).count() == 0


# ---- op 2


def test_preference_rows(spark):
    turn = "array<struct<role:string,text:string>>"
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    b = [("user", "hi"), ("assistant", "hello"), ("assistant", "no"), ("user", "x")]
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, a, None), (4, None, None)], f"pair long, chosen {turn}, rejected {turn}")
    got = {r.pair: r for r in preference.preference_rows(df).collect()}
    r = got[1]
    assert r.n_prompt_turns == 2 and r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert [r.chosen_text[s["from"] : s["to"]] for s in r.chosen_spans] == ["yes<|end|>\n"]
    assert [r.rejected_text[s["from"] : s["to"]] for s in r.rejected_spans] == ["no<|end|>\n"]
    assert got[2].chosen_text == got[2].rejected_text == "" and got[2].chosen_spans == []
    assert got[3].n_prompt_turns == 0 and got[3].rejected_text == "" and got[4].prompt == ""


def test_preference_tables_without_rows_and_with_clashing_columns(spark):
    turn = "array<struct<role:string,text:string>>"
    none = spark.createDataFrame([], f"pair long, chosen {turn}, rejected {turn}")
    assert preference.preference_rows(none).count() == 0
    assert preference.preference_rows(preference.swapped_answers(spark.createDataFrame([], "conv_id long, turn long, role string, text string, key string, partner long"))).count() == 0
    rows = [(1, "p", "c", 5, [("user", "x" * 2_000_000), ("assistant", "a")], [("user", "x" * 2_000_000), ("assistant", "b")])]
    got = preference.preference_rows(spark.createDataFrame(rows, f"pair long, prompt string, chosen_text string, turns int, chosen {turn}, rejected {turn}")).first()
    assert got.turns == 5 and got.prompt.count("x") == 2_000_000 and got.chosen_text == "<|assistant|>\na<|end|>\n" and got.pair == 1


def test_conversations_with_odd_turns(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (1, 0, "user", None), (1, None, None, "z"), (3, 0, "assistant", "w"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preference.preference_rows(preference.swapped_answers(df)).collect()
    assert collections.Counter(r.conv_id for r in got) == collections.Counter([0, 1, 3, None])


# ---- the pipeline


def duck_rows(frame, text, *columns):
    """The rows of a DuckDB query over these documents."""
    con = duckdb.connect()
    con.register("documents", frame)
    return con.execute(f"SELECT {', '.join(columns)} FROM ({text})").fetchall()


def plain_pipeline(docs, library):
    """The ids of every packed document, in a multiset, by plain versions of the five stages. docs: a pyarrow table."""
    kept = {r[0] for r in duck_rows(docs, sql.quality(quality.Limits()), "doc_id", "kept") if r[1]}
    rows = [r for r in docs.to_pylist() if r["doc_id"] in kept]
    lines = {d: t for d, t in plain_lines([(r["doc_id"], r["text"]) for r in rows]) if words(t)}
    rows = [r | {"text": lines[r["doc_id"]]} for r in rows if r["doc_id"] in lines]
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    first = {g[0] for g in classes_of(sorted(sets), linked)}
    rows = [r for r in rows if r["doc_id"] in first]
    times = {d: taken // size for d, size, taken in duck_rows(pa.Table.from_pylist(rows, docs.schema), sql.MIX, "doc_id", "size", "taken")}
    return collections.Counter({(r["doc_id"], tuple([*library.encode(r["text"], add_special_tokens=False).ids, 0])): times[r["doc_id"]] for r in rows if times[r["doc_id"]]})


def unpacked(pieces):
    """Packed documents put together again: pieces of copies of one document are equal, so each start comes as often as the document."""
    starts = collections.defaultdict(collections.Counter)
    for r in pieces:
        starts[r.doc_id][r.start, bytes(r.ids)] += 1
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    out = collections.Counter()
    for doc, own in starts.items():
        total = collections.Counter()
        for (start, ids), n in own.items():  # copies may be cut apart differently
            for k, x in enumerate(np.frombuffer(ids, np.uint32).tolist()):
                total[start + k, x] += n
        assert len(set(total.values())) == 1
        out[doc, tuple(x for _, x in sorted(total))] = next(iter(total.values()))
    return out


def test_pipeline_run(spark, data, library):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{data}/documents.parquet").toArrow()
    got = c.run(spark, data)
    assert unpacked(got.collect()) == plain_pipeline(docs, library)
    left = set(os.listdir(os.path.dirname(got.inputFiles()[0].removeprefix("file:")).rsplit("/", 1)[0]))
    assert left == {"packing"} and not common._STORED


def test_pipeline_stages_on_odd_rows(spark, corpus, tmp_path):
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, label string, n long, row_hash string, gone int, times int, h int"
    rows = [(r[0], r[1], None, r[2], len(r[1]) if r[1] else None, 7, "x", 1, "y", 2, 3, 4) for r in corpus]
    rows += [(None, None, None, None, None, *[None] * 7), (5, "one line alone " * 200_000, "en", "s", 3_000_000, *[None] * 7)]
    for name, frame in (("odd", spark.createDataFrame(rows, schema).repartition(3)), ("empty", spark.createDataFrame([], schema))):
        docs = frame
        for k, (stage, function) in enumerate(c.STAGES):
            for own in ("raw", "left"):  # the rows as they are, and what the stages before leave
                out = function(spark, frame if own == "raw" else docs, "")
                out.write.parquet(str(tmp_path / f"{name}-{k}-{own}"))
                assert k == 4 or (out.columns == frame.columns and out.count() <= 2 * len(rows))
                assert name == "odd" or out.count() == 0
            docs = spark.read.parquet(str(tmp_path / f"{name}-{k}-left"))
