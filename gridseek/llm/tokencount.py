"""Token counts by a compiled finite-state transducer.

The vocabulary's merges become a deterministic transducer over bytes. A state holds what the future can
depend on: the pending suffixes that some token begins with, the token before each, and how many tokens
that reading has less than the best one so far. Each transition carries the number of tokens that the
byte adds to the count (it can be negative: a byte may join two tokens to one), so a text's count is a
sum over its bytes. States and transitions are compiled when a text first needs them, into a hash table
in numpy; the number of live states is bounded by starting afresh.

The pre-tokenizer's boundaries are decided by a window of a few characters, so they are found for a whole
block at once. Texts are cut into chunks that run in lockstep, one lane each. A chunk is a map from entry
state to (exit state, count), constant but for its head before the first boundary: the first sweep takes the
tails. A chunk without a boundary has a table of the entry states that can come up: it runs from the state
after a boundary and from whatever its predecessor's table puts out, in lockstep with the others, until
nothing new comes up. Different states fall together within a few bytes or recur, so tables are short. A
parallel prefix scan then composes the maps of 1, 2, 4, ... chunks in a row, and a last sweep takes the heads.

Special strings in a text are tokens of their own, as in the library's default; they part the text. Only the
character classes are asked of the library, one probe per new character, so its Unicode tables hold.

A long text is counted in pieces of PIECE characters, cut where a pre-token starts whatever surrounds it: before
white space that follows other characters, or before a mark that follows a letter or digit. Counts add up, so memory
is some 50 bytes a byte of a piece, and of a run longer than that without any such place.

Only plain byte-level vocabularies are compiled; for any other kind of file an error says what is unlike them.

Cases: null counts as empty; a null or repeated id is a row like others; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gridseek.llm.common import U64, small_batches

CHUNK = 192
MAX_STATES = 800_000
#: Characters of a text, and bytes or characters of a block of texts, that are counted at once.
PIECE, BLOCK = 1 << 20, 2 << 20
#: Places where a pre-token starts whatever stands around them.
_CUT = re.compile("(?<=\\S)[ \\t\\n\\r]|(?<=[A-Za-z0-9ぁ-ゖァ-ヺ一-龥가-힣])[,.;:!?。、！？]")
LETTER, NUMBER, OTHER, WHITE = range(4)
_UNKNOWN = 255
_HEAD = 1  # the state before a chunk's first boundary


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pack(reading: int, behind: int) -> int:
    return reading << 10 | behind + 512


def require_byte_level(spec: dict, path: str) -> None:
    """An error for a tokenizer whose texts the transducer would count otherwise than its library."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    unlike = [
        ("a normalizer", spec.get("normalizer")),
        ("a pre-tokenizer other than ByteLevel", pre.get("type") != "ByteLevel"),
        ("a space put before texts", pre.get("add_prefix_space")),
        ("no splitting by the pattern", not pre.get("use_regex", True)),
        ("a model other than BPE", model.get("type", "BPE") != "BPE"),
        ("a vocabulary without some byte", not set(byte_alphabet()) <= set(model.get("vocab", {}))),
        *((f"the model's {k}", model.get(k)) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix")),
        *(("special strings that take what surrounds them", True) for x in spec.get("added_tokens", []) if x.get("single_word") or x.get("lstrip") or x.get("rstrip")),
    ]
    found = [what for what, there in unlike if there]
    if found:
        raise ValueError(f"{path} isn't a plain byte-level vocabulary: {', '.join(dict.fromkeys(found))}")


def cut(text: str) -> Iterator[str]:
    """The text in pieces of at least PIECE characters (the last may be shorter), whose token counts add up to its own."""
    at = 0
    while len(text) - at > PIECE and (found := _CUT.search(text, at + PIECE)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Merges:
    """The vocabulary: which bytes are a token, which begin one, and whether two tokens stay apart."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        require_byte_level(spec, path)
        letters, model = byte_alphabet(), spec["model"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in model["vocab"].items() if k not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.begins = {k[:i] for k in self.ids for i in range(1, len(k) + 1)}
        self.begins = {k: k for k in self.begins}  # one object for each

    def split(self, text: bytes) -> list[bytes]:
        """The plain algorithm: join the pair of lowest rank until none is left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, pair = min((self.rank.get(p, 1 << 30), p) for p in zip(parts, parts[1:], strict=False))
            if rank == 1 << 30:
                break
            out: list[bytes] = []
            skip = False
            for i, p in enumerate(parts):
                if skip:
                    skip = False
                elif i + 1 < len(parts) and (p, parts[i + 1]) == pair:
                    out.append(p + parts[i + 1])
                    skip = True
                else:
                    out.append(p)
            parts = out
        return parts

    def stay_apart(self, a: bytes | None, b: bytes) -> bool:
        """Whether the encoding of a + b is these two; a sequence is an encoding iff all its neighbours stay apart."""
        return a is None or self.split(a + b) == [a, b]


class Transducer:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.reset()

    def reset(self, slots: int = 1 << 20) -> None:
        self.readings: list[tuple[bytes, bytes | None]] = [(b"", None)]  # a pending suffix and the token before it
        self.reading_ids: dict = {(b"", None): 0}
        self.grown: dict[int, tuple[int, bool]] = {}
        start = (_pack(0, 0),)
        self.states: list = [start, ()]  # a state: its readings, the longest suffix first, the empty one last
        self.keys: dict = {start: 0, (): _HEAD}
        self.key_at, self.next_at, self.add_at = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int16)
        self.mask, self.used = slots - 1, 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(24)).astype(np.int64) & self.mask

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of keys (open addressing), and which keys are missing."""
        slot = self._slot(key)
        there = self.key_at[slot]
        off = np.flatnonzero((there != key) & (there != -1))
        while len(off):
            slot[off] = (slot[off] + 1) & self.mask
            there = self.key_at[slot[off]]
            off = off[(there != key[off]) & (there != -1)]
        return slot, self.key_at[slot] == -1

    def put(self, key: int, state: int, add: int) -> None:
        if self.used * 2 > self.mask:
            old = self.key_at >= 0
            keys, nexts, adds = self.key_at[old], self.next_at[old], self.add_at[old]
            size = 4 * (self.mask + 1)
            self.key_at, self.next_at, self.add_at, self.mask = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16), size - 1
            left = np.arange(len(keys))
            slot = self._slot(keys)
            while len(left):
                free = self.key_at[slot[left]] == -1
                self.key_at[slot[left[free]]] = keys[left[free]]  # of those that want a slot the last gets it
                got = self.key_at[slot[left]] == keys[left]
                won = left[got]
                self.next_at[slot[won]], self.add_at[slot[won]] = nexts[won], adds[won]
                left = left[~got]
                slot[left] = (slot[left] + 1) & self.mask
        slot = int(self._slot(np.array([key]))[0])
        while self.key_at[slot] != -1:
            slot = (slot + 1) & self.mask
        self.key_at[slot], self.next_at[slot], self.add_at[slot] = key, state, add
        self.used += 1

    def compile(self, state: int, byte: int) -> None:
        """Add the transition of a state by a byte."""
        key = state << 8 | byte
        if state == _HEAD:
            return self.put(key, _HEAD, 0)
        add, token, kept = None, None, []
        for packed in self.states[state]:
            reading, behind = packed >> 10, (packed & 1023) - 512
            got = self.grown.get(reading << 8 | byte)
            if got is None:
                got = self.grown[reading << 8 | byte] = self._grow(reading, byte)
            if got[0] >= 0:
                kept.append((got[0], behind))
                if add is None and got[1]:
                    token, add = self.readings[got[0]][0], behind + 1
        new = (*(_pack(r, c - add) for r, c in kept), _pack(self._reading(b"", token), 0))
        to = self.keys.get(new)
        if to is None:
            to = self.keys[new] = len(self.states)
            self.states.append(new)
        self.put(key, to, add)

    def _reading(self, suffix: bytes, before: bytes | None) -> int:
        got = self.reading_ids.get((suffix, before))
        if got is None:
            got = self.reading_ids[suffix, before] = len(self.readings)
            self.readings.append((suffix, before))
        return got

    def _grow(self, reading: int, byte: int) -> tuple[int, bool]:
        """The reading with one byte more (-1: no token begins so), and whether its suffix is a token that stays apart."""
        suffix, before = self.readings[reading]
        longer = self.merges.begins.get(suffix + bytes((byte,)))
        if longer is None:
            return -1, False
        return self._reading(longer, before), longer in self.merges.ids and self.merges.stay_apart(before, longer)

    def sweep(self, chars: np.ndarray, fresh: np.ndarray, entry: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run the lanes in lockstep: columns of bytes, boundaries and lengths; exit states and counts."""
        state, total = entry.astype(np.int64), np.zeros(len(entry), np.int64)
        for j in range(int(until.max(initial=0))):
            on = np.flatnonzero(until > j)
            now = state[on]
            now[fresh[on, j]] = 0
            key = now << 8 | chars[on, j]
            slot, missing = self.find(key)
            if missing.any():
                for k in np.unique(key[missing]).tolist():
                    self.compile(k >> 8, k & 255)
                slot, _ = self.find(key)
            state[on] = self.next_at[slot]
            total[on] += self.add_at[slot]
        return state, total


class Classes:
    """Character classes as the library's own pre-tokenizer has them."""

    def __init__(self) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.table, self.probe = np.full(0x110000, _UNKNOWN, np.uint8), ByteLevel(add_prefix_space=False)

    def of(self, points: np.ndarray) -> np.ndarray:
        got = self.table[points]
        if (got == _UNKNOWN).any():
            for c in np.unique(points[got == _UNKNOWN]).tolist():
                alone = (k for k, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.probe.pre_tokenize_str(lead + chr(c))) == 1)
                self.table[c] = next(alone, WHITE)
            got = self.table[points]
        return got


def boundaries(points: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where a pre-token starts. begins: where a text (or what follows a special string) starts.

    A run of white space leaves its last character to what follows, which takes it if it is a space."""
    n = len(points)
    if not n:
        return begins
    white = kind == WHITE
    before = np.roll(kind, 1)
    ends = np.roll(begins, -1)  # the last character of a text
    ends[-1] = True
    start = begins.copy()
    same = ~begins & (kind == before)
    start |= ~begins & ~white & (before != WHITE) & ~same
    start |= white & (before != WHITE)
    start |= ~white & (before == WHITE) & (np.roll(points, 1) != 32)
    start |= white & ~ends & (np.roll(kind, -1) != WHITE)
    # 's 't 'm 'd 're 've 'll where the apostrophe starts a pre-token
    at = np.flatnonzero((points == 39) & ((before != OTHER) | begins) & ((np.roll(points, 1) != 32) | begins) & ~ends)
    if len(at):
        pad = np.concatenate([points, [0, 0]])
        one, two = pad[at + 1], pad[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        stops = np.concatenate([ends, [True, True]])
        long = ~short & ~stops[at + 1] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        start[at[short | long] + 1] = False
        start[at[long] + 2] = False
        for found, width in ((at[short], 2), (at[long], 3)):
            after = found + width
            start[after[after < n]] = True
    return start


class Counter:
    """Counts the tokens of texts; one for each Python worker."""

    def __init__(self, path: str):
        self.fst, self.classes = Transducer(path), Classes()

    def count(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        pieces, owner, held = [], [], 0
        for i, text in enumerate(texts):
            parts = [text]
            for s in self.fst.merges.special:
                if s in text:
                    parts = [q for p in parts for q in p.split(s)]
            total[i] = len(parts) - 1
            for part in parts:
                for piece in cut(part):
                    if pieces and held + len(piece) > BLOCK:
                        np.add.at(total, np.array(owner, np.int64), self._count(pieces))
                        pieces, owner, held = [], [], 0
                    pieces.append(piece)
                    owner.append(i)
                    held += len(piece)
        np.add.at(total, np.array(owner, np.int64), self._count(pieces))
        return total

    def _count(self, pieces: list[str]) -> np.ndarray:
        fst = self.fst
        if len(fst.states) > MAX_STATES:
            fst.reset()
        joined = "".join(pieces)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        buf = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        if not len(points):
            return np.zeros(len(pieces), np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.zeros(len(points) + 1, bool)
        begins[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
        first = np.flatnonzero((buf & 0xC0) != 0x80)  # the first byte of each character
        fresh = np.zeros(len(buf), bool)
        fresh[first[boundaries(points, self.classes.of(points), begins[:-1])]] = True

        # chunks: every piece is cut into lanes of CHUNK bytes
        edges = np.append(first, len(buf))[np.concatenate([[0], np.cumsum(lengths)])]
        sizes = np.diff(edges)
        n_chunks = -(-sizes // CHUNK)
        piece = np.repeat(np.arange(len(pieces)), n_chunks)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        begin = edges[piece] + nth * CHUNK
        until = np.minimum(CHUNK, edges[piece + 1] - begin)
        pad = np.concatenate([buf, np.zeros(CHUNK, np.uint8)])
        window = begin[:, None] + np.arange(CHUNK)
        chars = pad[window].astype(np.int64)
        starts = np.concatenate([fresh, np.zeros(CHUNK, bool)])[window]
        starts &= np.arange(CHUNK) < until[:, None]
        constant = starts.any(axis=1)
        head = np.where(constant, starts.argmax(axis=1), until)

        exit_state, count = fst.sweep(chars, starts, np.full(len(begin), _HEAD), until)
        free = np.flatnonzero(~constant)
        if len(free):
            exit_state[free], count[free] = self._scan(chars, until, free, exit_state)
        todo = np.flatnonzero(constant & (head > 0))
        _, more = fst.sweep(chars[todo], starts[todo], exit_state[todo - 1], head[todo])
        count[todo] += more
        return np.bincount(piece, weights=count, minlength=len(pieces)).astype(np.int64)


    def _scan(self, chars: np.ndarray, until: np.ndarray, free: np.ndarray, exit_state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of the chunks without a boundary, in this order."""
        # maps: all chunks from the entry state that follows a boundary, then from what their predecessors put out, until that is nothing new
        after = np.concatenate([[False], np.diff(free) == 1])  # whose predecessor has no boundary either
        leads = np.append(after[1:], False)
        key = np.zeros(0, np.int64)  # chunk (its number in free) and entry state
        to, add = np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.flatnonzero(~after) << 32 | exit_state[free[~after] - 1]
        want = np.unique(np.concatenate([known, np.flatnonzero(after) << 32]))
        while len(want):
            chunk = want >> 32
            lanes = chars[free[chunk]]
            out, more = self.fst.sweep(lanes, np.zeros(lanes.shape, bool), want & 0xFFFFFFFF, until[free[chunk]])
            key, to, add = np.concatenate([key, want]), np.concatenate([to, out]), np.concatenate([add, more])
            order = np.argsort(key)
            key, to, add = key[order], to[order], add[order]
            on = leads[chunk]
            want = np.setdiff1d((chunk[on] + 1) << 32 | out[on], key)
        # prefix scan: `jump` is the map of 1, 2, 4, ... chunks in a row, and the entries in use are those that jumps lead to
        chunk = key >> 32
        jump = np.where(leads[chunk], np.searchsorted(key, (chunk + 1) << 32 | to), len(key))
        jump = np.append(np.minimum(jump, len(key)), len(key))
        used = np.zeros(len(key) + 1, bool)
        used[np.searchsorted(key, known)] = True
        for _ in range(int(len(free)).bit_length()):
            used[jump[used]] = True
            jump = jump[jump]
        own = np.flatnonzero(used[:-1])
        return to[own], add[own]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every document. One narrow pass; each worker compiles its own transducer."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK, side="right")))
                n = own.count([x or "" for x in batch.column(1).slice(at, to - at).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(sizes[at:to]), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])
                at = to

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
