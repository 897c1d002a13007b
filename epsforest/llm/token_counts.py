"""Token counts of a piece tokenizer by a deterministic finite-state transducer compiled from its vocabulary.

The tokenizer merges neighbouring symbols, best rank first, leftmost first among equal ones. Two facts make that finite-state.
A sequence of pieces is the encoding of its text exactly if each piece and the next are an encoding of theirs; and whether
two pieces are follows from the merges that made them (``Vocabulary.fit``). So of every prefix of a text one piece is the
last, and reading a character needs only: the suffixes that are prefixes of some piece (nodes of a trie), each with the last
piece before it and with how many tokens it has by now. Such a set is a state. A transition is annotated with the tokens it
emits, which is negative where a longer piece takes the place of several. States are compiled from the vocabulary when a
text first leads to them; the library is never asked.

Texts are cut into chunks. A chunk that starts where nothing before it matters (a word's mark after other characters, a
character that no piece has) is entered in the start state; a longer stretch is cut by length, and such a chunk is a map from
the state it is entered in to the state it leaves and the tokens emitted. All chunks of a block run in step, one table lookup
a character. The maps of chained chunks are composed: they are entered speculatively, then in the state their predecessor
really left, which settles at once where states run together; chains that don't are settled by a prefix scan that
composes neighbouring maps in doubling strides over the states that occur.

Defined results: a null text counts as empty (0 bytes, 0 tokens). Rows are independent; repeated rows repeat. Long texts are
read whole, block by block. Bytes that are no UTF-8 count as U+FFFD each.
"""

from __future__ import annotations

import struct
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsforest.llm.textscan import pieces

MARK, BLANK = "▁", " "
#: Characters of a chunk (it goes on to the next free place), of the longest chunk, and of a block of a long text.
CHUNK, LONGEST, BLOCK = 96, 256, 1 << 21
#: States that a worker keeps between blocks; rounds of entering chunks anew; states that a composed map may have.
STATES, ROUNDS, WIDTH = 400_000, 4, 64
NONE = -1


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker."""
    return sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one message of the model file: number and value."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[i : i + size]
        i += size


@dataclass
class Vocabulary:
    """Pieces by number, what they rank, the symbols at their edges, and a trie over character classes."""

    pieces: list[str]
    rank: dict[str, float]
    classes: dict[str, int] = field(default_factory=dict)
    child: list[dict[int, int]] = field(default_factory=lambda: [{}])
    token: list[int] = field(default_factory=lambda: [NONE])
    left: list[list[tuple[str, float]]] = field(default_factory=list)
    right: list[list[tuple[str, float]]] = field(default_factory=list)

    def merged(self, text: str) -> tuple[list[str], str, str]:
        """The symbols that ``text`` ends with, and the two that were merged last."""
        x, a, b = list(text), "", ""
        while True:
            ranks = [(self.rank.get(x[i] + x[i + 1], float("inf")), i) for i in range(len(x) - 1)]
            best, i = min(ranks, default=(float("inf"), 0))
            if best == float("inf"):
                return x, a, b
            a, b = x[i : i + 2]
            x[i : i + 2] = [a + b]

    def close(self) -> Vocabulary:
        """Derives the trie and the edges; refuses vocabularies for which the two facts don't hold."""
        for c in sorted({c for p in self.pieces for c in p}):
            self.classes[c] = len(self.classes) + 4  # 0 to 3: characters that no piece has, by their bytes
        known, split = set(self.pieces), {}
        for p in self.pieces:
            if not known.issuperset(p) or MARK in p.lstrip(MARK) or p.startswith(2 * MARK) and p.strip(MARK):
                raise ValueError(f"piece {p!r} has an unknown character or a mark inside")
            if len(p) > 1:
                whole, a, b = self.merged(p)
                if whole != [p] or max(self.rank.get(a, 0), self.rank.get(b, 0)) > self.rank[p]:
                    raise ValueError(f"piece {p!r} is not what its characters merge to")
                split[p] = (a, b)
        for n, p in enumerate(self.pieces):
            at = 0
            for c in p:
                at = self.child[at].setdefault(self.classes[c], len(self.child))
                if at == len(self.child):
                    self.child.append({})
                    self.token.append(NONE)
            self.token[at] = n
            for side, edges in ((0, self.left), (1, self.right)):
                symbol, until, own = p, float("inf"), []
                while True:  # a symbol is at the edge until its parent is made
                    own.append((symbol, until))
                    if symbol not in split:
                        break
                    symbol, until = split[symbol][side], self.rank[symbol]
                edges.append(own)
        return self

    def fit(self, p: int, t: int) -> bool:
        """Whether ``p`` then ``t`` is an encoding: no merge of symbols at their common edge comes before those that made the pieces."""
        if p == NONE:
            return True
        a, b = self.pieces[p], self.pieces[t]
        if not a.strip(MARK) and not b.strip(MARK):  # runs of blanks share one rank, so their order is all that counts
            return self.merged(a + b)[0] == [a, b]
        for x, until_x in self.right[p]:
            for y, until_y in self.left[t]:
                rank = self.rank.get(x + y)
                if rank is not None and rank < until_x and rank <= until_y:
                    return False
        return True


def read_model(model: bytes) -> Vocabulary:
    """The vocabulary of a model file of merged pieces with byte fallback, whose normaliser only marks blanks."""
    found, rank, facts = [], {}, {}
    for number, value in _fields(model):
        if number == 1:
            x = dict(_fields(value))
            text, kind = x[1].decode(), x.get(3, 1)
            if kind == 1:
                found.append(text)
                if len(text) > 1:
                    rank[text] = -struct.unpack("<f", x[2])[0]
            elif kind in (4, 5):
                raise ValueError(f"piece {text!r} is of a kind that is not merged")
        elif number in (2, 3):
            facts |= {(number, k): v for k, v in _fields(value)}
    if facts.get((2, 3)) != 2 or not facts.get((2, 35)) or facts.get((3, 2)) or facts.get((3, 4), 1) or not facts.get((3, 3), 1) or not facts.get((3, 5), 1):
        raise ValueError("not a model of merged pieces with byte fallback whose normaliser only marks blanks")
    return Vocabulary(found, rank).close()


class Transducer:
    """States, each (last piece, ((node, piece before, tokens since), ...)), and their transitions in a hash table."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.n_classes = len(vocabulary.classes) + 4
        self.class_of = np.empty(0x110000, np.int32)
        self.class_of[:0x80], self.class_of[0x80:0x800], self.class_of[0x800:0x10000], self.class_of[0x10000:] = 0, 1, 2, 3
        for c, k in vocabulary.classes.items():
            self.class_of[ord(c)] = k
        self.class_of[ord(BLANK)] = self.mark = self.class_of[ord(MARK)]
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [(NONE, ())]
        self.ids = {self.states[0]: 0}
        self.fits: dict[tuple[int, int], bool] = {}
        self._table(1 << 19)
        self.known = 0

    def _table(self, size: int) -> None:
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.to, self.emit = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)

    def step(self, state: int, c: int) -> tuple[int, int]:
        """The transition of ``state`` by class ``c``: the next state and the tokens it emits."""
        if c < 4:  # bytes instead of a piece: nothing merges across them
            return 0, c + 1
        last, items = self.states[state]
        child, token, fits = self.v.child, self.v.token, self.fits
        emitted, new, open_ = None, NONE, []
        for node, before, since in ((0, last, 0), *items):
            at = child[node].get(c)
            if at is None:
                continue
            if (t := token[at]) != NONE and emitted is None:
                ok = fits.get((before, t))
                if ok is None:
                    ok = fits[before, t] = self.v.fit(before, t)
                if ok:
                    new, emitted = t, 1 - since
            if child[at]:
                open_.append((at, before, since))
        key = (new, tuple((node, before, since + emitted) for node, before, since in open_))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        return to, emitted

    def _insert(self, key: int, to: int, emit: int) -> None:
        slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[slot] != -1:
            slot = (slot + 1) & self.mask
        self.keys[slot], self.to[slot], self.emit[slot] = key, to, emit

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slots of the transitions ``state * n_classes + class``, compiled if they are new."""
        while True:
            slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
            got = self.keys[slot]
            off = np.flatnonzero(got != key)
            new: list[int] = []
            while len(off):
                empty = got[off] == -1
                new += key[off[empty]].tolist()
                off = off[~empty]
                slot[off] = (slot[off] + 1) & self.mask
                got[off] = self.keys[slot[off]]
                off = off[got[off] != key[off]]
            if not new:
                return slot
            for k in set(new):
                self._insert(k, *self.step(*divmod(k, self.n_classes)))
                self.known += 1
                if 2 * self.known > len(self.keys):
                    old = self.keys, self.to, self.emit
                    self._table(2 * len(self.keys))
                    some = np.flatnonzero(old[0] != -1)
                    for x in zip(*(a[some].tolist() for a in old), strict=True):
                        self._insert(*x)

    def lanes(self, c: np.ndarray, fresh: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs all chunks in step: the states they leave and the tokens they emit. c: classes; fresh: where nothing before matters."""
        order = np.argsort(-size, kind="stable")
        at, now, tokens = start[order], state[order].astype(np.int64), np.zeros(len(order), np.int64)
        many = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
        for n in many.tolist():
            where = at[:n]
            now[:n][fresh[where]] = 0
            slot = self.find(now[:n] * self.n_classes + c[where])
            now[:n] = self.to[slot]
            tokens[:n] += self.emit[slot]
            at[:n] += 1
        out, emitted = np.empty_like(now), np.empty_like(tokens)
        out[order], emitted[order] = now, tokens
        return out, emitted

    def chunks(self, fresh: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and sizes of the chunks of a block of n characters, and which of them go on from the one before."""
        free = np.flatnonzero(fresh)
        at = np.searchsorted(free, np.arange(0, n, CHUNK))
        start = np.unique(np.concatenate([rows, free[at[at < len(free)]], [0]]))
        size = np.diff(np.append(start, n))
        parts = -(-size // LONGEST)
        index = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(start, parts) + index * LONGEST
        return begin, np.diff(np.append(begin, n)), index > 0

    def run(self, c: np.ndarray, fresh: np.ndarray, rows: np.ndarray, entered: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Chunk starts, tokens of each chunk, and the state after a block that is entered in a state."""
        start, size, chained = self.chunks(fresh, rows, len(c))
        state = np.zeros(len(start), np.int64)
        state[0] = entered
        out, tokens = self.lanes(c, fresh, start, size, state)
        for _ in range(ROUNDS):
            off = np.flatnonzero(chained & (state != np.append(0, out[:-1])))
            if not len(off):
                return start, tokens, int(out[-1])
            state[off] = out[off - 1]
            out[off], tokens[off] = self.lanes(c, fresh, start[off], size[off], state[off])
        open_ = np.unique(np.cumsum(~chained)[chained & (state != np.append(0, out[:-1]))])
        chain = np.cumsum(~chained)
        for k in open_.tolist():
            one = np.flatnonzero(chain == k)
            self.compose(c, fresh, start[one], size[one], state[one[:1]], out, tokens, one)
        return start, tokens, int(out[-1])

    def compose(self, c, fresh, start, size, entered, out, tokens, one) -> None:
        """Settles one chain by a prefix scan over its chunks' maps, or chunk by chunk if the maps have too many states."""
        states, maps, emits = [int(entered[0])], [], []
        while len(maps) < len(states) <= WIDTH:
            to, emit = self.lanes(c, fresh, start, size, np.full(len(start), states[len(maps)], np.int64))
            maps.append(to)
            emits.append(emit)
            states += sorted(set(to.tolist()) - set(states))
        if len(states) > WIDTH:
            for i, lane in enumerate(one.tolist()):
                to, emit = self.lanes(c, fresh, start[i : i + 1], size[i : i + 1], entered)
                out[lane], tokens[lane], entered = to[0], emit[0], to
            return
        names = np.array(states)
        order = np.argsort(names)
        after = order[np.searchsorted(names[order], np.stack(maps, axis=1))]  # chunk x state: the number of the state that is left
        stride = 1
        while stride < len(after):  # after[i] comes to be the map of all chunks up to i
            joined = after.copy()
            joined[stride:] = np.take_along_axis(after[stride:], after[:-stride], axis=1)
            after, stride = joined, 2 * stride
        left = after[:, 0]
        into = np.append(0, left[:-1])
        out[one], tokens[one] = names[left], np.stack(emits, axis=1)[np.arange(len(one)), into]

    def characters(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)

    def marked(self, c: np.ndarray, rows: np.ndarray, before: bool = False) -> np.ndarray:
        """Where nothing before matters: at rows, at marks after other characters, and after characters that no piece has."""
        fresh = np.zeros(len(c), bool)
        mark, odd = c == self.mark, c < 4
        fresh[1:] = mark[1:] & ~mark[:-1] | odd[:-1]
        fresh[:1] = before
        fresh[rows] = True
        return fresh

    def rows(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each row of a block."""
        some = np.diff(offs) > 0
        counts = np.zeros(len(some), np.int64)
        if not some.any():
            return counts
        self.tidy()
        try:
            buf.tobytes().decode()
        except UnicodeDecodeError:
            texts = [buf[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        spaced = np.insert(buf, offs[:-1][some], ord(BLANK))  # the model's own mark before each text
        offs = offs + np.concatenate([[0], np.cumsum(some)])
        chars = self.characters(spaced.tobytes())
        first = np.cumsum(np.concatenate([[0], (spaced & 0xC0) != 0x80]))[offs[:-1][some]]
        c = self.class_of[chars]
        start, tokens, _ = self.run(c, self.marked(c, first), first)
        counts[some] = np.add.reduceat(tokens, np.searchsorted(start, first))
        return counts

    def long(self, data: bytes, block: int = BLOCK) -> int:
        """Tokens of one text, block by block: the state that a block leaves is entered in the next."""
        if not data:
            return 0
        total, state, at, before, data = 0, 0, 0, NONE, BLANK.encode() + data
        while at < len(data):
            self.tidy(state == 0)
            end = min(at + block, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            c = self.class_of[self.characters(data[at:end])]
            first = at == 0 or before < 4 or c[0] == self.mark != before
            _, tokens, state = self.run(c, self.marked(c, np.zeros(0, np.int64), first), np.zeros(0, np.int64), state)
            total, before, at = total + int(tokens.sum()), int(c[-1]), end
        return total

    def tidy(self, free: bool = True) -> None:
        if free and len(self.states) > STATES:
            self.clear()


def counter(vocabulary):
    """vocabulary: a broadcast one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_state()
        if kept.get("transducer_of") != id(vocabulary.value):
            kept["transducer"], kept["transducer_of"], kept["vocabulary"] = Transducer(vocabulary.value), id(vocabulary.value), vocabulary.value
        machine = kept["transducer"]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            for row, end, buf, offs in pieces(texts):
                tokens = [machine.long(buf.tobytes())] if len(buf) > BLOCK else machine.rows(buf, offs)
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), n_bytes.slice(row, end - row), pa.array(np.asarray(tokens, np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; the vocabulary is read on the driver and sent, its states are compiled by the tasks."""
    with open(model_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(read_model(f.read()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(counter(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
