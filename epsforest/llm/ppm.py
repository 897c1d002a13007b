"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts up to ORDER bytes. In a context that has seen ``d`` symbols ``t`` times, a seen symbol
has probability ``count / (t + d)``; else the coder escapes with ``d / (t + d)`` to the context's suffix, where symbols that
the longer context has seen are excluded. Below the empty context all bytes that are left are alike. 0xFF, which UTF-8
never has, stands for the end of a text, and for what precedes it.

Pretrained: contexts are counted over all training texts, and every context that stands there LEAST times is one of the
trie, whatever the corpus. The counts stay distributed: what a symbol's probability needs of the orders 3 and 4 shares the
last three bytes of the context, so grams are dealt by these (at most 2**16 grams a key, so none is hot) and each part works
out its probabilities, grams that only scored texts have included. Orders 0 to 2 are broadcast: at most 2**24 grams of three
bytes, whatever the corpus. The at most HEAD most frequent grams are broadcast with their probabilities; all others are joined.
Adaptive: the trie starts empty for each text and learns as it codes.

Beside it stands a unigram baseline over words. Counts of all words stay distributed; the at most 2**20 words with
``N / 2**20`` occurrences or more are broadcast, and the others are joined by their hash. Words and grams that are frequent in scored
texts only are in no broadcast table: their uses are counted, and such keys are dealt to several tasks.

Defined results: a null text is empty: one token (the end). A null doc_id counts as '' in the fold. Repeated rows are
scored alike, and are counted as often as they stand in training. Without any training text the byte model is uniform
and all tokens are unknown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epsforest.llm.textscan import LOWER, NOT_SPACE, U64, pieces, rows_of, span_hashes, spans
from epsforest.llm.token_counts import worker_state
from epsforest.operators.skew import split_join
from epsforest.runtime import cut

ORDER, END = 4, 0xFF
LEAST, HEAD = 2, 1 << 20
SLOTS = 22
#: Uses of a word or gram that a task gets at least before the key is split.
ROWS_A_KEY = 1 << 14


def padded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with ORDER ends before and one after; which positions are coded; each row's first coded position."""
    n, sizes = len(offs) - 1, np.diff(offs)
    out = np.full(len(buf) + n * (ORDER + 1), END, np.uint8)
    coded = np.ones(len(out), bool)
    firsts = offs[:-1] + ORDER + np.arange(n) * (ORDER + 1)
    for k in range(1, ORDER + 1):
        coded[firsts - k] = False
    text = coded.copy()
    text[firsts + sizes] = False
    out[text] = buf
    return out, coded, firsts


def gram_codes(out: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """The ORDER + 1 bytes up to each coded position, as one number."""
    code = out[ORDER:].astype(U64)
    for k in range(1, ORDER + 1):
        code |= out[ORDER - k : len(out) - k].astype(U64) << U64(8 * k)
    return code[coded[ORDER:]]


class Counter:
    """Counts of numbers, compacted as they come."""

    def __init__(self) -> None:
        self.keys, self.counts, self.open, self.n = np.zeros(0, U64), np.zeros(0, np.int64), [], 0

    def add(self, x: np.ndarray) -> None:
        keys, counts = np.unique(x, return_counts=True)
        self.open.append((keys, counts))
        self.n += len(keys)
        if self.n > 1_000_000 + len(self.keys):
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([self.keys, *(k for k, _ in self.open)])
        counts = np.concatenate([self.counts, *(c for _, c in self.open)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.open, self.n = [], 0
        return self.keys, self.counts


def _words(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = spans(low, offs, NOT_SPACE)
    return span_hashes(low, starts, ends), rows_of(starts, offs)


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte grams (kind 0) and word hashes (kind 1) of a task's training texts, in pieces of bounded size."""
    counters = [Counter(), Counter()]

    def out() -> Iterator[pa.RecordBatch]:
        for kind, c in enumerate(counters):
            keys, counts = c.close()
            for lo in range(0, len(keys), 200_000):
                part = slice(lo, lo + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(counts[part])], ["kind", "key", "n"])
            counters[kind] = Counter()

    for batch in batches:
        for _, _, buf, offs in pieces(batch.column(0)):
            low = LOWER[buf]
            bytes_, coded, _ = padded(low, offs)
            counters[0].add(gram_codes(bytes_, coded))
            counters[1].add(_words(low, offs)[0])
            if max(len(c.keys) for c in counters) > 4_000_000:
                yield from out()
    yield from out()


class Order:
    """The counts of one order: sorted (context, symbol) numbers with counts, and by context totals, symbols and what its suffix has left."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, below: Order | None) -> None:
        self.codes, self.counts = codes, counts.astype(np.float64)
        self.contexts, row = np.unique(codes >> U64(8), return_inverse=True)
        self.total = np.bincount(row, weights=self.counts, minlength=len(self.contexts))
        self.seen = np.bincount(row, minlength=len(self.contexts)).astype(np.float64)
        if below is not None and len(codes):
            suffix = np.searchsorted(below.contexts, self.contexts & below.mask)
            used = np.bincount(row, weights=below.counts[np.searchsorted(below.codes, codes & (below.mask << U64(8) | U64(0xFF)))], minlength=len(self.contexts))
            self.left, self.left_seen = below.total[suffix] - used, below.seen[suffix] - self.seen

    mask = U64(0)


def build(pairs: list[tuple[np.ndarray, np.ndarray]], first: int = 0, below: Order | None = None) -> list[Order]:
    """Orders ``first`` and on, from their sorted numbers and counts; ``below`` is the order before them."""
    out = []
    for k, (codes, counts) in enumerate(pairs, first):
        below = Order(codes, counts, below)
        below.mask = U64((1 << 8 * k) - 1)
        out.append(below)
    return out


def _at(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    pos = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return pos, table[pos] == x


def log_probabilities(orders: list[Order], keys: np.ndarray) -> np.ndarray:
    """log10 of the last symbol's probability after the bytes before it, for grams of ORDER + 1 bytes."""
    p = escape = before = None
    for k, o in enumerate(orders):
        code = keys & U64((1 << 8 * (k + 1)) - 1)
        pos, found = _at(o.codes, code)
        n = np.where(found, o.counts[pos], 0) if len(o.codes) else np.zeros(len(keys))
        if k == 0:
            escape = np.full(len(keys), 1 / max(1, 256 - len(o.codes)))
            t, d = (o.total[0], o.seen[0]) if len(o.codes) else (0.0, 1.0)
            p = np.where(n > 0, n, d * escape) / (t + d)
        elif len(o.codes):
            ctx, admitted = _at(o.contexts, code >> U64(8))
            admitted = admitted & (o.total[ctx] >= LEAST)
            left, left_seen, t, d = o.left[ctx], o.left_seen[ctx], o.total[ctx], o.seen[ctx]
            rest = np.maximum(left + left_seen, 1)
            escape = np.where(before > 0, before / rest, np.where(left_seen > 0, left_seen / rest, 1.0) * escape)
            p = np.where(admitted, np.where(n > 0, n, d * escape) / (t + d), p)
        before = n
    return np.log10(np.maximum(p, 1e-30))


def shards(low):
    """low: a broadcast of the numbers and counts of orders 0 to 2. Takes (shard, key, n) sorted by shard, whole shards a task; emits (key, n, logp)."""

    def solve(orders: list[Order], keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        known = n > 0
        codes, counts = keys[known], n[known]
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        three, row = np.unique(codes & U64(0xFFFFFFFF), return_inverse=True)
        high = build([(three, np.bincount(row, weights=counts, minlength=len(three))), (codes, counts)], 3, orders[2])
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(log_probabilities(orders + high, keys))], ["key", "n", "logp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, held, size = build(low.value), [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(3)])
            size += batch.num_rows
            if size > 500_000:
                shard, keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
                end = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                if end:
                    yield solve(orders, keys[:end].astype(U64), n[:end])
                held, size = [[shard[end:], keys[end:], n[end:]]], len(shard) - end
        if size:
            _, keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            yield solve(orders, keys.astype(U64), n)

    return run


class Grams:
    """Log probabilities of the head's grams: a table of slots, and a sorted list of those whose slot is taken."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray) -> None:
        """keys: the most frequent first."""
        slot = self.slot(keys)
        taken, first = np.unique(slot, return_index=True)
        self.keys, self.logp = np.full(1 << SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF), U64), np.zeros(1 << SLOTS)
        self.keys[taken], self.logp[taken] = keys[first], logp[first]
        more = np.ones(len(keys), bool)
        more[first] = False
        order = np.argsort(keys[more])
        self.more, self.more_logp = keys[more][order], logp[more][order]

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * U64(0x9E3779B97F4A7C15) >> U64(64 - SLOTS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.slot(keys)
        found, logp = self.keys[slot] == keys, self.logp[slot]
        rest = np.flatnonzero(~found)
        pos, ok = _at(self.more, keys[rest])
        found[rest[ok]], logp[rest[ok]] = True, self.more_logp[pos[ok]]
        logp[~found] = 0
        return found, logp


def scorer(model):
    """model: a broadcast of (grams, their logs, head hashes, head counts). Emits each row's sums, and the words and grams outside the heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_state()
        grams, gram_logs, head, head_counts = model.value
        if kept.get("ppm_of") != id(model.value):
            kept["ppm"], kept["ppm_of"], kept["ppm_model"] = Grams(grams, gram_logs), id(model.value), model.value
        machine, logs = kept["ppm"], np.log10(head_counts + 0.5)
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, end, buf, offs in pieces(batch.column(1)):
                n, low = end - row, LOWER[buf]
                bytes_, coded, _ = padded(low, offs)
                codes = gram_codes(bytes_, coded)
                ends = offs[1:] + np.arange(1, n + 1)
                found, logp = machine.find(codes)
                score = np.add.reduceat(logp, np.concatenate([[0], ends[:-1]]).astype(np.int64)) if n else np.zeros(0)
                lost = np.flatnonzero(~found)
                upto = np.concatenate([[0], np.searchsorted(lost, ends)]).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(upto), pa.array(codes[lost].view(np.int64)))
                words, at = _words(low, offs)
                pos = np.minimum(np.searchsorted(head, words), max(0, len(head) - 1))
                known = head[pos] == words if len(head) else np.zeros(len(words), bool)
                sums = np.bincount(at[known], weights=logs[pos[known]], minlength=n).astype(np.float64)  # of nothing it is whole numbers
                in_head = np.bincount(at[known], minlength=n)
                rest = np.bincount(at[~known], minlength=n)
                tails = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)), pa.array(words[~known].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_id + np.arange(n)), batch.column(0).slice(row, n), pa.array(np.bincount(at, minlength=n) + 1), pa.array(in_head), pa.array(sums), pa.array(score), tails, tail],
                    ["row_id", "doc_id", "n_tokens", "in_head", "head_sum", "score", "rest", "tail"],
                )
                row_id += n

    return run


def fold(modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def train(learn: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distributed tables: (key, n, logp) of all grams of both, learnt from ``learn``; (word, n) of the word hashes of ``learn``."""
    kinds = "kind int, key long, n long"
    seen, unseen = learn.select("text").mapInArrow(gather, kinds), others.select("text").mapInArrow(gather, kinds).where("kind = 0").withColumn("n", F.lit(0).cast("long"))
    counts = cut(seen.unionByName(unseen).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    grams, words = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select(F.col("key").alias("word"), "n")
    low = []
    for k in range(3):  # at most 2**8, 2**16 and 2**24 rows
        got = grams.where("n > 0").groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        keys, n = got["key"].to_numpy().astype(U64), got["n"].to_numpy()
        order = np.argsort(keys)
        low.append((keys[order], n[order].astype(np.int64)))
    low = learn.sparkSession.sparkContext.broadcast(low)
    dealt = grams.select(F.shiftright("key", 8).bitwiseAND(0xFFFFFF).alias("shard"), "key", "n").repartition("shard").sortWithinPartitions("shard")
    return cut(dealt.mapInArrow(shards(low), "key long, n long, logp double"), "logs"), words


def is_frequent(logs: DataFrame, most: int) -> Column:
    """Whether a gram is among the most frequent ones, at most so many."""
    level = F.floor(4 * F.log2(F.col("n") + 1))
    left, least = most, None
    for row in sorted(logs.groupBy(level.alias("level")).count().collect(), reverse=True):  # a few hundred rows
        left -= row["count"]
        if left < 0:
            break
        least = row["level"]
    return F.lit(False) if least is None else level >= least


def frequent(logs: DataFrame, most: int) -> DataFrame:
    """The most frequent grams, at most so many."""
    return logs.where(is_frequent(logs, most))


def _looked_up(uses: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The inner join of uses with a table of one row a key; keys with many uses go to several tasks."""
    counts = cut(uses.groupBy(key).agg(F.count("*").alias("n")), "uses")
    return split_join(uses, table, [key], counts, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], rows=ROWS_A_KEY)


def score_documents(docs: DataFrame, modulus: int = 5, held: int = 1) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text); learns from rows whose crc32(doc_id) mod ``modulus`` is not ``held``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = texts.where(fold(modulus) != held)
    logs, words = train(learn, texts.where(fold(modulus) == held))
    top = frequent(logs, HEAD).toArrow()  # at most HEAD rows
    often = np.argsort(-top["n"].to_numpy(), kind="stable")
    grams, gram_logs = top["key"].to_numpy().astype(U64)[often], top["logp"].to_numpy()[often]
    ends = learn.count()
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    head = words.where(F.col("n") >= max(2, -(-n // HEAD))).toArrow()  # at most HEAD rows
    keys, counts = head["word"].to_numpy().astype(np.int64).view(U64), head["n"].to_numpy()
    order = np.argsort(keys)
    model = docs.sparkSession.sparkContext.broadcast((grams, gram_logs, keys[order], counts[order].astype(np.float64)))
    scored = cut(texts.mapInArrow(scorer(model), "row_id long, doc_id long, n_tokens long, in_head long, head_sum double, score double, rest array<long>, tail array<long>"), "scored")
    rest = _looked_up(scored.select("row_id", F.explode("rest").alias("word")), words, "word")
    rest = rest.groupBy("row_id").agg(F.sum(F.log10(F.col("n") + 0.5)).alias("rest_sum"), F.count("n").alias("in_rest"))
    tail = _looked_up(scored.select("row_id", F.explode("tail").alias("key")), logs.select("key", "logp"), "key")
    tail = tail.groupBy("row_id").agg(F.sum("logp").alias("tail_sum"))
    scored = scored.withColumn("in_no_head", F.size("rest"))
    out = scored.drop("rest", "tail").join(rest, "row_id", "left").join(tail, "row_id", "left")
    out = out.withColumn("score", F.col("score") + F.coalesce("tail_sum", F.lit(0.0)))
    total = math.log10(n + 0.5 * (v + 1))
    never = F.col("in_no_head") - F.coalesce("in_rest", F.lit(0))  # words that training does not have
    base = F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) + never * math.log10(0.5) + math.log10(ends + 0.5) - F.col("n_tokens") * F.lit(total)
    known = F.col("in_head") + F.coalesce("in_rest", F.lit(0)) + F.lit(int(ends > 0))
    return out.select("doc_id", (fold(modulus) == held).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


class Trie:
    """The same model symbol by symbol, for the adaptive mode and as a plain version to test against."""

    def __init__(self, order: int = ORDER) -> None:
        self.order, self.counts = order, {}

    def probability(self, history: bytes, symbol: int) -> float:
        p, excluded = 1.0, frozenset()
        for k in range(min(self.order, len(history)), -1, -1):
            seen = self.counts.get(history[len(history) - k :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            t, d = sum(left.values()), len(left)
            if symbol in left:
                return p * left[symbol] / (t + d)
            if d:
                p *= d / (t + d)
            excluded = excluded | seen.keys()
        return p / max(1, 256 - len(excluded))

    def update(self, history: bytes, symbol: int) -> None:
        for k in range(min(self.order, len(history)) + 1):
            seen = self.counts.setdefault(history[len(history) - k :], {})
            seen[symbol] = seen.get(symbol, 0) + 1

    def code(self, text: bytes, learn: bool) -> float:
        """log10 probability of a text and its end."""
        data, total = bytes([END]) * self.order + text + bytes([END]), 0.0
        for i in range(self.order, len(data)):
            history = data[i - self.order : i]
            total += math.log10(self.probability(history, data[i]))
            if learn:
                self.update(history, data[i])
        return total


def score_adaptive(docs: DataFrame) -> DataFrame:
    """doc_id, score: each text coded by a trie that learns from that text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [Trie().code(LOWER[np.frombuffer((t or "").encode(), np.uint8)].tobytes(), True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
