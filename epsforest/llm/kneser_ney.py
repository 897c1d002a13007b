"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Training counts the trigrams of all trusted texts of the training half and derives everything else by grouping and joining
on words and n-gram keys: continuation counts of bigrams and words, the discounts from counts of counts, and per context the
mass that goes to the next shorter one. Nothing of it is bounded by a sample; no table is whole on the driver or in a task.

An interpolated probability is a sum of backed-off ones, so its logarithm telescopes: a text's log10 probability is the sum of one
weight for each of its words, bigrams and trigrams that training has, and a constant for each token. A bigram's
weight joins what it adds as (v, w) to its word's probability and what it leaves as the context (u, v); n-grams that training does
not have weigh nothing. Scoring so needs no order of lookups: the at most ``HEAD`` most frequent n-grams are broadcast with
their weights, and a filter of ``FILTER`` bits tells most of those that training lacks (what it lets through by mistake is found
absent later). All other n-grams of a text meet the weights in buckets: packed arrays of both sides are dealt by key, a bucket with many uses
to several tasks, and the sums of equal texts (by a 64-bit hash) are added up. Trigrams are counted in packed arrays too.
Texts are read anew for each round of buckets rather than kept as keys, so that disk holds one round's share of them.

Each document gets its log10 probability per token. For each language, the threshold is a quantile of the trusted
documents of the other half, which training did not see, read off an exact histogram; a language with fewer than ``LEAST_CALIBRATION`` of them
uses the histogram of all. A document whose log-perplexity is above the threshold of its language is rejected.

Defined results: a null or empty text has one token, the end, and is rejected. A null language is a language of its own.
Labels without quality or for absent documents are ignored; repeated labels count once. Without any trusted text every
document with words is kept. Rows that share a doc_id are scored each by its own text; repeated trusted rows train once.
A caller may ask for a model of at most ``trusted`` texts (and ``TRUSTED_CHARS`` characters); the queries and the pipeline do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from epsforest.llm.ppm import frequent
from epsforest.llm.textscan import NOT_SPACE, U64, mix, pieces, release, spans, tidy, unused, word_hashes
from epsforest.runtime import brief_shuffles, cut, cut_by, discard, small_batches

#: Characters of a model whose texts the caller bounds.
TRUSTED_CHARS = 16_000_000
#: N-grams that are broadcast; words that a join broadcasts at most; n-grams, or uses of them, of a bucket; n-grams of a pack.
HEAD, MOST_WORDS, BUCKET, PACK = 1 << 20, 1 << 18, 1 << 19, 1 << 20
#: Bits of a key that the filter looks at, and those of them that are the same in a part of it.
FILTER, PART = 27, 12
#: Rounds in which trigrams meet their bigrams and their contexts, and texts their weights: only one round's shuffle is on disk at a time. Texts
#: take more rounds, up to MOST_ROUNDS, until one has no more uses than there are weights.
ROUNDS, MOST_ROUNDS = 4, 16
QUANTILE, LEAST_CALIBRATION, BIN = 0.995, 30, 0.01
START, STOP = U64(0x5D0A11CE0FF1CE01), U64(0xE0F0D0C0B0A09081)


def joined(*parts: np.ndarray) -> np.ndarray:
    """The key of an n-gram of word hashes, or of the key of its first words and the others; its class is the last word's."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * U64(0xD6E8FEB86659FD93) + p)
        h &= ~U64(MOST_ROUNDS - 1)
        h |= p & U64(MOST_ROUNDS - 1)
    return h


def of_round(keys: np.ndarray, rounds: int, round_: int) -> np.ndarray:
    """Where the keys of a round stand: those of its classes, the last bits of keys."""
    return np.flatnonzero(keys & U64(rounds - 1) == U64(round_))


def sequences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, each as START START words STOP; where the words begin; tokens of each row, the end included."""
    starts, ends = spans(buf, offs, NOT_SPACE)
    n = len(offs) - 1
    counts = np.diff(np.searchsorted(starts, offs))
    out = np.full(len(starts) + 3 * n, START, U64)
    firsts = np.cumsum(counts + 3) - (counts + 3) + 2
    word = np.ones(len(out), bool)
    word[firsts - 1] = word[firsts - 2] = word[firsts + counts] = False
    out[word] = word_hashes(buf, starts, ends)
    out[firsts + counts] = STOP
    return out, firsts, counts + 1


def _tokens(out: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    at = np.ones(len(out), bool)
    at[firsts - 1] = at[firsts - 2] = False
    return np.flatnonzero(at)


def split_up(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Each bucket that occurs, and the bytes of its part of the columns."""
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted in time linear in the rows
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    buckets = bucket[first]
    parts = [[x.tobytes() for x in np.split(c[order], first[1:])] for c in columns]
    yield from zip(buckets.tolist(), map(list, zip(*parts, strict=True)), strict=True)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def values_of(table: pa.Table, name: str, kind) -> np.ndarray:
    """The arrays of all rows in a binary column, one after the other; nulls are empty."""
    return np.frombuffer(b"".join(x for x in table[name].to_pylist() if x), kind)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets, a multiple of MOST_ROUNDS, of keys: each has keys of one class, its number modulo MOST_ROUNDS."""
    return (keys // U64(MOST_ROUNDS) % U64(buckets // MOST_ROUNDS) * U64(MOST_ROUNDS) + keys % U64(MOST_ROUNDS)).astype(np.int64)


def buckets_for(n: int, most: int) -> int:
    return MOST_ROUNDS * max(1, -(-n // (most * MOST_ROUNDS)))


def counted(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct trigrams in the order of their keys, and their counts."""
    keys = joined(u, v, w)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    n = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    order = order[first]
    return keys[first], u[order], v[order], w[order], n


TRIGRAMS = "bucket int, u binary, v binary, w binary, n binary"


def trigrams(buckets: int, round_: int):
    """Packs the trigrams of a round's buckets, those of the last two words, with their counts."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in "uvwn")])

    def packs(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        _, u, v, w, n = counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
        u, v, w, n = (x[order] for order in [np.argsort(w)] for x in (u, v, w, n))  # equal words side by side compress
        return batch_of([(b, *x) for b, x in split_up(bucket_of(joined(v, w), buckets), [u, v, w, n])], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, buf, offs in pieces(batch.column(0)):
                out, firsts, _ = sequences(buf, offs)
                at = _tokens(out, firsts)
                at = at[of_round(out[at], ROUNDS, round_)]
                held.append((out[at - 2], out[at - 1], out[at], np.ones(len(at), np.int64)))
                n += len(at)
                if n >= PACK:
                    yield packs(held)
                    held, n = [], 0
        if n:
            yield packs(held)

    return tidy(run)


def unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    return counted(*(values_of(table, c, U64) for c in "uvw"), values_of(table, "n", np.int64))


def pairs_of(table: pa.Table) -> pa.Table:
    """(bucket, v, w, c2, once): a bucket's bigrams with the number of words before them; its first row has the numbers of its trigrams with count 1 to 4."""
    _, _, v, w, n = unpacked(table)
    keys, first, c2 = np.unique(joined(v, w), return_index=True, return_counts=True)
    once = pa.array([np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()] + [None] * (len(keys) - 1), pa.list_(pa.int64()))
    bucket = np.full(len(keys), table["bucket"][0].as_py(), np.int32)
    return pa.table([bucket, v[first].view(np.int64), w[first].view(np.int64), c2, once], ["bucket", "v", "w", "c2", "once"])


CONTEXTS = "round int, bucket int, uv binary, w binary, c binary, p2 binary, vw binary, b binary"


def by_context(buckets: int):
    """Of a bucket's trigrams and bigrams: trigrams with count and bigram's probability in packs by their context, and bigrams with their weight by themselves."""
    schema = pa.schema([("round", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("uv", "w", "c", "p2", "vw", "b"))])

    def run(grams: pa.Table, pairs: pa.Table) -> pa.Table:
        _, u, v, w, n = unpacked(grams)
        u, v, w, n = (x[order] for order in [np.argsort(w)] for x in (u, v, w, n))  # a trigram's key follows from its context and its word, which compresses
        keys = joined(*(pairs[c].to_numpy().astype(np.int64).view(U64) for c in "vw"))
        order = np.argsort(keys)
        p2 = pairs["p2"].to_numpy().astype(np.float32)[order][np.searchsorted(keys[order], joined(v, w))]
        uv = joined(u, v)
        rows = [(b % ROUNDS, b, *x, None, None) for b, x in split_up(bucket_of(uv, buckets), [uv, w, n, p2])]
        rows += [(b % ROUNDS, b, None, None, None, None, *x) for b, x in split_up(bucket_of(keys, buckets), [keys, pairs["b"].to_numpy().astype(np.float32)])]
        return pa.Table.from_batches([batch_of(rows, schema)])

    return run


WEIGHTS = "keys binary, data binary, level binary, levels array<long>"


def weighed_packs(keys: np.ndarray, values: np.ndarray, n: np.ndarray) -> pa.Table:
    """N-grams with their weights and the levels of their counts, in packs of bounded size with the number of n-grams of each level."""
    level = np.floor(4 * np.log2(n + 1.0)).astype(np.uint8)
    at = range(0, len(keys), PACK >> 4)
    columns = [[x[k : k + (PACK >> 4)].tobytes() for k in at] for x in (keys, values.astype(np.float32), level)]
    levels = pa.array([np.bincount(level[k : k + (PACK >> 4)]).tolist() for k in at], pa.list_(pa.int64()))
    return pa.table([*(pa.array(x, pa.binary()) for x in columns), levels], ["keys", "data", "level", "levels"])


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WEIGHTS of rows (key, value, n)."""
    for batch in batches:
        if batch.num_rows:
            yield from weighed_packs(batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy(), batch.column(2).to_numpy()).to_batches()


def weigher(d3: list[float]):
    """WEIGHTS of a bucket's trigrams, and of the bigrams that are their contexts."""
    off = np.array([d3[0], *d3])

    def run(table: pa.Table) -> pa.Table:
        uv, w, vw = (values_of(table, c, U64) for c in ("uv", "w", "vw"))
        c, p2, b = values_of(table, "c", np.int64), values_of(table, "p2", np.float32).astype(float), values_of(table, "b", np.float32).astype(float)
        contexts, at = np.unique(np.concatenate([uv, vw]), return_inverse=True)
        at, own = at[: len(uv)], at[len(uv) :]
        taken = off[np.minimum(c, 3)]
        rest, total = (np.bincount(at, weights=x, minlength=len(contexts)) for x in (taken, c))
        value = np.log10(1 + (c - taken) / rest[at] / p2)
        left = np.log10(np.where(total > 0, rest, 1) / np.maximum(total, 1)) + np.bincount(own, weights=b, minlength=len(contexts))
        return weighed_packs(np.concatenate([joined(uv, w), contexts]), np.concatenate([value, left]), np.concatenate([c, total.astype(np.int64)]))

    return run


def discounts(counts: DataFrame, column: str = "c") -> list[float]:
    """Discounts of counts 1, 2 and more, from the counts of counts."""
    n = [0] * 5
    for r in counts.where(F.col(column) <= 4).groupBy(column).count().collect():
        n[int(r[0])] = r["count"]
    return _discounts(n)


def _discounts(n: list[int]) -> list[float]:
    if not n[1] or not n[2]:
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.0 for k in (1, 2, 3)]
    return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]


def _off(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _with_words(grams: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """grams with the columns of ``words`` (``key``, .., n) joined: the at most MOST_WORDS most frequent ones are broadcast, and the others, few rows each, shuffled."""
    least = frequent(words, MOST_WORDS).agg(F.min("n")).first()[0]
    head = F.lit(False) if least is None else F.col("n") >= least
    top, other = F.broadcast(words.where(head).drop("n")), words.where(~head).drop("n")
    return grams.join(top, key).unionByName(grams.join(top, key, "left_anti").join(other, key))


def weights(texts: DataFrame) -> tuple[list[DataFrame], float]:
    """Tables (WEIGHTS) of all words, bigrams and trigrams of the texts (text,): log10 weights, and levels of counts to rank them by; and an unknown word's probability."""
    texts = cut(texts.select("text"), "trusted")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(size, 6 * BUCKET)  # words of about six bytes
    found = "bucket int, v long, w long, c2 long, once array<long>"
    counts = [cut(texts.mapInArrow(trigrams(buckets, k), TRIGRAMS).groupBy("bucket").applyInArrow(pairs_of, found), "pairs") for k in range(ROUNDS)]
    pairs = _all(counts)
    d3 = _discounts([0, *(x or 0 for x in pairs.where("once is not null").agg(*(F.sum(F.col("once")[k]) for k in range(4))).first())])
    d2 = discounts(pairs, "c2")
    after = pairs.groupBy(F.col("w").alias("x")).agg(F.count("*").alias("c"), F.sum("c2").alias("n_w"))
    before = pairs.groupBy(F.col("v").alias("x")).agg(F.sum("c2").alias("n_v"), F.sum(_off(F.col("c2"), d2)).alias("off"))
    words = cut(after.join(before, "x", "full"), "words")
    d1 = discounts(words)
    all_, off_all, n = words.agg(F.sum("c"), F.sum(F.when(F.col("c").isNotNull(), _off(F.col("c"), d1))), F.count("c")).first()
    floor = (off_all / all_) / (n + 1) if all_ else 1.0
    p1 = (F.col("c") - _off(F.col("c"), d1)) / F.lit(float(all_ or 1)) + F.lit(floor)
    gamma = F.col("off") / F.col("n_v")  # all counts of a context's bigrams are its trigrams

    ends = words.where("c is not null").select(F.col("x").alias("w"), p1.alias("p1"), F.col("n_w").alias("n"))
    contexts = words.where("n_v is not null").select(F.col("x").alias("v"), gamma.alias("g2"), F.col("n_v").alias("all2"), F.col("n_v").alias("n"))
    a2, rest = (F.col("c2") - _off(F.col("c2"), d2)) / F.col("all2"), F.col("g2") * F.col("p1")
    weighed = _with_words(_with_words(pairs.select("bucket", "v", "w", "c2"), ends, "w"), contexts, "v")
    weighed = weighed.select("bucket", "v", "w", (a2 + rest).cast("float").alias("p2"), F.log10(1 + a2 / rest).cast("float").alias("b"))
    by_round = cut_by(weighed.withColumn("round", F.col("bucket") % ROUNDS), "weighed", "round", ROUNDS)
    for x in counts:
        discard(x)
    own = F.coalesce(F.log10(p1 / F.lit(floor)), F.lit(0.0)) + F.coalesce(F.log10(gamma), F.lit(0.0))
    ones = words.select(F.col("x").alias("key"), own.cast("float").alias("value"), (F.coalesce("n_w", F.lit(0)) + F.coalesce("n_v", F.lit(0))).alias("n"))
    parts = [cut(ones.mapInArrow(packed_rows, WEIGHTS), "weights")]
    discard(words)
    packs = []
    for k, bigrams in enumerate(by_round):
        grams = texts.mapInArrow(trigrams(buckets, k), TRIGRAMS).groupBy("bucket")
        packs.append(cut_by(grams.cogroup(bigrams.groupBy("bucket")).applyInArrow(by_context(buckets), CONTEXTS), "packs", "round", ROUNDS))
        discard(bigrams)  # as packs grow, what they are made of goes
    discard(texts)
    for some in zip(*packs, strict=True):
        parts.append(cut(_all(list(some)).groupBy("bucket").applyInArrow(weigher(d3), WEIGHTS), "weights"))
        for x in some:
            discard(x)
    return parts, floor


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def levels_of(table: DataFrame) -> dict[int, int]:
    """The number of n-grams of each level that occurs."""
    counts = table.select(F.posexplode("levels").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()  # at most 253 rows
    return {r["level"]: r["n"] for r in counts if r["n"]}


def least_level(levels: dict[int, int], most: int) -> int:
    """The least level of the most frequent n-grams, at most ``most``; above all levels if there are none."""
    left, least = most, 256
    for level in sorted(levels, reverse=True):
        left -= levels[level]
        if left < 0:
            break
        least = level
    return least


def frequent_weights(least: int):
    """(keys, data) of the n-grams of WEIGHTS that have this level or more."""
    schema = pa.schema([("keys", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for keys, data, level in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                some = np.frombuffer(level, np.uint8) >= least
                if some.any():
                    rows.append((np.frombuffer(keys, U64)[some].tobytes(), np.frombuffer(data, np.float32)[some].tobytes()))
            yield batch_of(rows, schema)

    return tidy(run)


def dealt_weights(least: int, buckets: int):
    """The n-grams of WEIGHTS below this level by bucket, as round, bucket, narrowed keys and data."""
    schema = pa.schema([("round", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("data", pa.binary())])

    def packs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, data = (np.concatenate(x) for x in zip(*held, strict=True))
        return batch_of([(b % ROUNDS, b, *x) for b, x in split_up(bucket_of(keys, buckets), [narrowed(keys), data])], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for keys, data, level in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                some = np.frombuffer(level, np.uint8) < least
                held.append((np.frombuffer(keys, U64)[some], np.frombuffer(data, np.float32)[some]))
                n += len(held[-1][0])
                if n >= PACK:
                    yield packs(held)
                    held, n = [], 0
        if n:
            yield packs(held)

    return tidy(run)


def indexed(table: pa.Table) -> dict[str, np.ndarray]:
    """Sorted keys with their values, and where the keys of each leading part start."""
    keys, values = values_of(table, "keys", U64), values_of(table, "data", np.float32)
    order = np.argsort(keys)
    return {"keys": keys[order], "values": values[order]} | _starts(keys[order])


def _starts(keys: np.ndarray) -> dict[str, np.ndarray]:
    shift = 64 - max(1, len(keys).bit_length())
    return {"starts": np.searchsorted(keys, np.arange(1 << 64 - shift, dtype=U64) << U64(shift)).astype(np.int32), "shift": np.array([shift], U64)}


def _found(model: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key, or 0, and whether the model has it."""
    keys = model["keys"]
    if not len(keys):
        return np.zeros(len(x)), np.zeros(len(x), bool)
    at = model["starts"][x >> model["shift"][0]]
    past = at == len(keys)
    at[past] = 0
    here = keys[at]
    hit = here == x
    open_ = np.flatnonzero((here < x) & ~past)
    while len(open_):  # keys of a part are few
        at[open_] += 1
        open_ = open_[at[open_] < len(keys)]
        here = keys[at[open_]]
        hit[open_] = here == x[open_]
        open_ = open_[here < x[open_]]
    values = np.zeros(len(x))
    values[hit] = model["values"][at[hit]]
    return values, hit


def train(texts: DataFrame) -> dict[str, np.ndarray]:
    """All weights as sorted arrays, for texts (text,) that are few."""
    parts, floor = weights(texts)
    return indexed(_all(parts).select("keys", "data").toArrow()) | {"floor": np.array([floor])}


def fragments(least: int):
    """The filter's bits of a task's keys below a level: (part, bits) with the sorted places in a part."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        places = np.sort(np.concatenate(held))
        places = places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places
        part = places >> np.uint32(FILTER - PART)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        low = (places & np.uint32((1 << FILTER - PART) - 1)).astype(np.uint16)
        bits = [x.tobytes() for x in np.split(low, first[1:])] if len(first) else []
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(bits, pa.binary())], ["part", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for keys, level in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                some = np.frombuffer(keys, U64)[np.frombuffer(level, np.uint8) < least]
                held.append((some >> U64(64 - FILTER)).astype(np.uint32))
                n += len(held[-1])
                if n > 4 * PACK:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    return tidy(run)


def united(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << FILTER - PART, np.uint8)
    for x in table["bits"].to_pylist():
        bits[np.frombuffer(x, np.uint16)] = 1
    return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def bit_filter(table: DataFrame, least: int) -> np.ndarray:
    """2**FILTER bits, whatever the table: those of the leading bits of its keys below a level are set."""
    got = table.select("keys", "level").mapInArrow(fragments(least), "part int, bits binary").groupBy("part").applyInArrow(united, "part int, bits binary").toArrow()
    out = np.zeros((1 << PART, 1 << FILTER - PART - 3), np.uint8)
    for part, bits in zip(got["part"].to_pylist(), got["bits"], strict=True):
        out[part] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.reshape(-1)


def keys_of(buf: np.ndarray, offs: np.ndarray, rounds: int = 1, round_: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys, of one of the rounds, of all n-grams whose weights make up the rows' log10 probabilities, their rows, and tokens of each row."""
    out, firsts, counts = sequences(buf, offs)
    at = _tokens(out, firsts)
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    if rounds > 1:
        some = of_round(out[at], rounds, round_)
        at, row = at[some], row[some]
        w, v = out[at], out[at - 1]
        vw, uv = joined(v, w), joined(out[at - 2], v)
    else:
        w, pairs = out[at], joined(out[:-1], out[1:])
        vw, uv = pairs[at - 1], pairs[at - 2]
    once = np.arange(n if len(of_round(np.full(1, START, U64), rounds, round_)) else 0)
    heads = (np.full(len(once), START, U64), np.full(len(once), joined(np.full(1, START, U64), np.full(1, START, U64))[0], U64))
    return np.concatenate([w, vw, joined(uv, w), *heads]), np.concatenate([row, row, row, once, once]), counts


def passed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter does not exclude."""
    place = keys >> U64(64 - FILTER)
    return np.flatnonzero(bits[place >> U64(3)] >> (place & U64(7)).astype(np.uint8) & 1)


def look_up(model: dict[str, np.ndarray], buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability and tokens of each row by the weights of the model; keys of the n-grams that it lacks."""
    keys, rows, counts = keys_of(buf, offs)
    values, hit = _found(model, keys)
    return np.bincount(rows, weights=values, minlength=len(counts)) + counts * np.log10(model["floor"][0]), counts, keys[~hit]


def log_probabilities(model: dict[str, np.ndarray], buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability and number of tokens of each row, by a model with all weights."""
    return look_up(model, buf, offs)[:2]


def scorer(model, text: int, rest: list[int], buckets: int, names: list[str]):
    """Columns ``rest`` of each row, the number of tokens, the log10 probability of column ``text`` as far as the head knows it, and with a task's last row how many keys are left for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, uses = model.value, np.zeros(buckets, np.int64)
        held: list[pa.Array] | None = None

        def out(last: bool) -> pa.RecordBatch:
            none = pa.nulls(len(held[0]) - last, pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*held, pa.concat_arrays([none, pa.array([uses], pa.list_(pa.int64()))]) if last else none], names)

        for batch in batches:
            for row, end, buf, offs in pieces(batch.column(text)):
                if held:
                    yield out(False)
                score, counts, keys = look_up(tables, buf, offs)
                uses += np.bincount(bucket_of(keys[passed(tables["bits"], keys)], buckets), minlength=buckets)
                held = [*(batch.column(k).slice(row, end - row) for k in rest), pa.array(counts), pa.array(score)]
        if held:
            yield out(True)

    return tidy(run)


USES, VALUES, SUMS = ("bucket int, part int, pack long, keys binary, at binary", "bucket int, part int, keys binary, data binary", "pack long, ids binary, at binary, sums binary")


def steps_of(rows: np.ndarray) -> np.ndarray:
    """Ascending row numbers as the steps between them, which compress well."""
    return np.diff(rows, prepend=0).astype(np.uint32)


def rows_at(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint32), dtype=np.int64)


def narrowed(keys: np.ndarray) -> np.ndarray:
    """The bytes of keys that tell those of a bucket apart: six, as a bucket holds few of all."""
    return keys.view(np.uint8).reshape(-1, 8)[:, 2:]


def widened(some: bytes) -> np.ndarray:
    out = np.zeros((len(some) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(some, np.uint8).reshape(-1, 6)
    return out.view(U64).reshape(-1)


def uses_of(model, parts: np.ndarray, rounds: int, round_: int):
    """Packs the keys of (id, text) that a round's buckets may have, with their rows; a bucket's packs go round its parts. The ids of a pack's rows go in a bucket -1."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("pack", pa.int64()), ("keys", pa.binary()), ("at", pa.binary())])

    def packs(held: list[tuple[np.ndarray, np.ndarray]], ids: list[np.ndarray], pack: int) -> pa.RecordBatch:
        keys, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(rows, kind="stable")
        found = split_up(bucket_of(keys[order], len(parts)), [narrowed(keys[order]), rows[order].astype(np.uint32)])
        out = [(b, pack % int(parts[b]), pack, x, steps_of(np.frombuffer(y, np.uint32).astype(np.int64)).tobytes()) for b, (x, y) in found]
        return batch_of([*out, (-1, pack % (1 << 16), pack, np.concatenate(ids).tobytes(), None)], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, names, n, pack = model.value, [], [], 0, TaskContext.get().partitionId() << 32
        pack += TaskContext.get().partitionId()  # so that tasks begin with different parts
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, end, buf, offs in pieces(batch.column(1)):
                keys, rows, _ = keys_of(buf, offs, rounds, round_)
                some = passed(tables["bits"], keys)
                some = some[~_found(tables, keys[some])[1]]
                held.append((keys[some], rows[some] + sum(map(len, names))))
                names.append(ids[row:end])
                n += len(some)
                if n >= PACK:
                    yield packs(held, names, pack)
                    held, names, n, pack = [], [], 0, pack + 1
        if n:
            yield packs(held, names, pack)

    return tidy(run)


def values_in(parts: np.ndarray):
    """Packs (bucket, keys, data) for each of their buckets' parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = parts[batch.column(0).to_numpy()]
            out = batch.take(pa.array(np.repeat(np.arange(len(many)), many)))
            part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array(part.astype(np.int32)), out.column(1), out.column(2)], ["bucket", "part", "keys", "data"])

    return tidy(run)


def meet(uses: pa.Table, table: pa.Table) -> pa.Table:
    """What one part of a bucket adds to the rows of each pack; the ids of packs' rows as they are."""
    schema = pa.schema([("pack", pa.int64()), *((c, pa.binary()) for c in ("ids", "at", "sums"))])
    keys, values = np.concatenate([np.zeros(0, U64), *map(widened, table["keys"].to_pylist())]), values_of(table, "data", np.float32)
    order = np.argsort(keys)
    model = {"keys": keys[order], "values": values[order]} | _starts(keys[order])
    out = []
    for bucket, pack, some, at in zip(*(uses[c].to_pylist() for c in ("bucket", "pack", "keys", "at")), strict=True):
        if bucket < 0:
            out.append((pack, some, None, None))
            continue
        got, hit = _found(model, widened(some))
        rows, got = rows_at(at)[hit], got[hit]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        if len(first):
            out.append((pack, None, steps_of(rows[first]).tobytes(), np.add.reduceat(got, first).astype(np.float32).tobytes()))
    return pa.Table.from_batches([batch_of(out, schema)])


def added(table: pa.Table) -> pa.Table:
    """(id, sum) of a pack's rows."""
    ids = values_of(table, "ids", np.int64)
    rows = np.concatenate([np.zeros(0, np.int64), *(rows_at(x) for x in table["at"].to_pylist() if x)])
    sums = np.bincount(rows, weights=values_of(table, "sums", np.float32), minlength=len(ids))
    ids, at = np.unique(ids, return_inverse=True)
    return pa.table({"id": ids, "sum": np.bincount(at, weights=sums, minlength=len(ids)).astype(np.float64)})


def tail_sums(texts: DataFrame, tables: list[list[DataFrame]], n: int, model, uses: np.ndarray) -> DataFrame:
    """(id, sum) of the weights of the tables' ``n`` n-grams in all rows with the id; a table goes when its rounds are over. texts: (id, text); tables: those of each round, (bucket, keys, data); uses: keys for each bucket."""
    rounds = ROUNDS
    while rounds < MOST_ROUNDS and rounds * n < uses.sum():
        rounds *= 2
    parts = np.maximum(1, uses // BUCKET)
    sums = []
    for first, some in enumerate(tables):
        for k in range(first, rounds, ROUNDS):
            left = texts.mapInArrow(uses_of(model, parts, rounds, k), USES).groupBy("bucket", "part")
            right = _all(some).where(F.col("bucket") % rounds == k).mapInArrow(values_in(parts), VALUES).groupBy("bucket", "part")
            sums.append(cut(left.cogroup(right).applyInArrow(meet, SUMS).groupBy("pack").applyInArrow(added, "id long, sum double"), "sums"))
        for x in some:
            discard(x)
    out = cut(_all(sums), "sums")
    for x in sums:
        discard(x)
    return out


def _half(doc_id: str):
    """Half of the trusted documents, by their hash, train; the other half sets the thresholds."""
    return F.substring(F.md5(F.col(doc_id).cast("string")), -1, 1).isin(*"01234567")


def chosen(docs: DataFrame, good: DataFrame) -> DataFrame:
    """All trusted texts of the training half. docs: (doc_id, text); good: distinct (_t)."""
    texts = docs.where("length(text) > 0").join(good.where(_half("_t")), F.col("doc_id") == F.col("_t"), "left_semi")
    return texts.select("doc_id", "text").dropDuplicates()


def sample(docs: DataFrame, good: DataFrame, trusted: int) -> DataFrame:
    """At most ``trusted`` of these texts, for a caller who wants a small model. docs: (doc_id, text); good: distinct (_t)."""
    here = docs.select("doc_id", F.xxhash64("text").alias("key"), F.length("text").alias("chars")).where("chars > 0")
    here = here.join(good.where(_half("_t")), F.col("doc_id") == F.col("_t"), "left_semi").distinct()
    taken, left = [], TRUSTED_CHARS
    for r in here.orderBy(F.md5(F.col("doc_id").cast("string")), "key").limit(trusted).collect():  # at most ``trusted`` small rows
        if r["chars"] <= left:
            left -= r["chars"]
            taken.append((r["doc_id"], r["key"]))
    chosen = docs.sparkSession.createDataFrame(taken, "_t long, key long")
    texts = docs.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_t")) & (F.xxhash64("text") == F.col("key")), "left_semi")
    return texts.select("doc_id", "text").dropDuplicates()


def _scored(docs: DataFrame, labels: DataFrame, quantile: float, trusted: int | None) -> DataFrame:
    """Of all rows of docs (doc_id, lang, text): doc_id, lang, and a hash of the text, tokens, log10 probability, limit of the cost as _id, _tokens, _log10, _limit."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_t")).distinct()
    ours = docs.select("doc_id", "lang", text_id("text").alias("_id"), "text")
    names = ["doc_id", "lang", "_id", "_tokens", "_log10", "_uses"]
    schema = StructType([*ours.schema.fields[:3], StructField("_tokens", LongType()), StructField("_log10", DoubleType()), StructField("_uses", ArrayType(LongType()))])
    with brief_shuffles(docs.sparkSession), small_batches(docs.sparkSession):
        texts = docs.select("doc_id", "text")
        weighed, floor = weights(chosen(texts, good) if trusted is None else sample(texts, good, trusted))
        levels = levels_of(_all(weighed))
        least = least_level(levels, HEAD)
        n = sum(x for level, x in levels.items() if level < least)
        buckets = buckets_for(n, max(1, BUCKET >> 3))
        head = _all(weighed).select("keys", "data", "level").mapInArrow(frequent_weights(least), "keys binary, data binary").toArrow()  # at most HEAD n-grams
        model = docs.sparkSession.sparkContext.broadcast(indexed(head) | {"floor": np.array([floor]), "bits": bit_filter(_all(weighed), least)})
        tables: list[list[DataFrame]] = [[] for _ in range(ROUNDS)]
        for part in weighed:
            dealt = part.select("keys", "data", "level").mapInArrow(dealt_weights(least, buckets), "round int, bucket int, keys binary, data binary")
            for some, x in zip(tables, cut_by(dealt, "tail", "round", ROUNDS), strict=True):
                some.append(x)
            discard(part)
        scored = cut(ours.mapInArrow(scorer(model, 3, [0, 1, 2], buckets, names), schema), "perplexity")
        left = np.zeros(buckets, np.int64)
        for b, k in scored.select(F.posexplode("_uses").alias("b", "n")).groupBy("b").agg(F.sum("n")).collect():  # one row a bucket
            left[b] = k
        release()  # the driver keeps nothing of the model
        copies = scored.groupBy(F.col("_id").alias("id")).agg(F.count("*").alias("copies"))  # every copy of a text has added the text's sum
        sums = tail_sums(ours.select("_id", "text"), tables, n, model, left)
        sums = cut(sums.groupBy("id").agg(F.sum("sum").alias("sum")).join(copies, "id").select(F.col("id").alias("_id"), (F.col("sum") / F.col("copies")).alias("_more")), "sums")
    model.destroy()
    first = scored
    scored = scored.drop("_uses").join(sums, "_id", "left").withColumn("_log10", F.col("_log10") + F.coalesce("_more", F.lit(0.0))).drop("_more")
    scored = cut(scored, "perplexity")
    discard(first)

    narrow = scored.where("_tokens > 1").select("doc_id", "lang", F.ceil(-F.col("_log10") / F.col("_tokens") / BIN).cast("long").alias("bin"))
    known = narrow.join(good.where(~_half("_t")), F.col("doc_id") == F.col("_t"), "left_semi")
    bins = cut(known.groupBy("lang", "bin").agg(F.count("*").alias("n")), "bins")  # languages x bins of a bounded range

    def limits(b: DataFrame, *by: str) -> DataFrame:
        running = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
        total = F.sum("n").over(Window.partitionBy(*by))
        x = b.withColumn("run", running).withColumn("all", total).where(F.col("run") >= quantile * F.col("all"))
        return x.groupBy(*by).agg((F.min("bin") * BIN).alias("limit"), F.first("all").alias("all"))

    everywhere = bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    common = limits(everywhere, "one").first()
    common = float(common["limit"]) if common else float("inf")
    own = limits(bins, "lang").where(F.col("all") >= LEAST_CALIBRATION).select(F.col("lang").alias("_lang"), F.col("limit").alias("_limit"))
    out = scored.join(own, scored["lang"].eqNullSafe(F.col("_lang")), "left").drop("_lang")
    return out.withColumn("_limit", F.coalesce("_limit", F.lit(common)))


def text_id(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def _kept() -> Column:
    return (F.col("_tokens") > 1) & (-F.col("_log10") / F.col("_tokens") <= F.col("_limit"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, trusted: int | None = None) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, threshold, kept of every row of ``docs`` (doc_id, lang, text).

    labels: (doc_id, quality, toxic); trusted are the documents of quality 1 that are not toxic.
    """
    out = _scored(_narrow(docs), labels, quantile, trusted)
    perplexity = F.pow(F.lit(10.0), -F.col("_log10") / F.col("_tokens"))
    return out.select("doc_id", "lang", F.col("_tokens").alias("n_tokens"), F.col("_log10").alias("log10_prob"), perplexity.alias("perplexity"), F.pow(F.lit(10.0), F.col("_limit")).alias("threshold"), _kept().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, each by its own text and language: rows of equal text and language have one verdict."""
    id_, lang = unused(docs, "_id"), unused(docs, "_lang")
    bad = _scored(_narrow(docs), labels, QUANTILE, None).where(~_kept()).select(F.col("_id").alias(id_), F.col("lang").alias(lang)).distinct()
    return docs.join(bad, (text_id("text") == F.col(id_)) & F.col("lang").cast("string").eqNullSafe(F.col(lang)), "left_anti")
