"""Order MinHash fingerprints of documents and of an edited form of each.

A text's elements are its k-mers of code points, each with its occurrence number (how many equal k-mers stand before
it). For each of SKETCHES hash functions the TUPLE smallest elements are selected, put back into the order in which they
stand in the text and hashed as a tuple. Two texts agree in a sketch if they share these elements in the same order, which
edits, moves and repeats disturb; the share of equal sketches is the likeness of two fingerprints.

A document's edited form needs the beginning of the next document. Documents are dealt to buckets by quantiles of their
ids (ids that repeat very often are parted further by their texts' hashes), each bucket is one sorted run, and the first
rows of a bucket are also sent to the end of the one before; so every text is shuffled once. A text and its edited form
share all elements of the kept part, whose minima are found once for both.

Defined results: a null text is empty. A text shorter than a k-mer is one element; an empty text has none, and its
fingerprint is that of the empty tuple, equal to that of other empty texts only. Where a text has fewer elements than a
tuple, all are taken. Documents are ordered by doc_id, a null one first, and rows of equal doc_id by a hash of the text, so
rows that repeat wholly are each other's next. A single document is its own next. Other columns are not used. An empty
table gives an empty result. A task holds one text and the next at a time, at about 100 bytes a code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsforest.llm.textscan import U64, mix

#: Code points of a k-mer (a power of two), elements of a tuple, hash functions.
KMER, TUPLE, SKETCHES = 16, 2, 32
#: Rows that a bucket has about, and buckets at most: their bounds are in every task.
ROWS_A_BUCKET, BUCKETS = 500, 4096
#: Code points that are hashed together.
PIECE = 1 << 17
LEAST_ID, NONE = -(1 << 63), np.iinfo(np.uint64).max

_STEP, _OCCURRENCE, _ROW, _TUPLE = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)
SEEDS = (mix(np.arange(1, 2 * SKETCHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmer_hashes(codes: np.ndarray) -> np.ndarray:
    """The hash of the k-mer that begins at each code point; the last KMER - 1 are of no use."""
    h, wide, step = mix(codes.astype(U64) + U64(1)), 1, np.full(1, _STEP)
    while wide < KMER:
        h[:-wide] = h[:-wide] * step + h[wide:]
        step, wide = step * step, 2 * wide
    return mix(h)


def short_hash(codes: np.ndarray) -> np.ndarray:
    """The hash of a text that is shorter than a k-mer, as the one value of an array."""
    h = np.full(1, len(codes), U64)
    for c in codes:
        h = mix(h * _STEP + U64(c))
    return h


def _occurrences(h: np.ndarray, row: np.ndarray, moved: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """How often each element's hash stands before it in its row. Elements of the edited end (``tail``, last in the arrays) don't see those it replaces (``moved``)."""
    key = mix(h ^ (row.astype(U64) * _ROW))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    occ = np.zeros(len(h), np.int64)
    if not same.any():
        return occ
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    at = order[many]
    at = at[np.lexsort((at, key[at]))]
    first = np.flatnonzero(np.r_[True, key[at][1:] != key[at][:-1]])
    run = np.repeat(first, np.diff(np.r_[first, len(at)]))
    gone = np.cumsum(moved[at]) - moved[at]  # moved ones before, all runs
    occ[at] = np.arange(len(at)) - run - np.where(tail[at], gone - gone[run], 0)
    return occ


def signatures(texts: list[str], ends: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """SKETCHES values a row of each text, and of the text whose last quarter is replaced by the row of ``ends``."""
    rows = len(texts)
    hashes, where, sizes = [], [], np.zeros((rows, 3), np.int64)  # elements of the kept part, of the replaced end, of the new end
    for r, (text, end) in enumerate(zip(texts, ends, strict=True)):
        n, kept = len(text), len(text) - len(text) // 4
        common = max(0, kept - KMER + 1)
        edited = text[common:kept] + end
        for which, x in ((0, codes_of(text)), (1, codes_of(edited))):
            if not len(x):
                continue
            if len(x) < KMER and not common:
                hashes.append(short_hash(x))
            elif len(x) >= KMER:
                hashes.append(kmer_hashes(x)[: len(x) - KMER + 1])
            else:
                continue
            where.append((which, r))
            if which == 0:
                sizes[r, :2] = min(common, len(hashes[-1])), len(hashes[-1]) - min(common, len(hashes[-1]))
            else:
                sizes[r, 2] = len(hashes[-1])
    # the texts' elements first, then the new ends', each segment followed by a place that holds none
    hashes = [h for which in (0, 1) for h, (w, _) in zip(hashes, where, strict=True) if w == which]
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    lengths = np.concatenate([sizes[:, :2].ravel(), sizes[:, 2]])
    row = np.repeat(np.concatenate([np.repeat(np.arange(rows), 2), np.arange(rows)]), lengths)
    kind = np.repeat(np.concatenate([np.tile([0, 1], rows), np.full(rows, 2)]), lengths)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    before = np.concatenate([np.stack([np.zeros(rows, np.int64), sizes[:, 0]], axis=1).ravel(), sizes[:, 0]])  # a segment's first position in its text
    inside = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(starts, lengths) + inside
    total = len(h) + len(lengths)
    x, position = np.zeros(total, U64), np.zeros(total, U64)
    x[at] = mix(h + _occurrences(h, row, kind == 1, kind == 2).astype(U64) * _OCCURRENCE)
    position[at] = (np.repeat(before, lengths) + inside).astype(U64)
    empty = starts + lengths
    hi, lo = (x >> U64(32)).astype(np.uint32), x.astype(np.uint32)
    low32 = U64(0xFFFFFFFF)
    out = np.zeros((2, rows, SKETCHES), np.uint32)
    starts_of = (starts[: 2 * rows].reshape(rows, 2), np.stack([starts[: 2 * rows : 2], starts[2 * rows :]], axis=1))
    for k in range(SKETCHES):
        y = (hi * SEEDS[2 * k] ^ lo * SEEDS[2 * k + 1]).astype(U64) << U64(32)
        y |= position
        y[empty] = NONE
        least = np.empty((TUPLE, len(lengths)), U64)
        for j in range(TUPLE):
            np.minimum.reduceat(y, starts, out=least[j])
            taken = np.where(least[j] == NONE, empty, starts + (least[j] & low32).astype(np.int64) - before)
            y[taken] = NONE
        for form in (0, 1):  # the text: kept part and replaced end; edited: kept part and new end
            new = least[:, 1 : 2 * rows : 2] if form == 0 else least[:, 2 * rows :]
            best = np.sort(np.concatenate([least[:, : 2 * rows : 2], new]), axis=0)[:TUPLE]
            places = np.sort(np.where(best == NONE, NONE, best & low32), axis=0)  # back in the order of the text
            h = np.zeros(rows, U64)
            for j in range(TUPLE):
                some = places[j] != NONE
                p = np.where(some, places[j], 0).astype(np.int64)
                later = p >= sizes[:, 0]
                element = x[np.where(later, starts_of[form][:, 1] + p - sizes[:, 0], starts_of[form][:, 0] + p)]
                h = mix(h * _TUPLE + np.where(some, element, U64(0)))
            out[form, :, k] = (h >> U64(32)).astype(np.uint32)
    return out[0], out[1]


def fingerprint(signature: np.ndarray) -> list[str]:
    """Eight hexadecimal digits for each sketch."""
    return [row.tobytes().hex() for row in np.ascontiguousarray(signature.astype(">u4"))]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tail, id, text) in order: each one's edited form, fingerprints and likeness to its own and the next row's. Tail rows are only next ones."""
    held: tuple | None = None  # a row that waits for the fingerprint of the next one

    def done(rows: list[tuple], ends: list[str]) -> pa.RecordBatch | None:
        nonlocal held
        texts = [t or "" for _, _, t in rows]
        heads = [end[: len(t) // 4] for t, end in zip(texts, ends, strict=True)]
        plain, edited = signatures(texts, heads)
        full = [t[: len(t) - len(t) // 4] + e for t, e in zip(texts, heads, strict=True)]
        sha = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in full]
        new = [(i, len(t), s, p, e) for (_, i, _), t, s, p, e in zip(rows, texts, sha, plain, edited, strict=True)]
        chain = ([(held, False)] if held else []) + [(x, r[0]) for x, r in zip(new, rows, strict=True)]
        out = [(a, b) for (a, tail), (b, _) in zip(chain, chain[1:], strict=False) if not tail]
        held = None if chain[-1][1] else chain[-1][0]
        if not out:
            return None
        a, b = np.stack([x[3] for x, _ in out]), np.stack([x[4] for x, _ in out])
        nxt = np.stack([y[3] for _, y in out])
        columns = [pa.array([x[0] for x, _ in out], pa.int64()), pa.array([x[1] for x, _ in out], pa.int64()), pa.array([x[2] for x, _ in out]), pa.array(fingerprint(a)), pa.array(fingerprint(b))]
        columns += [pa.array((a == y).mean(axis=1)) for y in (b, nxt)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    waiting: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            waiting.append(row)
            size += len(row[2] or "")
            if size > PIECE and len(waiting) > 1:
                found = done(waiting[:-1], [t or "" for _, _, t in waiting[1:]])
                waiting, size = waiting[-1:], len(waiting[-1][2] or "")
                if found is not None:
                    yield found
    if waiting:
        found = done(waiting, [t or "" for _, _, t in waiting[1:]] + [""])
        if found is not None:
            yield found


def _bucket(ids: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Buckets in the order of (id, hash): an id that is several bounds at once fills the buckets between by its hash."""
    lo, hi = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    share = (h.astype(np.float64) + 2.0**63) / 2.0**64
    return lo + np.minimum((share * (hi - lo + 1)).astype(np.int64), hi - lo)


def fingerprints(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document (doc_id, text).

    The edited text: the last floor(n_chars / 4) code points give way to the first as many of the next document.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), "text")
    n = x.count()
    buckets = max(1, min(BUCKETS, n // rows_a_bucket))
    found = x.agg(F.percentile_approx("_id", [k / buckets for k in range(1, buckets)], 20 * BUCKETS)).first()[0] if buckets > 1 else None
    bounds = np.array(found or [], np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_bucket(ids.to_numpy(np.int64), h.to_numpy(np.int64), bounds).astype(np.int32))

    # a row a bucket
    firsts = sorted(tuple(r) for r in x.groupBy(bucket("_id", "_h").alias("b")).agg(F.min(F.struct("_id", "_h")).alias("first")).select("b", "first.*").collect())
    earlier = np.zeros(len(bounds) + 1, np.int32)
    heads = np.zeros((len(bounds) + 1, 2), np.int64)
    for (b, i, h), (before, _, _) in zip(firsts, firsts[-1:] + firsts[:-1], strict=True):
        earlier[b], heads[b] = before, (i, h)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, h: pd.Series) -> pd.Series:
        i, k = ids.to_numpy(np.int64), h.to_numpy(np.int64)
        own = _bucket(i, k, bounds).astype(np.int32)
        head = (heads[own, 0] == i) & (heads[own, 1] == k)
        return pd.Series([[b, int(earlier[b])] if f else [b] for b, f in zip(own.tolist(), head.tolist(), strict=True)])

    dealt = x.select("*", F.posexplode(places("_id", "_h")).alias("_tail", "_bucket"))
    run = dealt.repartition("_bucket").sortWithinPartitions("_bucket", "_tail", "_id", "_h")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return run.select((F.col("_tail") == 1).alias("tail"), "doc_id", "text").mapInArrow(_compare, schema)
