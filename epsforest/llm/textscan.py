"""Vectorised scans of Arrow text columns: words, 64-bit word hashes and shingles, without a loop over characters."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

U64 = np.uint64
BASE = 0x9E3779B97F4A7C55
BLOCK = 1 << 20

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~_space
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs


def pieces(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: first row, end row, their bytes, offsets from 0. Long rows come alone, whole."""
    buf, offs = text_buffers(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        end = min(end, rows)
        yield row, end, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def release() -> None:
    """Gives back to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with what it has freed given back to the system at its end: Python workers live on, and would keep the most that any task needed."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int = BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def __reduce__(self) -> tuple:  # executors grow their own
        return Powers, (self.base,)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 1024)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (self.base, self.inverse))
        return self.up, self.down


POWERS = Powers()


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes ``inside``; a run never crosses two rows."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = inside[buf]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = w[edge]
    last[edge - 1] = w[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges in order, by prefix sums of a polynomial hash over blocks of ranges."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = POWERS.of(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum((buf[lo:hi].astype(U64) + U64(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending byte ranges, by eight bytes at once: faster than ``span_hashes`` for words, of which few are long."""
    held = np.zeros(len(buf) // 8 + 2, U64)
    held.view(np.uint8)[: len(buf)] = buf

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        place, bit = at >> 3, ((at & 7) << 3).astype(U64)
        x = held[place] >> bit | held[place + 1] << U64(1) << (U64(63) - bit)
        return x & U64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) << 3).astype(U64)

    n = ends - starts
    out = mix(n.astype(U64) * U64(BASE) + eight(starts, n))
    some = np.flatnonzero(n > 8)
    done = 8
    while len(some) and done < 64:
        out[some] = mix(out[some] * U64(0xD6E8FEB86659FD93) + eight(starts[some] + done, n[some] - done))
        done += 8
        some = some[n[some] > done]
    if len(some):
        out[some] = span_hashes(buf, starts[some], ends[some])
    return out


def rows_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The row of each start."""
    return np.searchsorted(offs, starts, "right") - 1


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, joined, and how many each row has.

    words: hashes of all rows' words in order; counts: words of each row. A row with fewer words than ``size`` has its
    whole sequence as one shingle; a row without words has none.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    many = np.maximum(counts - size + 1, np.minimum(counts, 1))
    stops = np.cumsum(many)
    out = np.empty(int(stops[-1]) if len(stops) else 0, U64)
    x = words.copy()
    for k in range(1, size):
        if len(words) > k:
            x[: len(words) - k] = mix(x[: len(words) - k] * U64(0xD6E8FEB86659FD93) + words[k:] + U64(k))
    for row in range(len(counts)):
        n, b, e = int(counts[row]), int(begins[row]), int(stops[row])
        if n >= size:
            part = out[e - int(many[row]) : e]
            part[:] = x[b : b + n - size + 1]
            part.sort()
        elif n:
            h = np.full(1, n, U64)
            for k in range(b, b + n):
                h = mix(h * U64(0xD6E8FEB86659FD93) + words[k : k + 1])
            out[e - 1] = h[0]
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    firsts = (stops - many)[many > 0]
    keep[firsts] = True
    kept = np.add.reduceat(keep, firsts, dtype=np.int64) if len(firsts) else np.zeros(0, np.int64)
    sizes = np.zeros(len(counts), np.int64)
    sizes[many > 0] = kept
    return out[keep], sizes


def word_shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row's lower-cased words, joined, and how many each row has."""
    low = LOWER[buf]
    starts, ends = spans(low, offs, NOT_SPACE)
    words = span_hashes(low, starts, ends)
    counts = np.bincount(rows_of(starts, offs), minlength=len(offs) - 1) if len(starts) else np.zeros(len(offs) - 1, np.int64)
    return shingle_sets(words, counts, size)
