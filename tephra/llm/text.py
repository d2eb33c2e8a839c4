"""Vectorised reading of texts: bytes, words and substring hashes of many documents at once.

A table of documents reaches Python as Arrow data, whose string column already is one run of UTF-8 bytes
with offsets. Everything here works on that run with numpy, so no Python object is made for a word.
Hashes of runs are joined from those of shorter runs, each join mixed (`Hashes`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: The bytes that part words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are hashed at a time; bounds the memory of the hash arrays.
CHUNK = 1 << 19

def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two neighbouring runs, in their order."""
    x = a * U64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def seal(x: np.ndarray, size) -> np.ndarray:
    """The hash of a run with its size, spread over the word."""
    return mix(x + np.asarray(size).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Keeps the first 0 to 7 bytes of eight.
MASK = np.array([(1 << 8 * k) - 1 for k in range(8)], U64)


class Hashes:
    """Hash of any run items[start:end], joined from those of runs of 1, 2, 4 ... items.

    Each join mixes before the next, so equal hashes of different runs have no pattern as those of a polynomial have.
    Runs of 2 * `unit` items and more are cut into blocks of `unit`, whose hashes are hashed as items again.
    """

    def __init__(self, items: np.ndarray, unit: int = 16):
        self.n, self.base, self.unit, self.rows = len(items), 1, unit, {1: items}

    @classmethod
    def of_bytes(cls, buf: np.ndarray, unit: int = 8) -> Hashes:
        """Eight bytes at a time are read as one number."""
        out = cls.__new__(cls)
        padded = np.zeros(len(buf) + 8, np.uint8)
        padded[: len(buf)] = buf
        out.n, out.base, out.unit = len(buf), 8, unit
        out.packed = np.ascontiguousarray(np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,)))
        out.rows = {8: out.packed[: max(0, len(buf) - 7)]}
        return out

    def _row(self, size: int) -> np.ndarray:
        """Hashes of all runs of that size, a power of two times the least."""
        if size not in self.rows:
            half = self._row(size // 2)
            self.rows[size] = join(half[: max(0, len(half) - size // 2)], half[size // 2 :])
        return self.rows[size]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size, out = end - start, np.zeros(len(start), U64)
        if self.base > 1 and len(some := np.flatnonzero(size < self.base)):
            v = self.packed[start[some]] & MASK[size[some]]
            out[some] = join(v, v)
        block = self.base
        while block <= self.unit:
            if len(some := np.flatnonzero((size >= block) & (size < 2 * block))):
                row = self._row(block)
                out[some] = join(row[start[some]], row[end[some] - block])
            block *= 2
        if len(some := np.flatnonzero(size >= block)):
            # blocks from the start on, and one that ends where the run ends
            count = -(-size[some] // self.unit)
            cut = np.append(0, np.cumsum(count))
            at = np.repeat(start[some] - cut[:-1] * self.unit, count) + np.arange(cut[-1]) * self.unit
            at[cut[1:] - 1] = end[some] - self.unit
            out[some] = Hashes(self._row(self.unit)[at]).of(cut[:-1], cut[1:])
        return seal(out, size)

    def every(self, width: int) -> np.ndarray:
        """Of all runs of that width, by start."""
        size = self.base
        while size * 2 <= width:
            size *= 2
        if self.n < width or width < self.base:
            return self.of(at := np.arange(max(0, self.n - width + 1)), at + width)
        row = self._row(size)
        return seal(join(row[: self.n - width + 1], row[width - size :]), width)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts, with the end; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_string())
    a = a.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes, or one document where it is longer."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of the first word of each document, with the end."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    space = SPACE[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[off] = True
    start = np.flatnonzero(edge[:-1] & ~space)
    edge[1:-1] = space[1:]
    edge[off] = True
    end = np.flatnonzero(edge[1:] & ~space) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Hashes.of_bytes(buf).of(start, end)


def sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over a[i:i+width] for every i."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    span = 1
    while span * 2 <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[:n], a[width - span : width - span + n]) if span < width else a[:n]


def inside(off: np.ndarray, width: int) -> np.ndarray:
    """Which starts have `width` items of the same document before them, themselves included."""
    n = int(off[-1])
    d = np.zeros(n + 1, np.int32)
    full = np.diff(off) >= width
    np.add.at(d, off[:-1][full], 1)
    np.add.at(d, (off[1:] - width + 1)[full], -1)
    return np.cumsum(d[:n]) > 0


def anchors(gram: np.ndarray, off: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: (anchor, first, last): `anchor` holds the least k-gram of the windows that start at first..last.

    A window of `window` items of one document belongs to the one k-gram in it that has the least hash (its
    high 32 bits; the leftmost of equals). That depends on the window alone, so equal windows have their
    anchors at equal places wherever they stand, and each window has exactly one.
    """
    ok = inside(off, window)
    n = len(ok) - window + 1
    if n <= 0 or not ok.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    key = (gram & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U64)
    at = (sliding(np.minimum, key, window - k + 1)[:n] & U64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(ok[:n])
    at = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return at[first], start[first], start[last]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n items lie in one of the ranges."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:n]) > 0


def planes(a: np.ndarray) -> bytes:
    """Numbers as byte planes, which Spark's shuffle compression shrinks where the high bytes agree."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(np.frombuffer(b, np.uint8).reshape(size, -1).T.tobytes(), dtype)


def tokens(buf: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents: start and end byte and hash of every word, and the first word of each document, with the end.

    lower: A-Z count as a-z.
    """
    parts, first, n = [], [np.zeros(1, np.int64)], 0
    for i, j in chunks(off):
        base = int(off[i])
        part = buf[base : int(off[j])]
        start, end, of = words(part, off[i : j + 1] - base)
        parts.append((start + base, end + base, word_hashes(LOWER[part] if lower else part, start, end)))
        first.append(of[1:] + n)
        n += len(start)
    cat = lambda m, t: np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, t)
    return cat(0, np.int64), cat(1, np.int64), cat(2, U64), np.concatenate(first)


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space; of: first word of each document, with the end."""
    kept = np.flatnonzero(keep)
    cut = np.searchsorted(kept, of)
    size = (end - start)[kept] + 1  # each with a space after it
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    body = np.ones(len(out), bool)
    body[begin + size - 1] = False
    out[body] = buf[covered(len(buf), start[kept], end[kept])]
    at = np.append(begin, len(out))
    return [out[at[a] : max(at[a], at[b] - 1)].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
