"""Columns of text as flat UTF-8 buffers: words and fingerprints of any span, vectorised over a batch of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _splitmix(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_set(spec) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(spec)] = True
    return table


#: Bytes of a word [^\x20\x09-\x0D]+ and of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
SPACED = byte_set(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = byte_set([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = _splitmix(7, 256)


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, or of one document."""
    _, off = parts(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


#: The prime 2**61 - 1: sums modulo a prime have no texts that collide whatever the base, as sums modulo 2**64 do.
PRIME = (1 << 61) - 1
_PRIME_BASE = 0x1A3C59B7E2D4F681 % PRIME
_L31, _L30, _P = U((1 << 31) - 1), U((1 << 30) - 1), U(PRIME)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U(61))
    return np.minimum(x, x - _P)  # x - _P wraps round where x is smaller


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    ah, al, bh, bl = a >> U(31), a & _L31, b >> U(31), b & _L31
    mid = ah * bl + al * bh
    return _reduced(U(2) * ah * bh + (mid >> U(30)) + ((mid & _L30) << U(31)) + al * bl)


class Powers:
    """Powers of the base and of its inverse modulo PRIME, as far as needed."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _PRIME_BASE), ("down", pow(_PRIME_BASE, -1, PRIME))):
                table = getattr(cls, name)
                while len(table) < max(n, 1 << 16):
                    table = np.concatenate([table, times(table, np.array([pow(base, len(table), PRIME)], U))])
                setattr(cls, name, table)
        return cls.up[:n], cls.down[:n]


class Prints:
    """Fingerprints of any span of a sequence of symbols, bytes or 64-bit values: equal spans have equal prints, others differ
    but for one chance in 2**61 a symbol of their length, as the base is no text's choice."""

    _BLOCK = 1 << 20

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = Powers.to(n + 1)
        # sums of the products' upper and lower parts; what is asked for is put together when it is
        self.high, self.low = np.zeros(n + 1, U), np.zeros(n + 1, U)
        for a in range(0, n, self._BLOCK):
            b = min(n, a + self._BLOCK)
            if values.dtype == np.uint8:
                v = values[a:b].astype(U) + U(1)
                high, low = v * (up[a:b] >> U(31)), v * (up[a:b] & _L31)
            else:
                x = times(_reduced(values[a:b]), up[a:b])
                high, low = x >> U(31), x & _L31
            high[:1] += _reduced(self.high[a : a + 1])
            low[:1] += _reduced(self.low[a : a + 1])
            np.cumsum(high, out=self.high[a + 1 : b + 1])
            np.cumsum(low, out=self.low[a + 1 : b + 1])

    def _sum(self, at: np.ndarray) -> np.ndarray:
        high = _reduced(self.high[at])
        return _reduced(_reduced((high >> U(30)) + ((high & _L30) << U(31))) + _reduced(self.low[at]))

    def of(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        inside = _reduced(self._sum(end) + (_P - self._sum(start)))
        return mix(times(inside, self.down[start]) + (end - start).astype(U) * U(0xD6E8FEB86659FD93) + U(seed))


#: The most symbols of a gram: sums modulo 2**64 of more may collide for texts of a kind (Thue and Morse's).
MOST_GRAM = 33


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive symbols, k at most MOST_GRAM: cheap, for sampling and grouping."""
    if k > MOST_GRAM:
        raise ValueError(f"a gram has at most {MOST_GRAM} symbols")
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if values.dtype == np.uint8:
        values = BYTE_VALUE[values]
    up, down = _plain(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n])


_tables: dict[int, np.ndarray] = {_BASE: np.ones(1, U), _INVERSE: np.ones(1, U)}


def _plain(n: int) -> list[np.ndarray]:
    """Powers modulo 2**64."""
    for base, table in _tables.items():
        if len(table) < n:
            table = np.full(max(n, 1 << 16), base, U)
            table[0] = 1
            _tables[base] = np.multiply.accumulate(table)
    return [t[:n] for t in _tables.values()]


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the buffer, and the offset of each document's first word; no word crosses documents."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[buf]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def word_values(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Prints(buf).of(start, end)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] of them, for each i."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(total, dtype=np.int64)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest of the upper 32 bits among w consecutive values, for each window."""
    key = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    size = 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < w:
        key = np.minimum(key[: len(key) - (w - size)], key[w - size :])
    return (key & U(0xFFFFFFFF)).astype(np.int64)


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    depth = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(depth[:n]) > 0


def list_column(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))
