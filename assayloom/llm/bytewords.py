"""Words of whole batches of texts as 64-bit numbers, in numpy over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Bytes of multi-byte characters are all
above 0x7F, so working on bytes is exact. A word's number is a polynomial of random 64-bit values of its bytes, then
mixed with its length; two different words share one with a chance of about 2^-60.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUE[65:91] = VALUE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 2**64))
SALTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of STEP and of its inverse, kept between batches."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)), dtype=np.uint64) for b in (STEP, BACK))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text is an empty one."""
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


STRETCH = 1 << 20  # bytes whose numbers are worked out at once: bounds memory, whatever a text's length


class Words:
    """number: 64-bit number of each word; first: index of each text's first word (one more at the end); starts, ends: bytes."""

    def __init__(self, column: pa.Array, powers: Powers | None = None):
        self.powers = powers or Powers()
        data, at = buffers(column)
        self.data, self.at, n = data, at, len(data)
        inside = np.zeros(n + 1, bool)
        np.logical_not(SPACE[data], out=inside[:n])
        head = np.zeros(n + 1, bool)
        head[at] = True
        # a word starts where no byte of its text's word precedes, and ends where none follows
        start = inside[:n].copy()
        start[1:] &= ~inside[: n - 1] | head[1:n]
        end = inside[:n].copy()
        end &= ~inside[1:] | head[1:]
        self.starts, self.ends = np.nonzero(start)[0], np.nonzero(end)[0] + 1
        self.first = np.searchsorted(self.starts, at)
        self.prefix: np.ndarray | None = None
        self.number = self.part(self.starts, self.ends)

    def part(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of byte ranges, each inside a word, in the order of the words: equal bytes, equal number (A-Z as a-z)."""
        out = np.empty(len(starts), np.uint64)
        a = 0
        while a < len(starts):
            low = int(starts[a])
            z = len(starts) if len(self.data) <= 2 * STRETCH else max(a + 1, int(np.searchsorted(starts, low + STRETCH)))
            high = int(ends[z - 1])
            if z - a > 1 and high - low > 2 * STRETCH:  # only the last word can reach so far
                z -= 1
                high = int(ends[z - 1])
            if high - low > 2 * STRETCH:
                out[a] = self._long(low, high)
            else:
                prefix, low = self._prefix(low, high)
                out[a:z] = (prefix[ends[a:z] - low] - prefix[starts[a:z] - low]) * self.powers.down[starts[a:z] - low]
            a = z
        return mix(out ^ ((ends - starts).astype(np.uint64) * SALTS[0]))

    def _prefix(self, low: int, high: int) -> tuple[np.ndarray, int]:
        """Running sums over the bytes from low to high (kept, and of all bytes, while these are few), and where they begin."""
        if len(self.data) <= 2 * STRETCH:
            if self.prefix is not None:
                return self.prefix, 0
            low, high = 0, len(self.data)
        self.powers.grow(high - low + 1)
        prefix = np.zeros(high - low + 1, np.uint64)
        terms = VALUE[self.data[low:high]]
        terms *= self.powers.up[: high - low]
        np.cumsum(terms, dtype=np.uint64, out=prefix[1:])
        if len(self.data) <= 2 * STRETCH:
            self.prefix = prefix
        return prefix, low

    def _long(self, start: int, end: int) -> np.uint64:
        """The sum of one range, stretch by stretch."""
        self.powers.grow(STRETCH + 1)
        total, factor = np.zeros(1, np.uint64), np.ones(1, np.uint64)
        for low in range(start, end, STRETCH):
            terms = VALUE[self.data[low : min(end, low + STRETCH)]] * self.powers.up[: min(end - low, STRETCH)]
            total += terms.sum(dtype=np.uint64) * factor
            factor *= self.powers.up[STRETCH]
        return total[0]

    def __len__(self) -> int:
        return len(self.at) - 1

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the k-word shingles and each text's first; fewer words make one shingle of them all."""
        count = np.diff(self.first)
        many = np.maximum(count - k + 1, (count > 0).astype(count.dtype))
        out_first = np.concatenate([[0], np.cumsum(many)])
        text = np.repeat(np.arange(len(count)), many)
        at = np.arange(out_first[-1]) - out_first[text] + self.first[text]
        padded = np.concatenate([self.number, np.zeros(k, np.uint64)])
        left = self.first[text + 1] - at if len(text) else at
        acc = np.zeros(len(at), np.uint64)
        for j in range(k):
            w = padded[at + j] * SALTS[1 + j]
            acc += np.where(left > j, w, SALTS[20 + j])
        return mix(acc), out_first


def give_back() -> None:
    """Memory that Arrow and the C library hold on to goes back: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def row_batches(batches, rows: int = 1_000, size: int = 1_000_000):
    """Slices of Arrow batches with bounded rows and bounded text (one longer text is a slice by itself)."""
    try:
        yield from _slices(batches, rows, size)
    finally:
        give_back()


def _slices(batches, rows: int, size: int):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        lengths = np.asarray(pa.compute.binary_length(column).fill_null(0), np.int64)
        at = 0
        total = np.cumsum(lengths)
        while at < len(lengths):
            before = total[at - 1] if at else 0
            to = int(np.searchsorted(total, before + size, "right"))
            to = min(max(to, at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to
