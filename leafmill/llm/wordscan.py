"""Vectorised byte scans of Arrow text columns: words, lines, and polynomial hashes of any byte range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Two polynomials modulo the prime 2**31 - 1: modulo 2**64, strings such as Thue and Morse's collide for every base.
_P = np.uint64((1 << 31) - 1)
_HALF = np.uint64(31)
_BASES = (1_304_672_813, 917_364_481)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, (1 << 31) - 1, (2, 256), dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Powers kept between calls; longer texts make theirs anew, so that a worker doesn't keep what one long text took.
_KEPT = 1 << 22
_powers: np.ndarray = np.ones((4, 1), np.uint32)


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or the prime itself for zero; for x below 2 ** 62."""
    x = (x & _P) + (x >> _HALF)
    return (x & _P) + (x >> _HALF)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo the prime; for x below 2 ** 62 and y up to the prime."""
    x = _residue(_residue(x) * y)
    x[x == _P] = 0
    return x


def powers(n: int) -> np.ndarray:
    """Rows: the powers of both bases, then of their inverses, modulo the prime, for exponents below n."""
    global _powers
    out = _powers
    if out.shape[1] < n:
        size = max(n, 1 << 16)
        out = np.empty((4, size), np.uint32)
        for k, base in enumerate((*_BASES, *(pow(b, -1, int(_P)) for b in _BASES))):
            out[k, 0], have = 1, 1
            while have < size:
                more = min(have, size - have)
                out[k, have : have + more] = _residue(out[k, :more].astype(np.uint64) * np.uint64(pow(base, have, int(_P))))
                have += more
        if size <= _KEPT:
            _powers = out
    return out[:, :n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20):
    """Slices of a batch of whole rows with up to about `limit` bytes of text (a longer row comes alone)."""
    off = buffers(batch.column(batch.schema.get_field_index(column)))[1]
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_windows(data: np.ndarray, overlap: int = 0, limit: int = 4 << 20):
    """Slices of one text of some `limit` bytes that end after a word; each begins with the last `overlap` words of the
    one before, so that every run of overlap + 1 words is whole in one slice alone. A longer word stays whole.
    """
    start, fresh = 0, 0
    while True:
        end = min(fresh + limit, len(data))
        while end < len(data):
            stop = np.flatnonzero(SPACE[data[end : end + limit]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(end + limit, len(data))
        yield data[start:end]
        if end >= len(data):
            return
        start = fresh = end
        if overlap:
            # Enough words before the end, looked for in steps that double.
            back = 256
            while True:
                begin = max(0, end - back)
                starts = words(data[begin:end], np.array([0, end - begin]))[0] + begin
                if begin and SPACE[data[begin - 1]] == SPACE[data[begin]] and not SPACE[data[begin]]:
                    starts = starts[1:]
                if len(starts) >= overlap or not begin:
                    break
                back *= 2
            start = int(starts[-overlap:][0]) if len(starts) else end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than white space, and the index of each row's first word (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | first[:-1]))
    ends = np.flatnonzero(inside & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of both polynomials for range_hash, 2 x (n + 1)."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    power = powers(len(data))
    for k in range(2):
        np.cumsum(_residue(_BYTE[k][data] * power[k]), out=out[k, 1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    inverse = powers(sums.shape[1])[2:]
    halves = []
    for k in range(2):
        halves.append(product(sums[k][ends] - sums[k][starts], inverse[k][starts]))
    return mix(mix((halves[0] << np.uint64(32)) | halves[1]) + (ends - starts).astype(np.uint64))


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each element, from the index of each row's first element (n + 1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags over each row's elements."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
