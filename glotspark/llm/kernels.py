"""Vectorised text kernels shared by the operators of this subpackage.

They work on the raw Arrow buffers of a column of texts: one ``uint8`` array
with every text end to end and one offset per text. A word is a maximal run of
bytes other than 0x20 and 0x09-0x0D. Those bytes never occur inside a longer
UTF-8 sequence, so this equals matching ``[^\\x20\\x09-\\x0D]+`` on characters.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C1B, 0xD6E8FEB86659FD93
NULL_ID = np.iinfo(np.int64).max


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))


KEPT_POWERS = 1 << 21
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers. One array a base is kept, of KEPT_POWERS at most."""
    kept = _kept.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    size = n if n > KEPT_POWERS else min(KEPT_POWERS, max(1 << 16, n + n // 4))
    out = np.full(size, base, U64)
    out[:1] = 1
    np.cumprod(out, dtype=U64, out=out)
    if size <= KEPT_POWERS:
        _kept[base] = out
    return out[:n]


def prefix_hash(codes: np.ndarray, base: int) -> np.ndarray:
    """Sums S with S[i] = sum of codes[k] * base**k for k < i, modulo 2**64."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * _powers(base, len(codes)), dtype=U64, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, units: np.ndarray | None = None) -> np.ndarray:
    """Position-free hashes of codes[start:end], mixed.

    A sum modulo 2**64 can't tell two units in the order of the Thue-Morse sequence
    from the same with both exchanged, from some 1000 units on, whatever the base.
    Ranges of more than LONG units are therefore hashed from the units themselves,
    which callers give wherever ranges can be that long."""
    out = mix((sums[end] - sums[start]) * _powers(pow(base, -1, 1 << 64), len(sums))[start])
    if units is not None:
        for i in np.flatnonzero(end - start > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(units[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


LONG = 512
PRIMES = ((2147483647, 0x5851F42D), (2147483629, 0x2545F491))
_prime_powers: dict[tuple[int, int], np.ndarray] = {}


def _powers_modulo(base: int, prime: int, n: int) -> np.ndarray:
    kept = _prime_powers.get((base, prime))
    if kept is None or len(kept) < n:
        kept = np.ones(1, U64)
        while len(kept) < n:
            kept = np.concatenate([kept, kept * U64(pow(base, len(kept), prime)) % U64(prime)])
        if n <= KEPT_POWERS:
            _prime_powers[base, prime] = kept
    return kept[:n]


class PrimeSums:
    """Sums of codes modulo two primes of 31 bits, for ranges of any length with a
    unit left out: there units can't be hashed one range at a time."""

    def __init__(self, codes: np.ndarray):
        self.sums, self.inverse = [], []
        for i, (prime, base) in enumerate(PRIMES):
            base, p = base % prime, U64(prime)
            terms = (codes >> U64(32 * i) & U64(0xFFFFFFFF)) % p * _powers_modulo(base, prime, len(codes)) % p
            self.sums.append(np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64) % p]))
            self.inverse.append(_powers_modulo(pow(base, -1, prime), prime, len(codes) + 2))

    def ranges(self, *parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """62 bits of the ranges low to high, one after the other; between two of them
        one unit is left out."""
        out = np.zeros(len(parts[0][0]), U64)
        for i, (prime, _) in enumerate(PRIMES):
            p, sums, inverse = U64(prime), self.sums[i], self.inverse[i]
            total = np.zeros(len(out), U64)
            for gap, (low, high) in enumerate(parts):
                total += (sums[high] + p - sums[low]) % p * inverse[parts[0][0] + gap] % p
            out |= (total % p) << U64(31 * i)
        return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and len+1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_null(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def runs(is_in: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross texts: starts, ends, and per
    text the number of the first run (len+1 numbers)."""
    n = len(is_in)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inner = offs[(offs > 0) & (offs < n)]
    first = is_in.copy()
    first[1:] &= ~is_in[:-1]
    first[inner] = is_in[inner]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    last[inner - 1] = is_in[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


class Words:
    """The words of a slab of texts. start, end: byte positions; first: per
    text the number of its first word (len+1 numbers); hash: 64 bits each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, hashed: bool = True):
        self.data, self.offs = data, offs
        self.start, self.end, self.first = runs(~WHITE[data], offs)
        if hashed:
            self.sums = prefix_hash(BYTE_CODES[data], BYTE_BASE)
            self.hash = range_hash(self.sums, self.start, self.end, BYTE_BASE, data)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(table: pa.Table | pa.RecordBatch, sizes: np.ndarray, limit: int):
    """Consecutive slices of about limit bytes; a larger row stands alone."""
    at = 0
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    while at < table.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield table.slice(at, to - at)
        at = to


def trim() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and an
    executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library; it only frees later


def in_slabs(batches, text: str, limit: int):
    """Tables of whole rows with about limit bytes of text from Arrow batches."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(batch.schema.get_field_index(text)))[1])
        for part in slices(batch, sizes, limit):
            n = int(np.diff(text_bytes(part.column(part.schema.get_field_index(text)))[1]).sum())
            if held and size + n > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    trim()
