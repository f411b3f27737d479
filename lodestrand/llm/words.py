"""Words of whole texts as numpy arrays.

A batch of texts is laid end to end in one byte buffer, with a newline after each
text, and everything below is vectorised over the words of that buffer. UTF-8 is
never decoded: both word patterns in use have ASCII separators only, so every byte
of 0x80 and above belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the mixing function and of the rolling hash.
M1, M2, BASE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA24BAED4963EE40B)
TOP = U64(0xFFFFFFFFFFFFFFFF)
CHUNK_BYTES = 2_000_000


def separator_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: Separators of ``[^\x20\x09-\x0D]+``.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
WORD_BYTES = separator_table(BLANKS)
#: A-Z to a-z, everything else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null becomes an empty text."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of ``batch`` with about ``limit`` bytes of text each; a longer text stands alone."""
    if not batch.num_rows:
        return
    texts = as_bytes(batch.column(column))
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, held = i, 0
        held += len(text) + 1
    yield batch.slice(begin), texts[begin:]


@dataclass
class Words:
    """Words of a batch of texts: byte ranges in ``buffer`` and, for each text, its range of words."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first[i] .. first[i + 1] are the words of text i

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(texts: list[bytes], word_bytes: np.ndarray = WORD_BYTES) -> Words:
    raw = b"\n".join(texts) + b"\n" + bytes(8)
    buffer = np.frombuffer(raw, dtype=np.uint8)
    inside = np.empty(len(raw) - 6, dtype=np.int8)
    inside[0] = 0
    inside[1:] = word_bytes[buffer[: len(raw) - 7]]
    inside[-1] = 0
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return Words(buffer, starts, ends, np.searchsorted(starts, begins))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit; works in place."""
    h ^= h >> U64(32)
    h *= M1
    h ^= h >> U64(29)
    h *= M2
    h ^= h >> U64(32)
    return h


_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hash of each word's bytes; the same word has the same hash everywhere."""
    view = np.ndarray((max(0, len(words.buffer) - 7),), dtype="<u8", buffer=words.buffer, strides=(1,))
    left = words.ends - words.starts
    h = left.astype(np.uint64) * BASE
    at, which = words.starts, None
    while True:
        part = view[at] & _KEEP[np.minimum(left, 8)]
        if which is None:
            h ^= part
            mix(h)
        else:
            h[which] = mix(h[which] ^ part)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(size: int, base: U64) -> np.ndarray:
    """base ** 0 .. base ** (size - 1) modulo 2 ** 64."""
    whole = 1 << max(16, int(size - 1).bit_length())
    return _powers(whole, int(base))[:size]


_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` values of ``h``: a rolling polynomial, then mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _power(len(h), BASE), out=total[1:])
    return mix((total[k:] - total[:-k]) * _power(n, _INVERSE))


def windows(words: Words, k: int) -> np.ndarray:
    """Positions of the words at which a run of ``k`` words of one text starts."""
    n = int(words.first[-1])
    inside = np.zeros(n + 1, dtype=np.int32)
    has = words.counts >= k
    np.add.at(inside, words.first[:-1][has], 1)
    np.add.at(inside, words.first[1:][has] - k + 1, -1)
    return np.flatnonzero(np.cumsum(inside[:n]))


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``k`` that starts at one of ``starts``."""
    step = np.zeros(n + k + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + k, -1)
    return np.cumsum(step)[:n] > 0
