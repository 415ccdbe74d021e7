"""Words of many texts at once, as numpy arrays over the bytes of an Arrow string column.

Every byte of a UTF-8 sequence beyond ASCII is 0x80 or more, so a word class that is given by ASCII
code points (and takes all others) can be decided byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
#: [^\x20\x09-\x0D]+
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z have become lower case
ALNUM = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
_FOLD = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_Q = 0xD1342543DE82EF95
_Q_INV = pow(_Q, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """A polynomial hash of values[start:end] for each span, from one running sum."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(inverse, n + 1)[starts] + (ends - starts).astype(np.uint64))


def chained(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = mix((h ^ hashes[at + k]) * np.uint64(_Q))
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its rows in them; nulls are empty."""
    column = column.fill_null("") if pa.types.is_string(column.type) else column.cast(pa.string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@lru_cache(maxsize=4)
def _draws(key: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.random.default_rng([key, lane]).integers(0, 1 << 64, size, dtype=np.uint64) for lane in (0, 1))


def draws(key: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two random numbers for each place of a word of at most n bytes; longer draws begin with the shorter ones."""
    return _draws(key, 1 << max(8, (n - 1).bit_length()))


def spans_hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """64 bits of each span of bytes; spans are not empty."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    units = raw[place + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)
    high, low = (np.add.reduceat(units * draw[place], first) for draw in draws(key, int(sizes.max())))
    return (high & np.uint64(0xFFFFFFFF00000000)) | (low >> np.uint64(32))


@dataclass
class Words:
    raw: np.ndarray  # bytes, lower-cased where asked
    docs: np.ndarray  # row i has bytes docs[i]:docs[i + 1]
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # row i has words first[i]:first[i + 1]

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(which, distinct): word i is distinct[which[i]]. Words are told apart by their bytes, not by a hash of them."""
        if not len(self.starts):
            return np.zeros(0, np.int64), pa.array([], pa.large_binary())
        cuts = np.stack((self.starts, self.ends), axis=1).reshape(-1).astype(np.int64)  # a word, what lies between, a word ..
        tiles = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(self.raw))])
        told = tiles.dictionary_encode()
        which = told.indices.to_numpy()[::2]
        is_word = np.zeros(len(told.dictionary), bool)
        is_word[which] = True
        return (np.cumsum(is_word) - 1)[which], told.dictionary.filter(pa.array(is_word))

    def hashes(self, key: int = 0) -> np.ndarray:
        """64 bits of each word by two multilinear hashes of its bytes: with a secret key, two different words agree with probability 2**-64."""
        return spans_hashed(self.raw, self.starts, self.ends, key)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), np.diff(self.first))

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) of the n-word windows that lie in one row, and their hashes."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))
        at = np.flatnonzero(left >= n)
        return at, span_hash(hashes, at, at + n, _Q, _Q_INV)

    def chains(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """As windows(), by a chain of mixings: no sum of word hashes decides it, so words can't be chosen to balance."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))
        at = np.flatnonzero(left >= n)
        return at, chained(hashes, at, n)


def words_of(column: pa.Array, is_word: np.ndarray, fold: bool) -> Words:
    raw, docs = text_bytes(column)
    if fold:
        raw = _FOLD[raw]
    inside = is_word[raw]
    edge = np.empty(len(raw) + 1, dtype=bool)
    edge[:] = False
    edge[docs] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(raw, docs, starts, ends, np.searchsorted(starts, docs))
