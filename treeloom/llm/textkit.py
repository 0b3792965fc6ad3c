"""Flat-array text handling: words, spans and hashes of a whole Arrow batch without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; a longer document forms a step of its own.
STEP_BYTES = 2 << 20
#: Rows of a step at most, so that a row's number fits 16 bits.
STEP_ROWS = (1 << 16) - 1

_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_U = np.uint64


def _table(codes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(codes)] = True
    return out


#: ASCII white space: blank and the codes 9 to 13.
WHITE = _table([32, *range(9, 14)])
#: White space and every other ASCII code that is neither letter, digit nor underscore.
NON_WORD = _table(c for c in range(128) if not (chr(c).isalnum() or chr(c) == "_"))
#: A-Z to a-z, other bytes unchanged.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 (two bytes from C3 80 to C3 9E, but the sign C3 97) in lower case."""
    low = LOWER[data]
    if len(data) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        at = at[(data[at] <= 0x9E) & (data[at] != 0x97)]
        low[at] += 32
    return low


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `limit` bytes, of at most STEP_ROWS rows."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(i + STEP_ROWS, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes not in the table `outside`, none across rows: starts, lengths, and each row's bounds in these."""
    inside = ~outside[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[(offsets > 0) & (offsets < len(data))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1 - begin, np.searchsorted(begin, offsets)


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position of padded data, as little-endian integers."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def hash_spans(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of padded data, by its bytes alone."""
    view = eights(data)
    h = (length.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
    todo, at, left = None, begin, length
    while len(at):
        part = view[at] & _KEEP[np.minimum(left, 8)]
        if todo is None:
            h = mix(h ^ part)
            todo = np.flatnonzero(length > 8)
        else:
            h[todo] = mix(h[todo] ^ part)
            todo = todo[left > 8]
        done = 8 * (1 + (length[todo[0]] - left[left > 8][0]) // 8) if len(todo) else 0
        at, left = begin[todo] + done, length[todo] - done
    return h


def prefix_hash(data: np.ndarray, begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """A hash of each span's first n bytes, n at most 8; 0 where the span is shorter."""
    return np.where(length >= n, mix((eights(data)[begin] & _KEEP[n]) ^ _U(n * 0x9E3779B97F4A7C15 & (2**64 - 1))), _U(0))


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the given spans, one after the other."""
    ends = np.cumsum(length)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    full = np.flatnonzero(length)
    if not len(full):
        return out[:0]
    out[0] = begin[full[0]]
    out[ends[full[:-1]]] = begin[full[1:]] - (begin[full[:-1]] + length[full[:-1]] - 1)
    return np.cumsum(out)


class SpanCache:
    """Lists of ids by the hash of a span, kept between batches; at most about `limit` spans and 8 * limit ids, then it starts anew."""

    def __init__(self, limit: int = 1_500_000) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, encode) -> np.ndarray:
        """The slot of every span of padded data; encode(begin, length) gives ids and bounds of spans not known yet.

        Spans are told apart by a 64-bit hash.
        """
        h, first, back = np.unique(hash_spans(data, begin, length), return_index=True, return_inverse=True)
        if len(self.keys) + len(h) > self.limit or len(self.ids) > 8 * self.limit:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != h) if len(self.keys) else np.arange(len(h))
        if len(new):
            ids, bounds = encode(begin[first[new]], length[first[new]])
            place = np.searchsorted(self.keys, h[new])
            self.slot = np.insert(self.slot, place, np.arange(len(self.begin), len(self.begin) + len(new), dtype=np.int32))
            self.keys = np.insert(self.keys, place, h[new])
            self.begin = np.concatenate([self.begin, len(self.ids) + bounds[:-1]])
            self.length = np.concatenate([self.length, np.diff(bounds).astype(np.int32)])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        return self.slot[np.searchsorted(self.keys, h)][back]

    def expand(self, slots: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the spans, and each row's bounds in them, where bounds are the rows' bounds in the spans."""
        n = self.length[slots]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[ranges(self.begin[slots], n)], ends[bounds]


class HashTable:
    """Places of distinct 64-bit hashes by open addressing, for vectorised look-ups."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.place, self.keys = np.full(1 << self.bits, -1, np.int32), keys
        todo, slot = np.arange(len(keys)), (keys >> _U(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.place[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            self.place[at] = todo[free[first]]
            left = np.ones(len(todo), bool)
            left[free[first]] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the table's keys, -1 for others."""
        out, todo, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys >> _U(64 - self.bits)).astype(np.int64)
        while len(todo):
            place = self.place[slot]
            hit = (place >= 0) & (self.keys[place] == keys[todo]) if len(self.keys) else place >= 0
            out[todo[hit]] = place[hit]
            more = ~hit & (place >= 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out
