"""Encoding and decoding with a sentencepiece BPE model by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import SpanCache, flat, padded, ranges, steps

#: Fixed values of the model format: what stands for a blank, what an unknown id decodes to, and the kinds of pieces.
BLANK, UNKNOWN_TEXT = "▁", " ⁇ "
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A character that is no piece of its own has the number RAW + its code point while merging.
RAW = 1 << 17
NONE = np.iinfo(np.int32).max


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protocol buffer message."""
    i, n = 0, len(buf)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[i]
            value, shift, i = value | (b & 127) << shift, shift + 7, i + 1
            if b < 128:
                return value, i

    while i < n:
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            size, i = varint(i)
            value, i = buf[i : i + size], i + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, i = buf[i : i + size], i + size
        yield tag >> 3, value


class PieceBpe:
    """A sentencepiece BPE model with identity normalisation, a dummy prefix blank and byte fallback."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.text: list[str] = []
        scores, kinds = [], []
        for number, value in fields:
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2 or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not trainer.get(35, 0):
            raise ValueError("only BPE models without normalisation, with dummy prefix and byte fallback, are supported")
        kinds = np.array(kinds)
        if np.isin(kinds, (USER, UNUSED)).any():
            raise ValueError("user-defined and unused pieces are not supported")
        self.bos, self.eos = (next(i for i, t in enumerate(self.text) if t == s and kinds[i] == CONTROL) for s in ("<s>", "</s>"))
        self.byte = np.zeros(256, np.int64)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte[int(self.text[i][3:5], 16)] = i
        self.rank = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int32)
        known = {self.text[i]: int(i) for i in np.flatnonzero(kinds == NORMAL)}
        self._tables(known)
        out = [b"" if kinds[i] == CONTROL else UNKNOWN_TEXT.encode() if kinds[i] == UNKNOWN else bytes([int(t[3:5], 16)]) if kinds[i] == BYTE else t.replace(BLANK, " ").encode() for i, t in enumerate(self.text)]
        self.out_len = np.array([len(x) for x in out])
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)[:-1]])
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.blank = np.array([t.startswith(BLANK) for t in self.text])
        self.cache = SpanCache()

    def _tables(self, known: dict[str, int]) -> None:
        self.symbol = RAW + np.arange(0x110000, dtype=np.int64)
        for t, i in known.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i
        self.symbol[32] = self.symbol[ord(BLANK)]
        pairs: dict[int, int] = {}
        risky = np.zeros(len(self.rank), bool)
        for t, i in known.items():
            if len(t) > 1 and ("\n" in t or " " in t or BLANK in t.lstrip(BLANK)):
                raise ValueError("pieces across words are not supported")
            for k in range(1, len(t)):
                l, r = t[:k], t[k:]
                for part in (l, r):  # once this part is merged, a pair that ranks as high may come into being
                    if part in known and self.rank[known[part]] >= self.rank[i]:
                        risky[known[part]] = True
                a, b = (known.get(x, self.symbol[ord(x)] if len(x) == 1 else -1) for x in (l, r))
                if a >= 0 and b >= 0:
                    pairs[int(a) << 21 | int(b)] = i
        same = np.bincount(self.rank)
        self.alone = risky | (same[self.rank] > 1)  # merged one at a time
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.slot_key, self.slot_id = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for key, i in pairs.items():
            at = int(self._slot(np.array([key]))[0])
            while self.slot_key[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slot_key[at], self.slot_id[at] = key, i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 where none does."""
        key = left << 21 | right
        out, todo, at = np.full(len(key), -1, np.int64), np.arange(len(key)), self._slot(key)
        while len(todo):
            found = self.slot_key[at]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_id[at[hit]]
            more = ~hit & (found >= 0)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def _symbols(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all characters and the span that each belongs to."""
        at = ranges(begin, length)
        lead = data[at]
        starts = (lead & 0xC0) != 0x80
        at, lead = at[starts], lead[starts].astype(np.int64)
        code = lead.copy()
        for n, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
            k = np.flatnonzero((lead >= low) & (lead < high))
            value = lead[k] & bits
            for j in range(1, n):
                value = value << 6 | (data[at[k] + j] & 0x3F)
            code[k] = value
        return self.symbol[code], np.repeat(np.arange(len(begin)), length)[starts]

    def encode_spans(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given spans of padded UTF-8, and the bounds of each span's ids.

        A round merges, in every span, the pair of best score: all its occurrences from the left if no merge
        of that kind can bring up a pair as good, else only the first one. Spans without such a pair leave.
        """
        sym, span = self._symbols(data, begin, length)
        done_sym, done_span = [], []
        pair = np.full(len(sym), -1, np.int64)
        same = np.flatnonzero(span[:-1] == span[1:])
        pair[same] = self._merged(sym[same], sym[same + 1])
        while len(sym):
            cost = np.where(pair >= 0, self.rank[pair], NONE)
            head = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1]]))
            size = np.diff(np.concatenate([head, [len(sym)]]))
            best = np.repeat(np.minimum.reduceat(cost, head), size)
            over = best == NONE
            if over.any():
                done_sym.append(sym[over])
                done_span.append(span[over])
                live = ~over
                sym, span, pair, cost, best = sym[live], span[live], pair[live], cost[live], best[live]
                if not len(sym):
                    break
            at = np.flatnonzero(cost == best)
            index = np.arange(len(at))
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            first = np.concatenate([[True], span[at[1:]] != span[at[:-1]]])
            take = (index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0
            at = at[np.where(self.alone[pair[at]], first, take)]
            sym[at] = pair[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, span, pair = sym[keep], span[keep], pair[keep]
            at = at - np.arange(len(at))
            near = np.unique(np.concatenate([at, at[at > 0] - 1]))
            pair[near] = -1
            near = near[near + 1 < len(sym)]
            near = near[span[near] == span[near + 1]]
            pair[near] = self._merged(sym[near], sym[near + 1])
        sym, span = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_span))
        order = np.argsort(span, kind="stable")
        sym, span = sym[order], span[order]
        raw = np.flatnonzero(sym >= RAW)
        if len(raw):
            parts = [self.byte[np.frombuffer(chr(c).encode(), np.uint8)] for c in (sym[raw] - RAW).tolist()]
            n = np.ones(len(sym), np.int64)
            n[raw] = [len(p) for p in parts]
            sym, span = np.repeat(sym, n), np.repeat(span, n)
            sym[sym >= RAW] = np.concatenate(parts)
        return sym, np.searchsorted(span, np.arange(len(begin) + 1))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of UTF-8 text, without begin and end ids, and each row's bounds in them."""
        blank = BLANK.encode()
        if blank in data.tobytes():
            rows = [data[a:b].tobytes().replace(blank, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        size = np.diff(offsets)
        offsets = np.concatenate([[0], np.cumsum(size + (size > 0))])
        whole = np.full(offsets[-1], 32, np.uint8)  # each text after the dummy blank
        whole[ranges(offsets[:-1] + 1, size)] = data
        space, line = whole == 32, whole == 10
        start = line.copy()
        start[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
        start[offsets[:-1][size > 0]] = True
        begin = np.flatnonzero(start)
        length = np.diff(np.concatenate([begin, [len(whole)]]))
        whole = padded(whole)
        slots = self.cache.find(whole, begin, length, lambda b, n: self.encode_spans(whole, b, n))
        return self.cache.expand(slots, np.searchsorted(begin, offsets))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 text of rows of ids and its offsets: pieces joined, control ids dropped, the dummy blank taken off.

        Byte ids are joined as they are; ids that came from encode always make whole characters.
        """
        n = self.out_len[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        text, offsets = self.out[ranges(self.out_at[ids], n)], ends[bounds]
        said = np.concatenate([[0], np.cumsum(n > 0)])
        full = np.flatnonzero(np.diff(offsets))
        first = np.searchsorted(said, said[bounds[full]] + 1) - 1  # each row's first id that is no control id
        cut = full[self.blank[ids[first]]]
        keep = np.ones(len(text), bool)
        keep[offsets[cut]] = False
        gone = np.zeros(len(offsets), np.int64)
        gone[cut + 1] = 1
        return text[keep], offsets - np.cumsum(gone)


@lru_cache(maxsize=2)
def model(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Every whole text encoded with begin and end ids and decoded again: key, n_tokens, ids_sha256, decoded_sha256[, ids].

    Null counts as empty, which gives the begin and end ids. Any row gives a row: repeated rows give equal ones, null keys and ties are
    passed on as they are, an empty table gives none; texts of any length are encoded whole. Other columns are not read, so their names are free.
    The work is row by row: no shuffle, and memory bounded by one step of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        begin, end = (struct.pack("<I", i) for i in (bpe.bos, bpe.eos))
        for b in batches:
            data, offsets = flat(b.column(1))
            for i, j in steps(offsets):
                found, at = bpe.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                back, ends = bpe.decode(found, at)
                raw, back = memoryview(found.astype("<u4").view(np.uint8)), memoryview(back)
                sums = [(hashlib.sha256(b"".join((begin, raw[4 * at[k] : 4 * at[k + 1]], end))).hexdigest(), hashlib.sha256(back[ends[k] : ends[k + 1]]).hexdigest()) for k in range(j - i)]
                cols = [b.column(0).slice(i, j - i), pa.array(np.diff(at) + 2), pa.array([s[0] for s in sums]), pa.array([s[1] for s in sums])]
                if ids:
                    n = np.diff(at) + 2
                    bounds = np.concatenate([[0], np.cumsum(n)])
                    whole = np.empty(bounds[-1], np.int32)
                    whole[bounds[:-1]], whole[bounds[1:] - 1] = bpe.bos, bpe.eos
                    whole[ranges(bounds[:-1] + 1, n - 2)] = found
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(whole)))
                yield pa.RecordBatch.from_arrays(cols, [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(key, text).mapInArrow(run, schema)
