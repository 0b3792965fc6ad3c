"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, kept
from .textkit import WHITE, SpanCache, flat, padded, spans, steps

#: Pieces that one group is meant to hold.
GROUP_PIECES = 4096
#: Sequence ids of group g are g * GROUP_IDS + 0, 1, ...
GROUP_IDS = 1 << 24
#: New words that are handed to the tokenizer at a time; each takes about 1 KB there.
STEP_WORDS = 4096


class Bins:
    """Bins of equal capacity; a tournament tree over their free space finds the first that has room."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.used = capacity, 0
        self.leaves = 1 << max(0, (max(1, most) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and the offset there."""
        free, at = self.free, 1
        if not 0 < size <= self.capacity or free[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        found, offset = at - self.leaves, self.capacity - free[at]
        free[at] -= size
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        self.used = max(self.used, found + 1)
        return found, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, placed from the largest to the smallest, ties in the given order."""
    bins, where, offset = Bins(capacity, len(sizes)), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        where[i], offset[i] = bins.place(int(sizes[i]))
    return where, offset


class WordTokens:
    """Ids of texts by a `tokenizers` file that never joins what white space divides, with ids of known words kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), SpanCache()

    def _encode(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = memoryview(data)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(begin), STEP_WORDS):
            part = zip(begin[i : i + STEP_WORDS].tolist(), length[i : i + STEP_WORDS].tolist(), strict=True)
            found = [e.ids for e in self.tokenizer.encode_batch([str(raw[a : a + n], "utf-8") for a, n in part], add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in found], np.int64))
            ids.append(np.fromiter((i for x in found for i in x), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, length, bounds = spans(data, offsets, WHITE)
        data = padded(data)
        slots = self.cache.find(data, begin, length, lambda b, n: self._encode(data, b, n))
        return self.cache.expand(slots, bounds)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """The token pieces of every whole text and its end id, cut at multiples of capacity: key, start, length, ids_crc32, doc_tokens[, ids]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for b in batches:
            data, offsets = flat(b.column(1))
            for i, j in steps(offsets):
                found, at = tokens.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(at) + 1
                ends = np.cumsum(n)
                whole = np.full(ends[-1], end_id, "<u4")
                mask = np.ones(len(whole), bool)
                mask[ends - 1] = False
                whole[mask] = found
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(j - i), pieces)
                start = capacity * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                size = np.minimum(capacity, n[row] - start)
                first = (ends - n)[row] + start
                raw = memoryview(whole.view(np.uint8))
                crc = np.array([zlib.crc32(raw[4 * a : 4 * (a + s)]) for a, s in zip(first.tolist(), size.tolist(), strict=True)], np.int64)
                cols = [b.column(0).slice(i, j - i).take(pa.array(row)), *map(pa.array, (start, size, crc, n[row]))]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(whole)]]), pa.int32()), pa.array(whole.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, [key, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, {PIECES}" + ", ids array<int>" * ids)


def pack(pieces: DataFrame, capacity: int = 4096, key: str = "doc_id", seed: int = 5) -> DataFrame:
    """pieces (with key, start, length, other columns as they are) with sequence_id and offset: no sequence holds more than capacity tokens.

    Pieces are dealt by a seeded hash of key, start and content into about rows / GROUP_PIECES groups; each group is packed by
    first-fit decreasing on its own, so no group grows with the input and a document of any length spreads over many. A
    group leaves about one sequence part empty. Equal lengths are placed in the order of content, key (nulls last) and start.
    Repeated rows have equal hashes: where that makes a group of over 4 * GROUP_PIECES pieces, its pieces are dealt again
    by their place in the stored table, so they spread like others. An empty table gives no row.
    """
    at, group, mark = fresh(pieces, "_at", "_group", "_large")
    cols = pieces.columns
    pieces = kept(pieces.withColumn(at, F.monotonically_increasing_id()), "pieces")
    groups = max(1, round(pieces.count() / GROUP_PIECES))
    number = F.xxhash64(F.lit(seed), F.col(key), F.col("start"), *[F.col(c) for c in ("ids_crc32",) if c in cols])
    dealt = pieces.withColumn(group, F.pmod(number, F.lit(groups)).cast("long"))
    large = dealt.groupBy(group).count().filter(F.col("count") > 4 * GROUP_PIECES).select(group)
    if groups > 1 and not large.isEmpty():  # few rows: repeats alone make a group large
        again = F.pmod(F.xxhash64(F.lit(seed), F.col(at)), F.lit(groups)).cast("long")
        marked = dealt.join(large.withColumn(mark, F.lit(True)), group, "left")
        dealt = marked.withColumn(group, F.when(F.col(mark), again).otherwise(F.col(group)))

    def run(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in ("ids_crc32", key, "start", at) if c in table.column_names)]
        table = table.take(pc.sort_indices(table, sort_keys=order))
        where, offset = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        ids = table.column(group).to_numpy() * GROUP_IDS + where
        return pa.table([*(table.column(c) for c in cols), pa.array(ids, pa.int64()), pa.array(offset, pa.int64())], [*cols, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in dealt.select(*cols).dtypes) + ", sequence_id long, offset long"
    return dealt.select(*cols, at, group).groupBy(group).applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's tokens in sequences: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id, so a null or empty text is one piece of one token. Each id lies in exactly one piece,
    and a text of any length is cut whole. Keys keep their type and value beside null keys; repeated rows and null keys are
    documents like others; other columns are not read, so their names are free; an empty table gives no row.
    """
    return pack(cut(docs, path, capacity, end_id, key, text), capacity, key)
