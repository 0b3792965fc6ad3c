"""Lempel-Ziv phrase fingerprints: dictionary phrases of every text, hashed, by minimum-hash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, kept
from .textkit import STEP_BYTES, hash_spans, mix, padded

#: Registers of a signature, one byte each.
REGISTERS = 256

_U = np.uint64
_SALT = _U(0x9E3779B97F4A7C15)
_EDGE = "kind int, part int, doc_id {kind}, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double, text string"


def parse(data: bytes, known: dict[int, int], ends: np.ndarray | None = None) -> np.ndarray:
    """Where the phrases of the Lempel-Ziv (1978) parse end: each is the longest known phrase and a byte more. Linear in the bytes, whatever they repeat.

    known is the tree of phrases, filled here; known and ends may hold what a parse has found in the same beginning of data.
    """
    begin = int(ends[-1]) if ends is not None and len(ends) else 0
    rest = iter(data[begin:])
    left, node, new = [], 0, (len(known) + 1) << 8
    there, hint, put = known.setdefault, rest.__length_hint__, left.append
    for c in rest:
        if (node := there(node | c, new)) == new:
            new += 256
            node = 0
            put(hint())
    own = len(data) - np.array(left, np.int64)
    return np.concatenate([ends, own]) if begin else own


def parse_changed(data: bytes, same: int, known: dict[int, int], ends: np.ndarray) -> np.ndarray:
    """The parse of data, whose first `same` bytes are those of the text that gave known and ends; phrases that end there are not sought again."""
    n = int(np.searchsorted(ends, same, "right"))
    return parse(data, dict(islice(known.items(), n)), ends[:n])


def signatures(texts: list[bytes], ends: list[np.ndarray]) -> list[bytes]:
    """For each parsed text REGISTERS bytes, each of the least hash of the phrases that fall into that register; nothing if there is no phrase.

    A register without a phrase takes over another's, found by a walk that depends on the register alone, so two
    signatures agree in a register with about the Jaccard similarity of the sets of phrases.
    """
    count = np.array([len(e) for e in ends], np.int64)
    if not count.sum():
        return [b""] * len(texts)
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    last = np.concatenate([e + b for e, b in zip(ends, base[:-1], strict=True)])
    first = np.concatenate([[0], last[:-1]])
    own = np.flatnonzero(count)
    first[np.concatenate([[0], np.cumsum(count)])[own]] = base[own]
    h = hash_spans(padded(np.frombuffer(b"".join(texts), np.uint8)), first, last - first)
    none = np.iinfo(np.uint64).max
    least = np.full(len(texts) * REGISTERS, none, np.uint64)
    np.minimum.at(least, np.repeat(np.arange(len(texts)) * REGISTERS, count) + (h >> _U(56)).astype(np.int64), mix(h ^ _SALT) >> _U(1))
    full, turn = least != none, 1
    empty = np.flatnonzero(~full & np.repeat(count > 0, REGISTERS))
    while len(empty):
        register = empty % REGISTERS
        other = empty - register + (mix(register.astype(np.uint64) * _SALT + _U(turn)) >> _U(56)).astype(np.int64)
        hit = full[other]
        least[empty[hit]] = mix(least[other[hit]] + register[hit].astype(np.uint64))
        empty, turn = empty[~hit], turn + 1
    out = (mix(least) >> _U(56)).astype(np.uint8).reshape(-1, REGISTERS)
    return [out[i].tobytes() if n else b"" for i, n in enumerate(count.tolist())]


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard similarity of two sets of phrases, 0 to 1; chance agreements of single bytes are taken off. Two without phrases are alike."""
    if not a or not b:
        return float(a == b)
    same = int((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum()) / REGISTERS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


class _Step:
    """Texts parsed one after the other, each with its edited form once the next is known; signed together."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.ends: list[np.ndarray] = []
        self.size = 0

    def add(self, data: bytes, ends: np.ndarray) -> int:
        self.texts.append(data)
        self.ends.append(ends)
        self.size += len(data)
        return len(self.texts) - 1

    def parsed(self, text: str) -> tuple:
        known: dict[int, int] = {}
        data = text.encode()
        ends = parse(data, known)
        return text, data, known, ends, self.add(data, ends)

    def edited(self, row: tuple, after: str) -> int:
        text, data, known, ends, at = row
        half = len(text) // 2
        left = text[: len(text) - half]
        other = (left + after[:half]).encode()
        return at if other == data else self.add(other, parse_changed(other, len(left.encode()), known, ends))


def _row(step: _Step, signs: list[bytes], kind: int, part: int, key, n: int, own: int, edited: int, after: bytes) -> tuple:
    a, b = signs[own], signs[edited]
    return kind, part, key, n, hashlib.sha256(step.texts[edited]).hexdigest(), a, b, likeness(a, b), likeness(a, after), None


def _run(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first = TaskContext.get().partitionId(), None, None
        step, todo = _Step(), []

        def flush() -> pa.RecordBatch:
            signs = signatures(step.texts, step.ends)
            rows = [_row(step, signs, 0, part, key, n, own, edited, signs[after]) for key, n, own, edited, after in todo]
            if first is not None:
                rows.append((1, part, None, None, None, signs[0], None, None, None, first))
            return _batch(rows, schema)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = step.parsed(text or "")
                if last is None:
                    first = row[0]
                else:
                    todo.append((last[0], len(last[1][0]), last[1][4], step.edited(last[1], row[0]), row[4]))
                last = key, row
                if step.size > STEP_BYTES:
                    yield flush()
                    step, todo, first = _Step(), [], None
                    last = key, (*row[:4], step.add(row[1], row[3]))
        if last is not None:
            yield flush()
            yield _batch([(2, part, last[0], *(None,) * 6, last[1][0])], schema)

    return run


def _edge(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text, after, sign in zip(*(c.to_pylist() for c in b.columns), strict=True):
                step = _Step()
                row = step.parsed(text)
                other = step.edited(row, after)
                rows.append(_row(step, signatures(step.texts, step.ends), 0, 0, key, len(text), row[4], other, sign))
            yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many of the next row's first
    (or all it has). Next is the row that follows by descending key (null keys last; equal keys by a hash of the text, of
    equal rows any), and after the last one the first; the next row of a single row is itself. A fingerprint is the
    signature of a text's phrases in hex, empty for an empty text; null texts count as empty. Texts of any length are parsed whole, equal
    texts have equal fingerprints, other columns are not read, and an empty table gives an empty result.

    Rows are range partitioned by key, so that all but each partition's last row find the next one beside them; that row
    meets the first one of the following partition by a join of one row a partition. Texts are moved once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    hashed, number = fresh(docs, "hashed", "number")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias(hashed), F.monotonically_increasing_id().alias(number))
    order = [F.desc_nulls_last("doc_id"), F.col(hashed), F.col(number)]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    shape = _EDGE.format(kind=kind)
    schema = to_arrow_schema(spark.createDataFrame([], shape).schema)
    found = kept(rows.mapInArrow(_run(schema), shape), "fingerprints")
    parts = sorted(r[0] for r in found.filter("kind = 1").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following int")
    first = found.filter("kind = 1").select(F.col("part").alias("following"), F.col("text").alias("after"), F.col("print").alias("after_print"))
    edge = found.filter("kind = 2").select("part", "doc_id", "text").join(follows, "part").join(first, "following").select("doc_id", "text", "after", "after_print")
    out = found.filter("kind = 0").unionByName(edge.mapInArrow(_edge(schema), shape))
    hexed = lambda c: F.lower(F.hex(c))
    return out.select(F.col("doc_id").alias(key), "n_chars", "edited_sha256", hexed("print").alias("fingerprint"), hexed("edited_print").alias("edited_fingerprint"), "near_edited", "near_next")
