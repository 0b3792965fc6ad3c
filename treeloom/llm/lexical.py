"""Ranked lexical search: dual-sorted wavelet trees per shard, best-first node intersection for the exact top k."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import gathered, kept
from .textkit import LOWER, HashTable, flat, hash_spans, padded, spans, steps

#: Queries of one block, whose terms are broadcast; postings of a shard's tree; nodes that are opened at a time.
QUERY_BLOCK, SHARD_POSTINGS, OPENED = 2048, 1_000_000, 128
#: Bytes between terms: ASCII that is neither digit nor letter.
BETWEEN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_CAPITALS = {c: c + 32 for c in range(65, 91)}
#: Groups in which a shard's hits are ranked before all meet.
SPREAD = 16


def terms(text: str | None) -> list[str]:
    """The terms of a text in order, A-Z in lower case."""
    return _TERM.findall((text or "").translate(_CAPITALS))


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array(words, pa.string()))
    return hash_spans(padded(data), offsets[:-1], np.diff(offsets))


def _counted(table):
    """Number of terms of each text, and the sought ones with their frequencies; by 64-bit hashes of the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = HashTable(table.value)
        for b in batches:
            data, offsets = flat(b.column(1))
            for i, j in steps(offsets):
                low = LOWER[data[offsets[i] : offsets[j]]]
                begin, length, bounds = spans(low, offsets[i : j + 1] - offsets[i], BETWEEN)
                place = sought.find(hash_spans(padded(low), begin, length))
                n = np.diff(bounds)
                row = np.repeat(np.arange(j - i), n)
                hit = place >= 0
                key, count = np.unique(row[hit] << 32 | place[hit], return_counts=True)
                ends = pa.array(np.searchsorted(key >> 32, np.arange(j - i + 1)).astype(np.int32))
                ids = pa.ListArray.from_arrays(ends, pa.array((key & 0xFFFFFFFF).astype(np.int32)))
                counts = pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), ids, counts], ["doc_id", "n", "terms", "counts"])

    return run


class Shard:
    """The postings of some documents in a wavelet tree over document numbers.

    Every term's postings lie together, by descending impact; the tree splits them by the bits of the document number, level
    by level, and keeps that order in every node. So a term's range in a node is found from its parent's by two rank
    look-ups, and the first posting of the range is the largest impact of the documents below the node.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.lexsort((doc, -impact, term))
        doc, impact = doc[order], impact[order]
        bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.begin, self.end, self.n_docs = bounds[:-1], bounds[1:], n_docs
        self.levels = max(1, int(n_docs - 1).bit_length())
        n = len(doc)
        self.rank = np.zeros((self.levels, n + 1), np.int32)  # postings with bit 0 before a position
        self.impact = np.zeros((self.levels + 1, n + 1), np.int64)
        self.zeros = np.zeros(self.levels, np.int64)
        self.impact[0, :n] = impact
        for k in range(self.levels):
            bit = doc >> (self.levels - 1 - k) & 1
            np.cumsum(bit == 0, out=self.rank[k, 1:])
            self.zeros[k] = self.rank[k, n]
            order = np.concatenate([np.flatnonzero(bit == 0), np.flatnonzero(bit)])
            doc, impact = doc[order], impact[order]
            self.impact[k + 1, :n] = impact

    def top(self, term: np.ndarray, weight: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k documents of highest score sum(weight * impact) that is at least `least`, ties to smaller numbers.

        Nodes wait by their bound: the sum of the weighted largest impacts of the terms that occur below. The best ones are
        opened, OPENED at a time; a document is a node whose bound is its score. A node goes once k documents are known
        that come before all below it, so nothing is opened that cannot hold one of the k.
        """
        some = self.end[term] > self.begin[term]
        term, weight = term[some], weight[some]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(term):
            return docs, scores
        lo, hi = self.begin[term][None, :], self.end[term][None, :]
        level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = (self.impact[0, lo] * weight).sum(1)
        while len(bound):
            if len(bound) > OPENED:
                near = np.argpartition(-bound, OPENED)
                at, later = near[:OPENED], near[OPENED:]
            else:
                at, later = np.arange(len(bound)), np.zeros(0, np.int64)
            lv, fi = level[at], first[at]
            zero_lo, zero_hi = self.rank[lv[:, None], lo[at]], self.rank[lv[:, None], hi[at]]
            zeros = self.zeros[lv][:, None]
            new_lo = np.concatenate([zero_lo, lo[at] - zero_lo + zeros])
            new_hi = np.concatenate([zero_hi, hi[at] - zero_hi + zeros])
            new_level = np.concatenate([lv + 1, lv + 1])
            new_first = np.concatenate([fi, fi + (1 << (self.levels - 1 - lv))])
            new_bound = np.where(new_hi > new_lo, self.impact[new_level[:, None], new_lo] * weight, 0).sum(1)
            leaf = new_level == self.levels
            found = leaf & (new_bound >= least)
            if found.any():
                docs, scores = np.concatenate([docs, new_first[found]]), np.concatenate([scores, new_bound[found]])
                best = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[best], scores[best]
            level, first, bound = np.concatenate([level[later], new_level]), np.concatenate([first[later], new_first]), np.concatenate([bound[later], new_bound])
            lo, hi = np.concatenate([lo[later], new_lo]), np.concatenate([hi[later], new_hi])
            open_ = np.concatenate([np.ones(len(later), bool), ~leaf]) & (bound >= least)
            if len(docs) == k:
                open_ &= (bound > scores[-1]) | (bound == scores[-1]) & (first < docs[-1])
            level, first, bound, lo, hi = level[open_], first[open_], bound[open_], lo[open_], hi[open_]
        return docs, scores


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """What one of a term's weight adds to the score of a document of n terms in which it occurs tf times."""
    m = 100 - 25 + (25 * n * n_docs) // n_all
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _ranked(queries, n_docs: int, n_all: int, n_terms: int, k: int, keys: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = queries.value
        least = np.ones(len(sought), np.int64)  # what a document must reach to be among the k best of this task so far
        best = [np.zeros(0, np.int64) for _ in sought]
        held, postings = [], 0

        def searched() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.take(pa.compute.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end"))
            n = table.column("n").to_numpy()
            lists = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
            doc = np.repeat(np.arange(len(n)), np.diff(lists[0].offsets.to_numpy()))
            term, tf = (x.flatten().to_numpy() for x in lists)
            shard = Shard(doc, term, impacts(tf, n[doc], n_docs, n_all), len(n), n_terms)
            rows, docs, scores = [], [], []
            for q, (ids, weights) in enumerate(sought):
                found, score = shard.top(ids, weights, k, int(least[q]))
                if len(found):
                    best[q] = -np.sort(-np.concatenate([best[q], score]))[:k]
                    least[q] = best[q][-1] if len(best[q]) == k else 1
                    rows.append(np.full(len(found), q, np.int32))
                    docs.append(found)
                    scores.append(score)
            if rows:
                ids = table.column("doc_id").combine_chunks().take(pa.array(np.concatenate(docs)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), ids.cast(keys), pa.array(np.concatenate(scores))], ["_query", "doc_id", "score"])

        for b in batches:
            ends = b.column(b.schema.get_field_index("terms")).offsets.to_numpy()
            i = 0
            while i < b.num_rows:
                j = min(b.num_rows, max(i + 1, int(np.searchsorted(ends, ends[i] + SHARD_POSTINGS - postings, "right")) - 1))
                held.append(b.slice(i, j - i))
                postings += int(ends[j] - ends[i])
                i = j
                if postings >= SHARD_POSTINGS or i < b.num_rows:
                    yield from searched()
                    held, postings = [], 0
        if held:
            yield from searched()

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of items, the k documents of highest score above 0: item, rank, key, score.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))) over all documents with a term; its impact on a document follows
    `impacts`; a score sums weight * impact over the item's terms, repeated ones as often. Ties go to the smaller key, null
    keys last. Repeated rows of either table count each; null and empty texts have no terms, so such items have no rows and such documents no
    part in N; texts of any length count whole; without documents or terms the result is empty; other columns are not read.

    Items are taken in blocks of about QUERY_BLOCK rows, whose terms are broadcast. A pass over the documents where they lie
    writes the frequencies of the block's terms; each task cuts its documents into shards of about SHARD_POSTINGS
    postings, builds a wavelet tree of each in memory, and puts out the shard's best k for each item, but for those that cannot
    be among the task's. They are ranked in SPREAD groups and then together. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    blocks = -(-rows.count() // QUERY_BLOCK)
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    shape = f"item {kinds[1]}, rank int, doc_id {kinds[0]}, score long"

    def parts() -> Iterator[DataFrame]:
        for b in range(blocks):
            part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
            if (hits := _block(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), part, k, kinds)) is not None:
                yield hits

    out = gathered(parts(), "hits") if blocks > 1 else next(parts(), None)
    if out is None:
        out = spark.createDataFrame([], shape)
    return out.select(F.col("item").alias(item), "rank", F.col("doc_id").alias(key if key != item else "doc_id"), "score")


def _block(docs: DataFrame, part: DataFrame, k: int, kinds: tuple[str, str]) -> DataFrame | None:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    asked = [(r["item"], terms(r["text"])) for r in part.toLocalIterator()]
    words = sorted({t for _, ts in asked for t in ts})
    if not words:
        return None
    hashes = _hashes(words)
    place = {w: i for i, w in enumerate(words)}
    counted = docs.mapInArrow(_counted(spark.sparkContext.broadcast(hashes)), f"doc_id {kinds[0]}, n long, terms array<int>, counts array<long>")
    counted = kept(counted, "postings")
    n_docs, n_all = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_all:
        return None
    df = np.zeros(len(words), np.int64)
    for t, n in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[t] = n
    weights = np.array([weight_of(n_docs, int(n)) for n in df], np.int64)
    sought = []
    for _, ts in asked:
        ids, times = np.unique(np.array([place[t] for t in ts], np.int64), return_counts=True)
        useful = weights[ids] > 0
        sought.append((ids[useful], (weights[ids] * times)[useful]))
    keys = to_arrow_schema(spark.createDataFrame([], f"doc_id {kinds[0]}").schema).field(0).type
    hits = counted.filter(F.size("terms") > 0).mapInArrow(
        _ranked(spark.sparkContext.broadcast(sought), n_docs, n_all, len(words), k, keys), f"_query int, doc_id {kinds[0]}, score long"
    )
    best = lambda *by: Window.partitionBy("_query", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    hits = hits.withColumn("_group", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SPREAD)))
    hits = hits.withColumn("rank", F.row_number().over(best("_group"))).filter(F.col("rank") <= k)
    hits = hits.withColumn("rank", F.row_number().over(best())).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(asked)], f"_query int, item {kinds[1]}")
    return hits.join(F.broadcast(names), "_query").select("item", "rank", "doc_id", "score")
