"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import gathered

#: Queries of one block (what is broadcast), bins of one histogram, candidate rows scored at a time.
QUERY_BLOCK, BINS, ROWS = 2048, 64, 1024
SCALE = 256.0


def _scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), at the largest double where that is none."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -np.finfo(float).max, np.finfo(float).max)


def _vectors(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scaled integer vectors of the batch's rows of dimension d."""
    col = batch.column(1)
    size = np.diff(np.asarray(col.offsets))
    values = np.asarray(col.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    at = np.asarray(col.offsets)[:-1][size == d]
    return batch.column(0).to_numpy(zero_copy_only=False)[size == d], _scaled(values[at[:, None] + np.arange(d)])


#: What a score beyond 64 bits counts as.
MOST = 2**63 - 1


def exact_products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as 64-bit integers; those beyond 64 bits are put at the nearest of -MOST and MOST."""
    most = [float(np.abs(m).max(initial=0)) for m in (c, q)]
    if most[0] * most[1] * max(1, c.shape[1]) < 2**52:
        return (c @ q.T).astype(np.int64)
    size = np.abs(c) @ np.abs(q).T
    low = [np.where(np.abs(m) < 2**63, m, 0).astype(np.int64) for m in (c, q)]
    out = low[0] @ low[1].T  # exact modulo 2^64, so exact wherever size says that the score fits
    for i, j in zip(*np.nonzero(~(size < 2.0**62)), strict=True):
        whole = sum(int(x) * int(y) for x, y in zip(c[i].tolist(), q[j].tolist(), strict=True))
        out[i, j] = max(-MOST, min(MOST, whole))
    return out


def _scores(batches: Iterator[pa.RecordBatch], block: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of candidate ids, integer scores against all queries, and the mask of pairs that count."""
    ids, dims, rows_of, mats = block
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            for d, rows, q in zip(dims, rows_of, mats, strict=True):
                found, c = _vectors(part, d)
                if len(found):
                    yield rows, found, exact_products(c, q), found[:, None] != ids[rows][None, :]


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row where is_query holds, the k other rows of highest inner product: query_id, rank, vec_id, score.

    Components are scaled to floor(256 * x) and scores are exact 64-bit integers; a score beyond 64 bits counts as the nearest
    of -(2^63 - 1) and 2^63 - 1. Ties go to the smaller id. A vector
    that is null or holds a null or non-finite component takes no part; vectors of different dimensions are not
    compared; a row with the query's own id is no candidate. Fewer than k candidates: all. Repeated rows count each. Rows without an id take no
    part; an empty table or one without queries gives an empty result; other columns are not read, so their names are free.

    Queries are taken in blocks of about QUERY_BLOCK (the only thing broadcast). For a block, every pass scores all
    rows in place and sends home counts only: BINS bins of each query's current score interval. The interval
    shrinks to the bin that holds the k-th value until that value, or a set of few rows above it, is known; then
    each task returns its rows that reach it, its own k best at most for each query, and a last ranking picks k. Several
    blocks write these rows to one table of the shared folder, so the plan does not grow with the queries.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    queries = good.filter("is_query").select("id", "v")
    good = good.select("id", "v")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x) * SCALE + 1) * (F.abs(x) * SCALE + 1))
    n_queries, = queries.agg(F.count("*")).first()
    longest, = good.agg(F.max(F.sqrt(square))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n_queries or longest is None:
        return empty
    blocks = -(-n_queries // QUERY_BLOCK)

    def parts() -> Iterator[DataFrame]:
        for b in range(blocks):
            rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow() if blocks > 1 else queries.toArrow()
            if rows.num_rows:
                yield _block(good, rows, longest, k)

    hits = gathered(parts(), "hits") if blocks > 1 else next(parts())
    best = Window.partitionBy("query_id", "_row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(good: DataFrame, rows: pa.Table, longest: float, k: int) -> DataFrame:
    spark = good.sparkSession
    order = np.argsort(ids := rows.column(0).to_numpy(), kind="stable")
    ids = ids[order]
    vecs = [_scaled(np.asarray(v, dtype=np.float64)) for v in rows.column(1).to_pylist()]
    vecs = [vecs[i] for i in order]
    size = np.array([len(v) for v in vecs])
    dims = sorted(set(size.tolist()))
    rows_of = [np.flatnonzero(size == d) for d in dims]
    mats = [np.array([vecs[i] for i in at]).reshape(len(at), d) for d, at in zip(dims, rows_of, strict=True)]
    block = spark.sparkContext.broadcast((ids, dims, rows_of, mats))
    bound = np.array([np.sqrt((v * v).sum()) for v in vecs]) * longest * (1 + 1e-9) + 1
    bound = np.array([MOST if not x < MOST else min(MOST, int(np.ceil(x))) for x in bound.tolist()], np.int64)
    # the k-th value lies from low to low + span, which may take 64 bits; above: rows of higher scores
    low, span, above = -bound, 2 * bound.astype(np.uint64), np.zeros(len(ids), np.int64)
    done = np.zeros(len(ids), bool)
    while not done.all():
        state = spark.sparkContext.broadcast((low, span, width := span // np.uint64(BINS) + np.uint64(1), done))
        hist = np.zeros((len(ids), BINS), np.int64)
        counts = good.mapInArrow(_histogram(block, state), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
        hist[counts.column("q").to_numpy(), counts.column("bin").to_numpy()] = counts.column("n").to_numpy()
        down = above[:, None] + np.cumsum(hist[:, ::-1], 1)[:, ::-1]  # rows in this bin or above
        for q in np.flatnonzero(~done):
            if down[q, 0] <= 4 * k:  # few enough: take them all
                done[q] = True
                continue
            b = int(np.flatnonzero(down[q] >= k)[-1])
            above[q] = down[q, b + 1] if b + 1 < BINS else above[q]
            begin, size = b * int(width[q]), int(width[q])
            low[q] = int(low[q]) + begin
            span[q] = min(int(span[q]) - begin, size - 1)
            done[q] = size == 1 or down[q, b] <= 4 * k
    least = spark.sparkContext.broadcast(low)
    return good.mapInArrow(_select(block, least, k), "_row int, query_id long, vec_id long, score long")


def _histogram(block, state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, span, width, done = state.value
        hist = np.zeros(len(low) * BINS, np.int64)
        for rows, _, s, counts in _scores(batches, block.value):
            live = np.flatnonzero(~done[rows])
            if not len(live):
                continue
            q = rows[live]
            near = s[:, live]
            past = near.astype(np.uint64) - low[q].astype(np.uint64)  # modulo 2^64
            ok = counts[:, live] & (near >= low[q]) & (past <= span[q])
            b = np.where(ok, past // width[q], np.uint64(0)).astype(np.int64)
            hist += np.bincount((b + q * BINS)[ok], minlength=len(hist))
        at = np.flatnonzero(hist)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array((at // BINS).astype(np.int32)), pa.array((at % BINS).astype(np.int32)), pa.array(hist[at])], ["q", "bin", "n"])

    return run


def _select(block, least, k):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, ids = least.value, block.value[0]
        best = np.zeros((0, 3), np.int64)  # query row, score, id
        for rows, found, s, counts in _scores(batches, block.value):
            i, j = np.nonzero(counts & (s >= low[rows]))
            best = np.concatenate([best, np.stack([rows[j], s[i, j], found[i]], 1)])
            best = best[np.lexsort((best[:, 2], -best[:, 1], best[:, 0]))]
            start = np.searchsorted(best[:, 0], best[:, 0])
            best = best[np.arange(len(best)) - start < k]
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best[:, 0].astype(np.int32)), pa.array(ids[best[:, 0]]), pa.array(best[:, 2]), pa.array(best[:, 1])], ["_row", "query_id", "vec_id", "score"])

    return run
