"""Near-duplicates: ProbMinHash signatures of weighted word shingles, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import fresh, join_hot, kept
from .textkit import LOWER, STEP_ROWS, WHITE, flat, hash_spans, mix, padded, spans, steps

#: Words of a shingle; probability Jaccard similarity of counted shingles from which documents are near-duplicates.
WORDS, SIMILARITY = 5, 0.8
#: Bands and registers of a band. A pair at 0.8 shares no band with probability (1 - 0.8^6)^40 = 5e-6.
BANDS, ROWS = 40, 6
#: Shingles and sets that a verification task holds of each of its one or two blocks, about.
BLOCK_SHINGLES, BLOCK_SETS = 4_000_000, 512
#: Buckets of 32,768 bits of the filter that is broadcast: 512 KB.
FILTER_BUCKETS = 128

_U = np.uint64
_ID_BITS = 28
_ID = _U((1 << _ID_BITS) - 1)
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row as 48-bit hashes: row, hash, count; sorted by row and hash. Then each row's 64-bit hash of them all.

    Words are runs between ASCII white space, A-Z lowered. A row of fewer than WORDS words is one shingle. A row's number
    takes 16 bits of the key that is sorted, so steps() has no more rows.
    """
    if len(offsets) - 1 > STEP_ROWS:
        raise ValueError(f"{len(offsets) - 1} rows in one step; at most {STEP_ROWS} can be told apart")
    low = LOWER[data]
    begin, length, bounds = spans(low, offsets, WHITE)
    word = hash_spans(padded(low), begin, length)
    n = np.diff(bounds)
    rows, sums = [], []
    long = np.flatnonzero(n >= WORDS)
    if len(long):
        m = n[long] - WORDS + 1
        at = np.repeat(bounds[long] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        rows.append(np.repeat(long, m))
        sums.append(sum(word[at + k] * _ODD[k] for k in range(WORDS)))
    for size in range(1, WORDS):
        short = np.flatnonzero(n == size)
        if len(short):
            rows.append(short)
            sums.append(sum(word[bounds[short] + k] * _ODD[k] for k in range(size)) + _U(size))
    whole = np.zeros(len(n), np.uint64)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), whole
    row, hashed = np.concatenate(rows), mix(np.concatenate(sums))
    np.add.at(whole, row, mix(hashed ^ _ODD[2]))
    key = row.astype(np.uint64) << _U(48) | hashed >> _U(16)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    return (key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1), count, whole


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray | None, n_rows: int, registers: int) -> np.ndarray:
    """ProbMinHash: for each row and register, the element whose arrival comes first (28 bits of it).

    Every element is a Poisson process of rate weight (1 if None) that depends on the element alone; each arrival goes to a random
    register, and an element stops as soon as its time is past the latest register of its row. Two rows agree in a
    register with the probability Jaccard similarity of their weights; with equal weights this is the Jaccard similarity.
    Arrivals are drawn in rounds of 1, 2, 4, ... for all elements that still run.
    """
    state = np.full(n_rows * registers, np.iinfo(np.uint64).max, np.uint64)
    limit = np.full(n_rows, np.inf)
    live, now = np.arange(len(element)), np.zeros(len(element))
    base, k = 0, 1
    while len(live):
        part = max(1, (1 << 20) // k)
        for i in range(0, len(live), part):
            at = live[i : i + part]
            who = element[at]
            draw = mix(who[:, None] * _ODD[0] + (np.arange(base + 1, base + k + 1).astype(np.uint64) * _ODD[1])[None, :])
            gap = -np.log(((draw >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53)
            if weight is not None:
                gap /= weight[at][:, None]
            time = now[at][:, None] + np.cumsum(gap, 1)
            now[at] = time[:, -1]
            ok = time < limit[row[at]][:, None]
            register = ((mix(draw ^ _ODD[2]) >> _U(32)) * _U(registers)) >> _U(32)
            slot = (row[at] * registers)[:, None] + register.astype(np.int64)
            value = (time.view(np.uint64) & ~_ID) | (mix(who ^ _ODD[3]) & _ID)[:, None]
            np.minimum.at(state, slot[ok], value[ok])
        rows = np.unique(row[live])
        full = state.reshape(n_rows, registers)[rows].max(1)
        limit[rows] = np.where(full == np.iinfo(np.uint64).max, np.inf, (full | _ID).view(np.float64))
        live = live[now[live] < limit[row[live]]]
        base, k = base + k, min(2 * k, 1 << 12)
    return (state & _ID).reshape(n_rows, registers)


def bands(found: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each row and band of signatures."""
    parts = found.reshape(len(found), -1, rows)
    h = np.broadcast_to(mix(np.arange(parts.shape[1]).astype(np.uint64) + _ODD[4]), parts.shape[:2])
    for k in range(rows):
        h = mix((h ^ parts[:, :, k]) * _ODD[1])
    return h


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", weighted: bool = True) -> DataFrame:
    """For each row: key, body (hash of the text), row (a number), node (hash of its counted shingles), n, band keys, shingles and their counts.

    Shingles are the first 32 bits of their 48-bit hashes, ascending. Counts are 32-bit numbers, or nothing where all are 1 or with weighted=False.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            data, offsets = flat(b.column(1))
            for i, j in steps(offsets):
                m = j - i
                row, element, count, node = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bounds = np.searchsorted(row, np.arange(m + 1))
                n = np.diff(bounds)
                if not weighted:
                    count = np.ones_like(count)
                    node = np.zeros(m, np.uint64)
                    np.add.at(node, row, mix(element + _ODD[2]))
                several = np.zeros(m, bool)
                several[row[count > 1]] = True
                node = mix(node + n.astype(np.uint64) * _ODD[3]).view(np.int64)
                sign = signatures(row, element, count.astype(float) if several.any() else None, m, BANDS * ROWS)
                keys = bands(sign).view(np.int64)
                lists = np.where(n > 0, BANDS, 0)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32()), pa.array(keys[n > 0].reshape(-1)))
                sets = _binary(4 * n, (element >> _U(16)).astype(np.uint32))
                counts = _binary(np.where(several, 4 * n, 0), count.astype(np.uint32)[several[row]] if len(row) else np.zeros(0, np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, m), b.column(2).slice(i, m), pa.array(number + np.arange(m)), pa.array(node), pa.array(n.astype(np.int32)), keys, sets, counts],
                    ["key", "body", "row", "node", "n", "bands", "shingles", "counts"],
                )
                number += m

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    return rows.mapInArrow(run, f"key {kind}, body long, row long, node long, n int, bands array<long>, shingles binary, counts binary")


def _binary(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def probability_jaccard(x: np.ndarray, y: np.ndarray, whole_x: float, whole_y: float) -> float:
    """The similarity of two weighted sets from the weights x and y of their common elements and the sums of all their weights.

    It is the sum over common i of 1 / sum over all j of max(x_j / x_i, y_j / y_i). With the elements sorted by x / y, the
    inner sum is one of x before i and one of y behind it.
    """
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order] / whole_x, y[order] / whole_y
    before, behind = np.cumsum(x), np.cumsum(y[::-1])[::-1] - y
    return float((1 / ((before + max(0.0, 1 - x.sum())) / x + (behind + max(0.0, 1 - y.sum())) / y)).sum())


def spanning_links(node: np.ndarray, size: np.ndarray, ids: np.ndarray, weight: np.ndarray | None = None, part: np.ndarray | None = None, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the exact similarity graph of some weighted sets: every pair of sets is compared, or already connected.

    ids (and weight, None: all 1) hold all sets one after the other; part has equal numbers for sets that are known to be
    connected. A pivot is compared with all others at once; only links that join two components are put out. It is over
    when all sets that have not been pivots lie in one component.
    """
    n = len(node)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    _, local = np.unique(ids, return_inverse=True)
    local = local.reshape(-1)
    mine = np.zeros(int(local.max(initial=0)) + 1)
    part = np.arange(n) if part is None else np.unique(part, return_inverse=True)[1].reshape(-1)
    sums = size.astype(float) if weight is None or not n else np.add.reduceat(weight, begin)
    plain = sums == size
    shares = None if weight is None or plain.all() else weight / np.repeat(sums, size)
    pivot = np.zeros(n, bool)
    links = []
    while True:
        free = np.flatnonzero(~pivot)
        if not len(free):
            break
        names, counts = np.unique(part[free], return_counts=True)
        if len(names) == 1 and (n < 2 or pivot.any() or (part == part[0]).all()):
            break
        p = int(free[part[free] == names[np.argmin(counts)]][0])
        pivot[p] = True
        own = slice(begin[p], begin[p] + size[p])
        mine[local[own]] = 1.0 if weight is None else weight[own]
        seen = mine[local]
        common = np.add.reduceat(seen > 0, begin)
        bound = common / (size + size[p] - common)
        if shares is not None:  # between weighted sets, the sum of the lesser shares is never less than the similarity
            bound = np.where(plain & plain[p], bound, np.add.reduceat(np.minimum(seen / sums[p], shares), begin))
        near = np.flatnonzero((bound >= least * (1 - 1e-12)) & (part != part[p]))
        for q in near.tolist():
            if part[q] == part[p]:
                continue
            if not (plain[q] and plain[p]):
                at = np.flatnonzero(seen[begin[q] : begin[q] + size[q]] > 0) + begin[q]
                if probability_jaccard(seen[at], weight[at], sums[p], sums[q]) < least * (1 - 1e-12):
                    continue
            links.append((int(node[p]), int(node[q])))
            part = np.where(part == part[q], part[p], part)
        mine[local[own]] = 0.0
    return links


def _weights(sizes: np.ndarray, counts: list[bytes]) -> np.ndarray | None:
    if not any(counts):
        return None
    return np.concatenate([np.frombuffer(c, np.uint32).astype(float) if c else np.ones(n) for n, c in zip(sizes.tolist(), counts, strict=True)])


def _verify(table: pa.Table) -> pa.Table:
    size = table.column("n").to_numpy().astype(np.int64)
    ids = np.frombuffer(b"".join(x.as_py() for x in table.column("shingles")), np.uint32)
    weight = _weights(size, table.column("counts").to_pylist())
    links = spanning_links(table.column("node").to_numpy(), size, ids, weight, table.column("part").to_numpy())
    return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})


def _with_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether a row's set is near its pivot's, whose shingles and counts are the last two columns."""
    for b in batches:
        near = []
        for sh, co, ps, pc in zip(*(b.column(c).to_pylist() for c in ("shingles", "counts", "p_shingles", "p_counts")), strict=True):
            x, y = np.frombuffer(ps, np.uint32), np.frombuffer(sh, np.uint32)
            wx, wy = (np.frombuffer(c, np.uint32).astype(float) if c else np.ones(len(v)) for c, v in ((pc, x), (co, y)))
            _, i, j = np.intersect1d(x, y, return_indices=True)
            near.append(bool(len(i)) and probability_jaccard(wx[i], wy[j], wx.sum(), wy.sum()) >= SIMILARITY * (1 - 1e-12))
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(near, pa.bool_())], [*b.schema.names[:-2], "linked"])


def _bits(df: DataFrame, column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BUCKETS * 32768))


def _only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows whose node may be among nodes, by a bit table of fixed size: a chance hit costs shuffle, no node is lost."""
    bits = nodes.select(_bits(nodes, "node").alias("b")).groupBy((F.col("b") / 32768).cast("int").alias("bucket")).agg(F.expr("bitmap_construct_agg(b % 32768)").alias("bits")).collect()
    table = np.zeros((FILTER_BUCKETS, 4096), np.uint8)
    for bucket, found in bits:
        table[bucket] = np.frombuffer(bytes(found), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(table.reshape(-1))
    at = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = b.column(at).to_numpy()
            keep = (shared.value[bit >> 3] >> (bit & 7)) & 1
            out = b.filter(pa.array(keep.astype(bool)))
            yield pa.RecordBatch.from_arrays(out.columns[:at], out.schema.names[:at])

    return rows.withColumn("_bit", _bits(rows, "node")).mapInArrow(run, rows.schema)


def _labels(rows: DataFrame) -> DataFrame:
    """node, label for all nodes linked to others, from sketched rows: candidates by bands, verified exactly."""
    keys = rows.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("band", "least")
    stars = keys.distinct().join(shared, "band").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    groups = components(stars, "candidates")
    groups = groups.unionByName(groups.select(F.col("label").alias("node"), "label").distinct())
    members = _only(rows.select("node", "row", "n", "shingles", "counts"), groups)
    first = members.groupBy("node").agg(F.min("row").alias("row"))
    members = members.join(first, ["node", "row"]).join(groups, "node")
    members = kept(members.select("node", "label", "n", "shingles", "counts"), "members")
    sums = members.groupBy("label").agg(F.ceil(F.greatest(F.sum(F.col("n").cast("long")) / BLOCK_SHINGLES, F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    tasks = members.withColumn("part", F.col("node")).withColumn("_pair", F.lit("all"))
    if sums.filter("blocks > 2").isEmpty():
        return components(_links(tasks), "classes")
    sized = join_hot(members, sums, "label")
    tasks = sized.filter("blocks <= 2").drop("blocks").withColumn("part", F.col("node")).withColumn("_pair", F.lit("all"))
    known, links = _by_pivots(sized.filter("blocks > 2").drop("blocks"))
    # the sets of a group meet in blocks; where these are many, only those that share a band do
    known = kept(known, "parts")
    many = known.groupBy("label").agg(F.ceil(F.greatest(F.sum(F.col("n").cast("long")) / BLOCK_SHINGLES, F.count("*") / BLOCK_SETS)).alias("blocks")).filter(F.col("blocks") > MOST_BLOCKS).select("label", F.lit(True).alias("many"))
    if many.isEmpty():
        entries = known.withColumnRenamed("label", "group")
    else:
        known = join_hot(known, many, "label", "left")
        by_band = keys.distinct().join(shared.select("band"), "band").join(known.filter("many"), "node").select("node", "n", "part", F.col("band").alias("group"))
        entries = kept(known.filter("many IS NULL").select("node", "n", "part", F.col("label").alias("group")).unionByName(by_band), "entries")
    # of a group's parts, those outside the largest meet it and each other
    of_part = entries.groupBy("group", "part").agg(F.count("*").alias("sets"), F.sum(F.col("n").cast("long")).alias("n"))
    whole = of_part.groupBy("group").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("sets", "part")).alias("largest"), F.max(F.struct("sets", "part", "n"))["n"].alias("n_largest"), F.max("sets").alias("most"), F.sum("sets").alias("sets"), F.sum("n").alias("n")).filter("parts > 1")
    size = lambda n, sets: F.ceil(F.greatest(n / BLOCK_SHINGLES, sets / BLOCK_SETS)).cast("int")
    whole = whole.select("group", "largest", size(F.col("n_largest"), F.col("most")).alias("known"), size(F.col("n") - F.col("n_largest"), F.col("sets") - F.col("most")).alias("open"))
    dealt = join_hot(entries, whole, "group")
    number = F.xxhash64(F.lit("block"), "node")
    its_known, its_open = (F.pmod(number, F.col(c)).cast("string") for c in ("known", "open"))
    to = lambda c: F.transform(F.sequence(F.lit(0), F.col(c) - 1), lambda i: i.cast("string"))
    few = F.col("known") + F.col("open") <= 2
    pairs = F.when(few, F.array(F.lit("one"))).when(F.col("part") == F.col("largest"), F.transform(to("open"), lambda i: F.concat(its_known, F.lit("k"), i))).otherwise(
        F.concat(F.transform(to("known"), lambda i: F.concat(i, F.lit("k"), its_open)), F.transform(to("open"), lambda i: F.concat(F.least(i, its_open), F.lit("o"), F.greatest(i, its_open))))
    )
    met = dealt.select("node", F.col("group").alias("label"), "part", F.explode(pairs).alias("_pair"))
    more = met.join(members.select("node", "n", "shingles", "counts"), "node").select(*tasks.columns)
    return components(_links(tasks.unionByName(more)).unionByName(links), "classes")


#: Pivots that a group meets one after the other, at most; blocks of a group from which only sets that share a band meet.
PIVOTS, MOST_BLOCKS = 6, 40


def _by_pivots(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label, n, part for every set; links): sets of large groups and the parts that they are known to belong to.

    Every set is compared with its group's pivot where it lies; those near it are one part, and the others meet a new pivot, until
    no group has more of them than a block, a pivot takes less than a tenth of them, or PIVOTS times. What is left are parts of their own.
    """
    left, parts, links = large, [], []
    before = None
    for _ in range(PIVOTS):
        pivots = left.groupBy("label").agg(F.min_by(F.struct("node", "shingles", "counts"), "node").alias("p"))
        pivots = pivots.select("label", F.col("p.node").alias("part"), F.col("p.shingles").alias("p_shingles"), F.col("p.counts").alias("p_counts"))
        judged = join_hot(left, pivots, "label").select("node", "label", "n", "shingles", "counts", "part", "p_shingles", "p_counts")
        judged = kept(judged.mapInArrow(_with_pivot, "node long, label long, n int, shingles binary, counts binary, part long, linked boolean"), "judged")
        near = judged.filter("linked OR node = part")
        parts.append(near.select("node", "label", "n", "part"))
        links.append(near.filter("node <> part").select(F.col("node").alias("u"), F.col("part").alias("v")))
        left = judged.filter("NOT linked AND node <> part").drop("part", "linked")
        most, now = (x or 0 for x in left.groupBy("label").count().agg(F.max("count"), F.sum("count")).first())
        if most <= BLOCK_SETS or now > 0.9 * (before or judged.count()):
            break
        before = now
    parts.append(left.select("node", "label", "n", F.col("node").alias("part")))
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, links)


def _links(tasks: DataFrame) -> DataFrame:
    return tasks.select("label", "_pair", "node", "n", "shingles", "counts", "part").groupBy("label", "_pair").applyInArrow(_verify, "u long, v long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): sketched rows (key, body, row, node), and for each node its class: class_id, class_rows, and the row that stays.

    A class is a connected component of the graph that links documents whose five-word shingles, weighted by their
    counts, have a probability Jaccard similarity of 0.8 or more (with equal weights: Jaccard similarity); class_id is its smallest key.
    With weighted=False every shingle weighs the same.

    Equal weighted sets collapse to one node first, so copies cost nothing later. Candidate groups (components of shared
    bands) are compared exactly. A group of up to two blocks is one task's. In a larger one, every member is first compared
    with pivots where it lies; those near one are one part (_by_pivots). Then the largest part and the others meet in blocks; in a
    group of more than MOST_BLOCKS, only sets that share a band do, so one that is linked by chains is not compared in all pairs.
    Tasks put out spanning forests: links number fewer than nodes, and no link that would join two classes is lost.
    """
    rows = kept(sketches(docs, key, text, weighted), "sketches")
    labels = kept(_labels(rows), "labels")
    nodes = rows.groupBy("node").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "body", "row")).alias("first"), F.min("key").alias("least"), F.count("*").alias("rows"))
    nodes = kept(nodes, "nodes")
    linked = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
    linked = kept(linked.join(nodes, "node"), "linked")
    whole = linked.groupBy("label").agg(F.min("first").alias("_first"), F.min("least").alias("class_id"), F.sum("rows").alias("class_rows"), F.count("*").alias("class_texts"))
    own = join_hot(linked.select("node", "label"), whole, "label").drop("label")
    found = nodes.join(own, "node", "left").select(
        "node",
        F.coalesce("class_id", "least").alias("class_id"),
        F.coalesce("class_rows", "rows").alias("class_rows"),
        F.coalesce("class_texts", F.lit(1)).alias("class_texts"),
        F.coalesce("_first", "first").alias("stays"),
    )
    return rows.select("key", "body", "row", "node", "n"), found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", weighted: bool = True) -> DataFrame:
    """One row for every row of docs: key, class_id, class_rows, class_texts (different weighted sets), n_shingles, stays.

    stays holds for exactly one row of each class, one with the smallest key. Texts without words (null, empty, blank) have no shingles
    and form one class. Null keys and repeated rows are rows like others; a class without any key has a null class_id.
    Other columns are not read, so their names are free; texts of any length are shingled whole; an empty table gives an empty result.
    """
    rows, found = classes(docs, key, text, weighted)
    out = join_hot(rows, found, "node")
    return out.select(F.col("key").alias(key), "class_id", "class_rows", "class_texts", F.col("n").alias("n_shingles"), (F.col("row") == F.col("stays.row")).alias("stays"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, without those that near_duplicates would not let stay.

    Of a class stays the row with the smallest key (null keys last), then the smallest hash of its text. Where such a row is
    repeated with equal key and text, one of them stays, chosen by its other columns; these may be of any type, maps too, and
    of any name. Null and empty texts are one class; texts of any length count whole; an empty table gives an empty one.
    """
    rows, found = classes(docs, key, text)
    stay = kept(found.select("stays.key", "stays.body"), "stay")
    twice = rows.groupBy("key", "body").count().filter("count > 1")
    twice = twice.join(stay, twice["key"].eqNullSafe(stay["key"]) & (twice["body"] == stay["body"]), "left_semi")
    body, its_key, its_body, one = fresh(docs, "body", "its_key", "its_body", "one")
    own = docs.withColumn(body, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    wanted = stay.select(F.col("key").alias(its_key), F.col("body").alias(its_body)).distinct()
    out = own.join(wanted, F.col(key).eqNullSafe(F.col(its_key)) & (F.col(body) == F.col(its_body)), "left_semi")
    if not twice.isEmpty():  # equal keys and texts: combined in each task before any shuffle
        whole = F.struct(*[F.col(c) for c in docs.columns])
        out = out.groupBy(key, body).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(one)).select(f"{one}.*")
    return out.select(*docs.columns)
