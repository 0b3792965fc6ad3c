"""Repair of conversations: the cheapest edits that give turns a lawful order of roles, by Dijkstra on an implicit lattice."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import join_hot, kept

#: Rows of a conversation that one search takes; a longer conversation is cut into pieces of as many.
PIECE_ROWS = 256
#: Grammar of role initials, `(s?(ua)+)?`: the state after an initial in a state. States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, ACCEPTING = (0, 1, 2, 3), (0, 3)
#: The role that an inserted or changed row gets in a state.
WANTED = {0: "user", 1: "user", 3: "user", 2: "assistant"}
_WHITE = " \t\n\x0b\x0c\r"
#: Faults of a row.
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
_TOKEN = re.compile("I*[DKR]")
_RESULT = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@lru_cache(maxsize=1 << 16)
def cheapest(rows: tuple[tuple[str, int], ...], start: int = 0, all_ends: bool = False) -> dict[int, tuple[int, str]]:
    """Cost and audit of the cheapest edits of rows (role initial, fault) from a state: to the best accepting state, or to each state.

    Nodes are (rows taken, state); they wait by (cost, audit), so of equally cheap edits the first by ASCII is popped first.
    Edges: insert a row of the wanted role (I, 2), delete (D, 3), keep if the grammar allows (K, 0), change the role to the
    wanted one (R, 2); a truncated row that stays costs 1 more, and blank and duplicate rows must be deleted.
    """
    n, found, seen = len(rows), {}, set()
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == n and (all_ends or state in ACCEPTING):
            found[state] = cost, audit
            if not all_ends or len(found) == len(STATES):
                break
        wanted = STEP[state, WANTED[state][0]]
        heappush(heap, (cost + 2, audit + "I", i, wanted))
        if i == n:
            continue
        initial, fault = rows[i]
        heappush(heap, (cost + 3, audit + "D", i + 1, state))
        if fault < BLANK:
            if (state, initial) in STEP:
                heappush(heap, (cost + fault, audit + "K", i + 1, STEP[state, initial]))
            heappush(heap, (cost + 2 + fault, audit + "R", i + 1, wanted))
    return found


def lattice(rows: tuple[tuple[str, int], ...]) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and audit of a piece between any two states that some edits lead between."""
    return {(a, b): best for a in STATES for b, best in cheapest.__wrapped__(rows, a, True).items()}


def composed(pieces: list[dict[tuple[int, int], tuple[int, str]]]) -> dict[tuple[int, int], tuple[int, str]]:
    """The lattice of pieces one after the other. Neighbours are joined pairwise, so an audit is copied once for each doubling."""
    while len(pieces) > 1:
        joined = []
        for p, q in zip(pieces[::2], pieces[1::2], strict=False):
            out: dict[tuple[int, int], tuple[int, str]] = {}
            for (a, m), (c1, x) in p.items():
                for b in STATES:
                    if (m, b) in q:
                        c2, y = q[m, b]
                        if (a, b) not in out or (c1 + c2, x + y) < out[a, b]:
                            out[a, b] = c1 + c2, x + y
            joined.append(out)
        pieces = joined + pieces[2 * len(joined) :]
    return pieces[0]


class Repaired:
    """Figures of a conversation whose rows come in order, with the SHA-256 of its repaired text; holds no row."""

    def __init__(self, audit: str) -> None:
        self.tokens, self.audit, self.at, self.state = _TOKEN.finditer(audit), audit, 0, 0
        self.sum, self.any, self.last, self.illegal = hashlib.sha256(), False, "", 0
        self.least = self.most = self.turn = None
        self.turns = self.rows = 0

    def _put(self, line: str) -> None:
        self.sum.update(("\n" + line if self.any else line).encode())
        self.any = True

    def _inserted(self, n: int) -> None:
        for _ in range(n):
            self._put(f"{WANTED[self.state]}:")
            self.state = STEP[self.state, WANTED[self.state][0]]

    def row(self, turn: int | None, role: str, text: str) -> None:
        edits = next(self.tokens)
        self.at = edits.end()
        self._inserted(self.at - edits.start() - 1)
        edit = self.audit[self.at - 1]
        if edit != "D":
            role_now = role if edit == "K" else WANTED[self.state]
            self.state = STEP[self.state, role_now[:1]]
            self._put(f"{role_now}:{text}")
        self.illegal += self.rows > 0 and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        self.rows += 1
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
            self.turns += 1

    def close(self) -> tuple[int, int, str]:
        """Gaps (at most 2^63 - 1), illegal neighbours and the hash."""
        self._inserted(len(self.audit) - self.at)
        gaps = 0 if self.least is None else min(2**63 - 1, self.most - self.least + 1 - self.turns)
        return gaps, self.illegal, self.sum.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped), flaw: rows damaged by crc32(`conv_id:turn`) % 20, see `repair`; null roles and texts are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    now = F.when(how == 1, "").when(how == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    copies = F.when(how == 0, 0).when(how == 3, 2).otherwise(1)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(how == 4, "user").otherwise(text("role")).alias("role"), now.alias("text"), copies.alias("copies"))
    end = F.rtrim("text", F.lit(_WHITE))
    return out.withColumn("flaw", F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN))


def _counts(rows: Iterable[tuple[str, int]]) -> list[int]:
    faults = [f for _, f in rows]
    return [faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)]


def _whole(schema: pa.Schema):
    """Repairs of conversations whose rows come one after the other, in order."""

    def judged(key, rows: list[tuple]) -> tuple:
        seen, codes, lines = set(), [], []
        for turn, role, text, copies, flaw in rows:
            for _ in range(copies):
                codes.append((role[:1], flaw if flaw == BLANK else DUPLICATE if (role, text) in seen else flaw))
                seen.add((role, text))
                lines.append((turn, role, text))
        cost, audit = next(iter(cheapest(tuple(codes)).values()))
        out = Repaired(audit)
        for line in lines:
            out.row(*line)
        gaps, illegal, sha = out.close()
        return (key, gaps, *_counts(codes), illegal, cost, audit, sha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            done = []
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and k != key:
                    done.append(judged(key, rows))
                    rows = []
                key = k
                rows.append(row)
            if done:
                yield _batch(done, schema)
        if rows:
            yield _batch([judged(key, rows)], schema)

    return run


def _pieces(schema: pa.Schema):
    """Lattices of at most PIECE_ROWS rows of one conversation that come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begin, codes = None, None, []

        def piece() -> tuple:
            ways = [(a, b, c, x) for (a, b), (c, x) in lattice(tuple(codes)).items()]
            return (key, begin, *([w[i] for w in ways] for i in range(4)), *_counts(codes))

        for b in batches:
            done = []
            for k, at, initial, fault, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if codes and (k != key or len(codes) >= PIECE_ROWS):
                    done.append(piece())
                    codes = []
                if not codes:
                    key, begin = k, at
                codes += [(initial, fault), (initial, fault if fault == BLANK else DUPLICATE)][:copies]
            if done:
                yield _batch(done, schema)
        if codes:
            yield _batch([piece()], schema)

    return run


def _composed(table: pa.Table) -> pa.Table:
    """One row of a conversation's pieces: cost, audit and counts."""
    table = table.sort_by("at")
    ways = [{(a, b): (c, x) for a, b, c, x in zip(*w, strict=True)} for w in zip(*(table.column(i).to_pylist() for i in range(2, 6)), strict=True)]
    whole = composed(ways)
    cost, audit = min(whole[0, b] for b in ACCEPTING if (0, b) in whole)
    sums = [pa.array([sum(table.column(i).to_pylist())], pa.int64()) for i in (6, 7, 8)]
    return pa.table([table.column(0).slice(0, 1), pa.array([cost], pa.int64()), pa.array([audit]), *sums], names=["conv_id", "cost", "audit", "blank", "duplicate", "truncated"])


def _long(schema: pa.Schema):
    """Results of conversations in order, each begun by the row that holds its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, out = None, None

        def close() -> tuple:
            gaps, illegal, sha = out.close()
            key, cost, audit, *counts = head
            return (key, gaps, *counts, illegal, cost, audit, sha)

        for b in batches:
            done = []
            for key, at, turn, role, text, copies, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at < 0:
                    if out is not None:
                        done.append(close())
                    head, out = (key, *more), Repaired(more[1])
                else:
                    for _ in range(copies):
                        out.row(turn, role, text)
            if done:
                yield _batch(done, schema)
        if out is not None:
            yield _batch([close()], schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(df: DataFrame, shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)


def _in_order() -> list:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


def _of_long(rows: DataFrame, kind: str) -> DataFrame:
    """The results of damaged rows of long conversations, each of which may hold most rows.

    Rows are range partitioned in order, so a conversation lies over many tasks; a row is a duplicate if the first place of
    its role and text is before it. Pieces of PIECE_ROWS rows become lattices where they lie, and a conversation's
    lattices are composed, which is no more than a few times its audit. Then its rows stream past its audit once, as
    SHA-256 takes a text in order; only a row is held.
    """
    rows = rows.repartitionByRange(*_in_order()).sortWithinPartitions(*_in_order()).withColumn("at", F.monotonically_increasing_id())
    rows = kept(rows.withColumn("same", F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text"))), "turns")
    there = rows.filter("copies > 0")
    first = there.groupBy("same").agg(F.min("at").alias("first"))
    codes = join_hot(there.select("conv_id", "at", "same", F.left("role", F.lit(1)).alias("initial"), "flaw", "copies"), first, "same")
    fault = F.when((F.col("flaw") < BLANK) & (F.col("first") < F.col("at")), DUPLICATE).otherwise(F.col("flaw"))
    codes = codes.select("conv_id", "at", "initial", fault.alias("fault"), "copies").repartitionByRange("at").sortWithinPartitions("at")
    shape = f"conv_id {kind}, at long, a array<int>, b array<int>, cost array<long>, audit array<string>, blank long, duplicate long, truncated long"
    pieces = kept(codes.mapInArrow(_pieces(_schema(rows, shape)), shape), "pieces")
    heads = pieces.groupBy("conv_id").applyInArrow(_composed, f"conv_id {kind}, cost long, audit string, blank long, duplicate long, truncated long")
    none = lambda *cs: [F.lit(None).cast("long" if c != "audit" else "string").alias(c) for c in cs]
    heads = heads.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), "cost", "audit", "blank", "duplicate", "truncated")
    lines = there.select("conv_id", "at", "turn", "role", "text", "copies", *none("cost", "audit", "blank", "duplicate", "truncated"))
    both = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    shape = _RESULT.format(kind=kind)
    return both.mapInArrow(_long(_schema(rows, shape)), shape)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (`damaged`): of 20 of a hash of `conv_id:turn`, 0 drops a row, 1 empties its text, 2 removes
    its `.!?`, 3 repeats it, 4 makes it the user's. Then a conversation's rows count by turn, nulls first; rows of equal turn by role, then text. A null
    conv_id is a conversation; null roles and texts are one space, so such a text is blank. Texts of any length are hashed
    whole; repeated rows are duplicates; a conversation without rows after the damage has zeros, an empty audit and the hash of an empty text;
    other columns are not read; an empty table gives an empty result. Gaps stop at 2^63 - 1.

    Conversations of at most PIECE_ROWS rows go to a task whole, sorted, and are searched one after the other (`cheapest`); longer
    ones are cut (`_of_long`), so none is held as a whole.
    """
    kind = dict(rows.dtypes)[conv]
    rows = damaged(rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("_rows"), F.sum("copies").alias("_left"))
    large = kept(sizes.filter(F.col("_rows") > PIECE_ROWS), "long-conversations")
    shape = _RESULT.format(kind=kind)
    whole = _whole(_schema(rows, shape))
    of = lambda df: df.repartition("conv_id").sortWithinPartitions(*_in_order()).mapInArrow(whole, shape)
    if large.isEmpty():
        return of(rows)
    key = F.coalesce(F.concat(F.lit("k"), F.col("conv_id").cast("string")), F.lit(""))
    marked = join_hot(rows.withColumn("_key", key), large.select(key.alias("_key"), "_left"), "_key", "left").drop("_key")
    # a long conversation that is dropped whole has no row to stream; it goes the plain way without its rows
    short = marked.filter(F.col("_left").isNull()).drop("_left")
    gone = large.filter("_left = 0").select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), F.lit(BLANK).alias("flaw"))
    return of(short.unionByName(gone)).unionByName(_of_long(marked.filter("_left > 0").drop("_left"), kind))
