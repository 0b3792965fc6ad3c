"""Log-bilinear language model trained by noise-contrastive estimation, and text scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept
from .textkit import LOWER, WHITE, HashTable, eights, flat, hash_spans, mix, padded, spans, steps

#: The model's outcomes: the end, WORDS frequent words, SUFFIXES classes of other words by their last bytes, and the rest.
WORDS, SUFFIXES = 1536, 510
SIZE = WORDS + SUFFIXES + 2
#: Dimensions of a word's vector.
DIM = 16
#: Rate, noise words of a batch and tokens of a batch: for the common start, then for all rows.
FIRST, THEN = (0.1, 64, 1024), (0.03, 32, 2048)
#: A word with at least 1/HEAD of all training tokens is looked up in a broadcast table, so that has HEAD rows at most; others are joined.
HEAD = 1 << 20
#: Tokens, about, on which one task finds the common start of all tasks' training, and turns it takes over them; tokens, about, and most number of
#: the shards that are then learnt from side by side, one turn each.
START_TOKENS, START_TURNS, SHARD_TOKENS, SHARDS = 1_000_000, 3, 2_000_000, 4096
_U = np.uint64


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, 16 bits of a hash of its last three bytes, and the rows' bounds; A-Z are lowered."""
    low = LOWER[data]
    begin, length, bounds = spans(low, offsets, WHITE)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), bounds
    low = padded(low)
    tail = eights(low)[begin + np.maximum(length - 3, 0)] & _U(0xFFFFFF)
    tail = np.where(length == 1, tail & _U(0xFF), np.where(length == 2, tail & _U(0xFFFF), tail))
    return hash_spans(low, begin, length), (mix(tail) >> _U(48)).astype(np.int32), bounds


def is_held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(5)) == 1, F.lit(False))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (its hash), suffix, n over all rows; the end of texts has word 0 and suffix -1. Summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, suffixes, sums, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0

        def merged():
            w, first, back = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
            return w, np.concatenate(suffixes)[first], np.bincount(back, np.concatenate(sums), len(w)).astype(np.int64)

        for b in batches:
            data, offsets = flat(b.column(0))
            ends += b.num_rows
            for i, j in steps(offsets):
                w, s, _ = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                w, first, n = np.unique(w, return_index=True, return_counts=True)
                words.append(w)
                suffixes.append(s[first])
                sums.append(n)
                if sum(map(len, words)) > 1_000_000:
                    w, s, n = merged()
                    if len(w) > 700_000:
                        yield batch(w, s, n)
                        w, s, n = w[:0], s[:0], n[:0]
                    words, suffixes, sums = [w], [s], [n]
        w, s, n = merged()
        yield batch(np.concatenate([w, [_U(0)]]), np.concatenate([s, [-1]]), np.concatenate([n, [ends]]))

    def batch(w, s, n):
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "suffix", "n"])

    rows = docs.select(text).mapInArrow(run, "word long, suffix int, n long").filter("n > 0")
    return rows.groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words with counts and outcomes, the outcome of each suffix, and the outcomes' weights."""

    words: np.ndarray  # hashes of head words
    counts: np.ndarray
    outcome: np.ndarray  # of each head word
    by_suffix: np.ndarray  # outcome of other words, by suffix
    total: int  # N: training tokens
    distinct: int  # V: distinct ones
    ends: int
    mass: np.ndarray  # for suffix outcomes: sum of (count + 1/2) over their words, + 1/2 for words never seen
    tokens: np.ndarray  # training tokens of each outcome

    def table(self) -> HashTable:
        return HashTable(self.words)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What the model needs of all words' counts; only words of HEAD or the model's own size come to the driver."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    ends = (counts.filter("word = 0 AND suffix = -1").agg(F.sum("n")).first()[0]) or 0
    real = counts.filter("suffix >= 0")
    top = real.orderBy(F.desc("n"), "word").limit(WORDS).select("word")
    head = real.filter(F.col("n") >= max(1, -(-total // HEAD))).select("word", "suffix", "n").toArrow()
    words = head.column("word").to_numpy().view(np.uint64)
    n, suffix = head.column("n").to_numpy(), head.column("suffix").to_numpy()
    order = np.argsort(words)
    words, n, suffix = words[order], n[order], suffix[order]
    frequent = np.sort(top.toArrow().column("word").to_numpy().view(np.uint64))
    own = np.searchsorted(frequent, words)
    is_own = (own < len(frequent)) & (frequent[np.minimum(own, max(len(frequent) - 1, 0))] == words) if len(frequent) else np.zeros(len(words), bool)
    sums = real.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("k")).toArrow()
    by_n, by_k = np.zeros(1 << 16), np.zeros(1 << 16)
    by_n[sums.column("suffix").to_numpy()], by_k[sums.column("suffix").to_numpy()] = sums.column("n").to_numpy(), sums.column("k").to_numpy()
    np.subtract.at(by_n, suffix[is_own], n[is_own])
    np.subtract.at(by_k, suffix[is_own], 1)
    by_suffix = np.full(1 << 16, SIZE - 1, np.int32)
    best = np.argsort(-by_n, kind="stable")[:SUFFIXES]
    by_suffix[best] = 1 + WORDS + np.arange(SUFFIXES)
    outcome = np.where(is_own, 1 + own, by_suffix[suffix]).astype(np.int32)
    mass = np.bincount(by_suffix, by_n + 0.5 * by_k, SIZE) + 0.5
    tokens = np.bincount(by_suffix, by_n, SIZE)
    tokens += np.bincount(outcome[is_own], n[is_own], SIZE) if is_own.any() else 0
    tokens[0] = ends
    return Vocabulary(words, n, outcome, by_suffix, total, distinct, ends, mass, tokens)


@dataclass
class Weights:
    """r: word vectors, q: vectors of predicted words, b: their biases, c: matrices of the two places before."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.b, self.c]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parts()])

    @staticmethod
    def of(x: np.ndarray) -> Weights:
        at = np.cumsum([0, SIZE * DIM, SIZE * DIM, SIZE, 2 * DIM * DIM])
        r, q, b, c = (x[i:j].astype(np.float32) for i, j in zip(at[:-1], at[1:], strict=True))
        return Weights(r.reshape(SIZE, DIM), q.reshape(SIZE, DIM), b, c.reshape(2, DIM, DIM))

    @staticmethod
    def start(share: np.ndarray) -> Weights:
        rng = np.random.default_rng(7)
        r, q = (rng.normal(0, 0.1, (SIZE, DIM)).astype(np.float32) for _ in range(2))
        return Weights(r, q, np.log(share).astype(np.float32), np.stack([np.eye(DIM, dtype=np.float32)] * 2))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of every outcome after every outcome one and two places before, and the log normaliser of every context."""
        one = (self.r @ self.c[0]) @ self.q.T + self.b
        two = (self.r @ self.c[1]) @ self.q.T
        a, z = one.max(1, keepdims=True), two.max(1, keepdims=True)
        norm = np.log(np.maximum(np.exp(one - a) @ np.exp(two - z).T, 1e-38)) + a + z.T
        return one, two, norm


def contexts(outcome: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outcomes one and two places before, and the outcome, of all tokens of rows, ends included; before a text stands the end."""
    n = np.diff(bounds)
    at = np.arange(len(outcome)) + np.repeat(np.arange(len(n)), n)
    whole = np.zeros(len(outcome) + len(n), np.int32)
    whole[at] = outcome
    first = bounds[:-1] + np.arange(len(n))
    one, two = np.zeros_like(whole), np.zeros_like(whole)
    one[1:], two[2:] = whole[:-1], whole[:-2]
    one[first] = two[first] = 0
    two[np.minimum(first + 1, len(whole) - 1)] = 0
    return one, two, whole


class Trainer:
    """Noise-contrastive estimation: tells tokens from draws of their shares, by AdaGrad."""

    def __init__(self, start: np.ndarray, share: np.ndarray, rate: float, noise: int, seed: int) -> None:
        self.noise = noise
        self.w, self.rate, self.rng = Weights.of(start), np.float32(rate), np.random.default_rng(seed)
        self.seen = [np.full(p.shape, 1.0, np.float32) for p in self.w.parts()]
        self.noise_log = np.log(noise * share).astype(np.float32)
        self.cum = np.cumsum(share)

    def _add(self, k: int, rows: np.ndarray | None, grad: np.ndarray) -> None:
        p, seen = self.w.parts()[k], self.seen[k]
        if rows is None:
            seen += grad * grad
            p += self.rate * grad / np.sqrt(seen)
            return
        order = np.argsort(rows.astype(np.int16), kind="stable")  # a radix sort
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total, rows = np.add.reduceat(grad[order], first, axis=0), rows[first]
        seen[rows] += total * total
        p[rows] += self.rate * total / np.sqrt(seen[rows])

    def learn(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> None:
        r, q, b, c = self.w.parts()
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(self.noise) * self.cum[-1]), SIZE - 1)
        x1, x2, qt, qn = r[one], r[two], q[word], q[noise]
        h = x1 @ c[0] + x2 @ c[1]
        gt = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, qt) + b[word] - self.noise_log[word], -30, 30)))
        gn = -1 / (1 + np.exp(-np.clip(h @ qn.T + b[noise] - self.noise_log[noise], -30, 30)))
        dh = gt[:, None] * qt + gn @ qn
        grad_c = np.stack([x1.T @ dh, x2.T @ dh])
        grad_1, grad_2 = dh @ c[0].T, dh @ c[1].T
        self._add(1, np.concatenate([word, noise]), np.concatenate([gt[:, None] * h, gn.T @ h]))
        self._add(2, np.concatenate([word, noise]), np.concatenate([gt, gn.sum(0)]))
        self._add(0, np.concatenate([one, two]), np.concatenate([grad_1, grad_2]))
        self._add(3, None, grad_c)


def _outcomes(vocab: Vocabulary, table: HashTable, hashes: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's outcome, and its place among head words, -1 for others."""
    at = table.find(hashes)
    return (np.where(at >= 0, vocab.outcome[at], vocab.by_suffix[suffix]) if len(vocab.words) else vocab.by_suffix[suffix]), at


def train(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """The model's numbers, learnt from every row of docs, whatever their order and partitions.

    One task finds a start on a hash share of the rows of about START_TOKENS tokens (all, if there are fewer). Then every row is dealt by the hash
    of its key and text to a shard; from the start, each shard's task learns from its rows in the order of that hash. The mean
    of all shards' numbers, weighted by tokens and summed by place in a shuffle, is the model. Rows travel as two bytes a word.
    """
    spark = docs.sparkSession
    share = (vocab.tokens + 1.0) / (vocab.tokens + 1.0).sum()
    shared = spark.sparkContext.broadcast((vocab, share))
    rows = docs.select(F.xxhash64(F.lit("shard"), key, text).alias("h"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, _ = shared.value
        table = vocab.table()
        for b in batches:
            data, offsets = flat(b.column(1))
            for i, j in steps(offsets):
                h, s, bounds = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw = _outcomes(vocab, table, h, s)[0].astype("<i2").tobytes()
                words = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), words], ["h", "words"])

    def learn(start: np.ndarray, some: DataFrame, how: tuple, turns: int, shards: int) -> np.ndarray:
        rate, noise, size = how
        given = spark.sparkContext.broadcast(start)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, n = Trainer(given.value, shared.value[1], rate, noise, TaskContext.get().partitionId()), 0
            for b in batches:
                data, offsets = flat(b.column(1))
                for i, j in steps(offsets):
                    one, two, word = contexts(data[offsets[i] : offsets[j]].view("<i2").astype(np.int32), (offsets[i : j + 1] - offsets[i]) // 2)
                    for turn in range(turns):
                        order = np.random.default_rng(turn).permutation(-(-len(word) // size))
                        for k in order * size:
                            trainer.learn(one[k : k + size], two[k : k + size], word[k : k + size])
                    n += len(word)
            if n:
                x = trainer.w.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x * n), pa.array(np.full(len(x), float(n)))], ["at", "sum", "n"])

        dealt = some.mapInArrow(encode, "h long, words binary").repartition(shards, "h").sortWithinPartitions("h")
        found = dealt.mapInArrow(run, "at int, sum double, n double").groupBy("at").agg((F.sum("sum") / F.sum("n")).alias("x")).toArrow()
        out = start.copy()
        out[found.column("at").to_numpy()] = found.column("x").to_numpy()
        return out

    sample = rows.filter(F.pmod(F.xxhash64(F.lit("start"), "h"), F.lit(max(1, vocab.total // START_TOKENS))) == 0)
    start = learn(Weights.start(share).flat().astype(np.float64), sample, FIRST, START_TURNS, 1)
    return learn(start, rows, THEN, 1, max(1, min(SHARDS, round(vocab.total / SHARD_TOKENS))))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text's log10 probability: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words and one end; counts and the model come from all rows that are not held out. Base: unigrams with 1/2 added.
    The model gives an outcome's probability after the two tokens before, normalised over all outcomes; where the
    outcome is a class of words, times the word's share (count + 1/2) of the class, in which words never seen have 1/2 together.

    Null counts as empty, which is the end alone; null keys are not held out. No training row: every score is the base. Repeated rows score
    alike and count each; texts of any length are scored whole; an empty table gives no row; other columns are not read.
    The scores do not depend on how rows lie in partitions. Words are told apart by 64-bit hashes. Rare words' counts are
    joined, none of them being hot by definition; frequent ones' table is broadcast and has HEAD rows at most.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), is_held_out(key).alias("held_out"))
    known = docs.filter(~F.col("held_out"))
    counts = kept(count_words(known), "counts")
    vocab = vocabulary(counts)
    numbers = train(known, vocab, "key") if vocab.total else None
    shared = spark.sparkContext.broadcast((vocab, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, numbers = shared.value
        table, number = vocab.table(), TaskContext.get().partitionId() << 40
        base = np.log10(vocab.counts + 0.5) if len(vocab.words) else np.zeros(1)
        if numbers is not None:
            one_t, two_t, norm = Weights.of(numbers).tables()
            share = np.zeros(SIZE)
            share[1 + WORDS :] = np.log10(vocab.mass[1 + WORDS :])
        for b in batches:
            data, offsets = flat(b.column(1))
            for i, j in steps(offsets):
                m = j - i
                h, s, bounds = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                outcome, at = _outcomes(vocab, table, h, s)
                row = np.repeat(np.arange(m), np.diff(bounds))
                head = at >= 0
                logs = np.where(head, base[at], 0.0)
                own = np.bincount(row, logs, m) + np.log10(vocab.ends + 0.5)
                of_class = outcome > WORDS
                rare = np.bincount(row[of_class], logs[of_class], m)
                model = np.zeros(m)
                if numbers is not None:
                    one, two, word = contexts(outcome, bounds)
                    logp = (one_t[one, word] + two_t[two, word] - norm[one, two]).astype(np.float64) / np.log(10) - share[word]
                    model = np.add.reduceat(logp, bounds[:-1] + np.arange(m)) + rare
                seen = np.bincount(row[head], minlength=m) + (vocab.ends > 0)
                tail = np.flatnonzero(~head)
                pair = np.lexsort((h[tail], row[tail]))
                tr, th = row[tail][pair], h[tail][pair]
                first = np.flatnonzero(np.concatenate([[True], (tr[1:] != tr[:-1]) | (th[1:] != th[:-1])])) if len(tr) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([first, [len(tr)]])).astype(np.int32)
                ends = pa.array(np.searchsorted(tr[first], np.arange(m + 1)), pa.int32())
                cols = [b.column(0).slice(i, m), b.column(2).slice(i, m), number + np.arange(m), np.diff(bounds) + 1, seen, own, model]
                cols += [pa.ListArray.from_arrays(ends, pa.array(th[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times))]
                number += m
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], ["key", "held_out", "row", "n_tokens", "seen", "own", "model", "words", "times"])

    kind = dict(docs.dtypes)["key"]
    rows = kept(docs.select("key", "text", "held_out").mapInArrow(run, f"key {kind}, held_out boolean, row long, n_tokens long, seen long, own double, model double, words array<long>, times array<int>"), "scored")
    tail = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("k"))
    found = tail.join(counts.filter("suffix >= 0").select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = found.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 0.5)).alias("_log"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("_known"))
    out = rows.drop("words", "times").join(sums, "row", "left").na.fill({"_log": 0.0, "_known": 0})
    whole = float(np.log10(vocab.total + 0.5 * (vocab.distinct + 1)))
    base = F.col("own") + F.col("_log") - F.col("n_tokens") * F.lit(whole)
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("seen") + F.col("_known")).alias("n_known"), F.lit(int(vocab.total)).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("model") + F.col("_log") if numbers is not None else base).alias("score"),
    )
