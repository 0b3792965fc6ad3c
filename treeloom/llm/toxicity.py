"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import NON_WORD, HashTable, flat, hash_spans, lowered, mix, padded, prefix_hash, spans, steps

#: Bytes of the prefixes that are features beside the whole word.
PREFIXES = (4, 5, 6, 7)
#: Kinds of features of a token: its word, its prefixes, the word before and the word after.
OWN = 1 + len(PREFIXES)
BEFORE, AFTER = OWN, OWN + 1
#: Labelled documents of each class that a model is fitted on, at most, taken in the order of a hash of their id.
SAMPLE = 1200
#: Tokens of a block in which the chain's steps are multiplied out, and tokens of the sample whose marginals are held at once.
BLOCK, FIT_TOKENS = 32, 100_000
#: From this marginal on, a token counts as a toxic span.
SPAN_FROM = 0.5
_U = np.uint64


@dataclass
class Model:
    """The fitted features' 64-bit hashes and weights, the bias, transitions, and the document level's weights."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    step: np.ndarray  # 2 x 2, from and to: clean, toxic
    document: np.ndarray

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Weights of features by hash; 0 for features that were not fitted."""
        if getattr(self, "_table", None) is None:
            self._table = HashTable(self.keys)
        at = self._table.find(keys)
        return np.where(at >= 0, self.weights[at], 0.0) if len(self.weights) else np.zeros(len(keys))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}


@dataclass
class Tokens:
    """Tokens of a batch of rows: spans, the number of each token's word, the words' feature hashes (0: none), the rows' bounds."""

    begin: np.ndarray
    length: np.ndarray
    word: np.ndarray
    hashes: np.ndarray  # OWN x words
    bounds: np.ndarray

    def inner(self) -> np.ndarray:
        """Tokens with a token before them in their row."""
        ok = np.ones(len(self.word), bool)
        ok[self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]] = False
        return np.flatnonzero(ok)


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Words are runs of letters, digits, underscores and bytes beyond ASCII; A-Z and the capitals of Latin-1 are lowered."""
    low = lowered(data)
    begin, length, bounds = spans(low, offsets, NON_WORD)
    low = padded(low)
    whole, first, word = np.unique(hash_spans(low, begin, length), return_index=True, return_inverse=True)
    return Tokens(begin, length, word.reshape(-1), np.stack([whole, *(prefix_hash(low, begin[first], length[first], n) for n in PREFIXES)]), bounds)


def _named(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of features of one kind among all kinds."""
    return mix(hashes ^ _U((kind + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def potentials(model: Model, found: Tokens) -> np.ndarray:
    own = np.full(found.hashes.shape[1], model.bias)
    for k, h in enumerate(found.hashes):
        own += np.where(h > 0, model.look_up(_named(h, k)), 0.0)
    u, inner = own[found.word], found.inner()
    u[inner] += model.look_up(_named(found.hashes[0], BEFORE))[found.word[inner - 1]]
    u[inner - 1] += model.look_up(_named(found.hashes[0], AFTER))[found.word[inner]]
    return u


def marginals(u: np.ndarray, step: np.ndarray, bounds: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each token's probability of being toxic, exactly, by the forward-backward recursion; and expected transitions.

    Rows are cut into blocks of BLOCK tokens. The blocks' transfer matrices are multiplied out side by side, a scan
    over each row's blocks gives what enters every block from both sides, and a second sweep gives all messages.
    """
    n = np.diff(bounds)
    blocks = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total, m = int(first[-1]), np.exp(step)
    if not total:
        return np.zeros(0), np.zeros((2, 2)) if pairs else None
    row = np.repeat(np.arange(len(n)), blocks)
    start = bounds[row] + BLOCK * (np.arange(total) - first[row])
    size = np.minimum(BLOCK, bounds[row + 1] - start)
    at = start[:, None] + np.arange(BLOCK)
    here = np.arange(BLOCK) < size[:, None]
    odds = np.exp(np.clip(u, -30, 30))
    r = np.where(here, odds[np.minimum(at, len(u) - 1)], 1.0).T.copy()  # step by block
    here = here.T
    p = np.zeros((2, 2, total))
    p[0, 0] = p[1, 1] = 1.0
    for t in range(BLOCK):  # a row's first token has the same transition, from the clean state
        new = np.stack([p[:, 0] * m[0, 0] + p[:, 1] * m[1, 0], (p[:, 0] * m[0, 1] + p[:, 1] * m[1, 1]) * r[t]], 1)
        new /= new.max((0, 1))
        p = np.where(here[t], new, p)
    enter, leave = np.zeros((2, total)), np.ones((2, total))
    enter[0] = 1.0
    deep = int(blocks.max())
    by_depth = np.argsort(-blocks, kind="stable")
    live = np.searchsorted(-blocks[by_depth], -np.arange(deep), "left")  # rows with more blocks than k
    for k in range(1, deep):
        b = first[by_depth[: live[k]]] + k
        v = np.stack([enter[0, b - 1] * p[0, j, b - 1] + enter[1, b - 1] * p[1, j, b - 1] for j in (0, 1)])
        enter[:, b] = v / v.sum(0)
    for k in range(deep - 1, 0, -1):
        b = first[by_depth[: live[k]]] + k
        v = np.stack([p[i, 0, b] * leave[0, b] + p[i, 1, b] * leave[1, b] for i in (0, 1)])
        leave[:, b - 1] = v / v.sum(0)
    ahead = np.zeros((BLOCK + 1, 2, total))
    ahead[0] = enter
    for t in range(BLOCK):
        v = np.stack([ahead[t, 0] * m[0, 0] + ahead[t, 1] * m[1, 0], (ahead[t, 0] * m[0, 1] + ahead[t, 1] * m[1, 1]) * r[t]])
        ahead[t + 1] = np.where(here[t], v / v.sum(0), ahead[t])
    out, sums, back = np.zeros(len(u)), np.zeros((2, 2)), leave
    for t in range(BLOCK - 1, -1, -1):
        q = ahead[t + 1, 1] * back[1]
        q = q / (q + ahead[t + 1, 0] * back[0])
        out[at[here[t], t]] = q[here[t]]
        to = np.stack([back[0], back[1] * r[t]])
        if pairs:
            joint = ahead[t][:, None] * m[:, :, None] * to[None]
            sums += (joint / joint.sum((0, 1)))[:, :, here[t]].sum(2)
        v = np.stack([m[0, 0] * to[0] + m[0, 1] * to[1], m[1, 0] * to[0] + m[1, 1] * to[1]])
        back = np.where(here[t], v / v.sum(0), back)
    return out, sums if pairs else None


def aggregate(q: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What the document level sees of the marginals: a constant, the largest one's log-odds, expected toxic tokens, and their share."""
    n = np.diff(bounds)
    most, total = np.zeros(len(n)), np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        most[full] = np.maximum.reduceat(q, bounds[full])
        total[full] = np.add.reduceat(q, bounds[full])
    most = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(n)), np.log(most / (1 - most)), np.log1p(total), np.sqrt(total / np.maximum(n, 1))])


def score(model: Model, seen: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.document @ seen, -30, 30)))


def label_tokens(found: Tokens, ids: np.ndarray, sizes: list[int], toxic: np.ndarray, passes: int = 3) -> np.ndarray:
    """Token labels from document labels: in toxic documents, tokens with a feature that few clean documents have.

    ids: for each own kind and word the feature's number among sizes[kind], -1 for none. A word that is seen in clean
    documents at least as often as in toxic ones is never labelled, and does not speak against its prefixes. A feature may
    be chosen if its toxic documents are too many for chance (likelihood ratio) and twice its clean ones. Features are
    chosen one by one, each the one that explains most toxic documents not yet explained; a further pass does so again with
    the tokens that are left, for documents with more than one toxic span.
    """
    row = np.repeat(np.arange(len(toxic)), np.diff(found.bounds))
    at = np.concatenate([[0], np.cumsum(sizes)])
    share = toxic.mean()

    def pairs(some: np.ndarray, kinds: range) -> tuple[np.ndarray, np.ndarray]:
        """Different (row, feature) pairs of some tokens, kind by kind."""
        docs, features = [], []
        for k in kinds:
            f = ids[k][found.word[some]]
            pair = np.unique(row[some[f >= 0]] * sizes[k] + f[f >= 0])
            docs.append((pair // sizes[k]).astype(np.int32))
            features.append((pair % sizes[k] + at[k]).astype(np.int32))
        return np.concatenate(docs), np.concatenate(features)

    bad = toxic[row]
    by_word = [np.bincount(pairs(np.flatnonzero(side), range(1))[1], minlength=sizes[0]) for side in (bad, ~bad)]
    ordinary = (by_word[1] * share >= by_word[0] * (1 - share))[ids[0]][found.word]
    clean = np.bincount(pairs(np.flatnonzero(~bad & ~ordinary), range(OWN))[1], minlength=at[-1])
    special = np.repeat([0.3, *(0.2 * (k + 1) / len(PREFIXES) for k in range(len(PREFIXES)))], sizes)  # of equals, the most special
    hit = np.zeros(len(row), bool)
    for turn in range(passes):
        least = max(3 + turn, (0.002, 0.01, 0.02)[min(turn, 2)] * toxic.sum())
        doc, of = pairs(np.flatnonzero(bad & ~hit & ~ordinary), range(OWN))
        gain = np.bincount(of, minlength=at[-1])
        part = gain / np.maximum(gain + clean, 1)
        ratio = gain * np.log(np.maximum(part, 1e-9) / share) + clean * np.log(np.maximum(1 - part, 1e-9) / (1 - share))
        allowed = (2 * clean <= gain) & (gain >= least) & (ratio >= LEAST_RATIO)
        doc, of = doc[allowed[of]], of[allowed[of]]
        names, of = np.unique(of, return_inverse=True)
        left, chosen = np.ones(len(toxic), bool), np.zeros(at[-1], bool)
        while len(names):
            gain = np.bincount(of[left[doc]], minlength=len(names))
            best = int(np.argmax(gain + special[names] * (gain > 0)))
            if gain[best] < least:
                break
            chosen[names[best]] = True
            left[doc[of == best]] = False
        for k in range(OWN):
            f = ids[k][found.word]
            hit |= (f >= 0) & chosen[np.maximum(f, 0) + at[k]] & bad & ~ordinary
    return hit


#: Log-likelihood ratio from which a feature's toxic documents are not there by chance.
LEAST_RATIO = 7.5


def fit(texts: pa.Array, toxic: np.ndarray, prior: float, rounds: int = 36, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """A model from labelled texts; prior: the share of toxic documents where it is to be used."""
    found = tokens(*flat(texts))
    word, inner, n, words = found.word, found.inner(), len(found.word), found.hashes.shape[1]
    names, ids = [], np.full((OWN, words), -1, np.int32)
    for k, h in enumerate(found.hashes):
        seen = np.flatnonzero(h > 0)
        own, back = np.unique(h[seen], return_inverse=True)
        names.append(_named(own, k))
        ids[k, seen] = back.reshape(-1)
    sizes = [len(x) for x in names]
    names += [_named(found.hashes[0], BEFORE), _named(found.hashes[0], AFTER)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in names])])
    y = label_tokens(found, ids, sizes, toxic)
    edges = [0]  # rows whose marginals are worked out at once
    while edges[-1] < len(toxic):
        edges.append(max(edges[-1] + 1, int(np.searchsorted(found.bounds, found.bounds[edges[-1]] + FIT_TOKENS, "right")) - 1))

    def potential(w: np.ndarray, bias: float) -> np.ndarray:
        own = np.full(words, bias)
        for k in range(OWN):
            own += np.where(ids[k] >= 0, w[at[k] + np.maximum(ids[k], 0)], 0.0)
        u = own[word]
        u[inner] += w[at[BEFORE] + word[inner - 1]]
        u[inner - 1] += w[at[AFTER] + word[inner]]
        return u

    def expected(u: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, pairs = np.zeros(n), np.zeros((2, 2))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            a, e = found.bounds[i], found.bounds[j]
            if e > a:
                q[a:e], more = marginals(u[a:e], step, found.bounds[i : j + 1] - a, True)
                pairs += more
        return q, pairs

    w, bias, step = np.zeros(at[-1]), -3.0, np.zeros((2, 2))
    before = np.zeros(n, bool)
    before[inner] = y[inner - 1]
    seen = np.array([[(~before & ~y).sum(), (~before & y).sum()], [(before & ~y).sum(), (before & y).sum()]], float)
    state = [np.zeros(at[-1] + 5), np.zeros(at[-1] + 5)]
    for i in range(1, rounds + 1):
        q, pairs = expected(potential(w, bias), step)
        gap = q - y
        by_word = np.bincount(word, gap, words)
        grads = [np.bincount(ids[k][ids[k] >= 0], by_word[ids[k] >= 0], sizes[k]) for k in range(OWN)]
        grads += [np.bincount(word[inner - 1], gap[inner], words), np.bincount(word[inner], gap[inner - 1], words)]
        g = np.concatenate([np.concatenate(grads) + decay * n * w, [gap.sum()], (pairs - seen).reshape(-1)]) / max(1, y.sum())
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = rate * (state[0] / (1 - 0.9**i)) / (np.sqrt(state[1] / (1 - 0.99**i)) + 1e-6)
        w, bias, step = w - move[:-5], bias - move[-5], step - move[-4:].reshape(2, 2)
    model = Model(np.concatenate(names), w.astype(np.float32), float(bias), step, np.zeros(4))
    x, t, b = aggregate(expected(potential(w, bias), step)[0], found.bounds), toxic.astype(float), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + 0.5 * np.eye(4)
        b -= np.linalg.solve(h, x @ (p - t) + 0.5 * b)
    share = np.clip(t.mean(), 0.01, 0.99)
    b[0] += np.log(max(prior, 1e-4) / max(1 - prior, 1e-4)) - np.log(share / (1 - share))
    model.document = b
    return model


def is_held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model from the labelled documents that are not held out, `sample` of each class at most; None without both classes.

    Repeated labels of an id count as toxic if one of them is; of repeated documents, the least text is taken; null ids and
    labels teach nothing, null texts count as empty; ties in the sample's order go to the smaller id. Whole texts are
    used, however long. One executor task fits the model on the sampled rows; only the model comes to the driver.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~is_held_out(key)).groupBy(key).agg(F.max(label).alias("_y"))
    sizes = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    order = F.xxhash64(F.lit("sample"), F.col(key))
    picked = known.filter("_y = 1").orderBy(order, key).limit(sample).unionByName(known.filter("_y = 0").orderBy(order, key).limit(sample))
    ids = {r[0]: r[1] for r in picked.collect()}
    prior = sizes[1] / (sizes[0] + sizes[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = list(batches)
        if not given:
            return
        rows = pa.Table.from_batches(given)
        y = np.array([ids[k] == 1 for k in rows.column(0).to_pylist()])
        if y.any() and not y.all():
            model = fit(rows.column(1).cast(pa.large_string()), y, prior)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = docs.filter(F.col(key).isin(list(ids))).groupBy(F.col(key).alias("key")).agg(F.min(text).alias("text")).repartition(1).sortWithinPartitions("key")
    found = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0][0])) if found else None


SPANS = "array<struct<start: int, length: int, probability: double>>"


def _judge(model: Model | None, column) -> Iterator[tuple[int, int, np.ndarray, Tokens | None, np.ndarray, np.ndarray]]:
    data, offsets = flat(column)
    for i, j in steps(offsets):
        if model is None:
            yield i, j, np.zeros(j - i), None, np.zeros(0), data
            continue
        part = data[offsets[i] : offsets[j]]
        found = tokens(part, offsets[i : j + 1] - offsets[i])
        q, _ = marginals(potentials(model, found), model.step, found.bounds)
        yield i, j, score(model, aggregate(q, found.bounds)), found, q, part


def tag(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and spans of every row: the toxic spans' first character, length in characters and probability.

    Null and empty texts have no tokens and get the score of a text without any toxic token; without a model all scores are 0.
    A row for every row: repeated rows score alike, null keys are kept, an empty table gives no row. Other columns are not
    read, so their names are free. Texts of any length are scored whole, their chain being cut nowhere.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("probability", pa.float64())]))
        for b in batches:
            for i, j, found_score, found, q, data in _judge(shared.value, b.column(1)):
                out: list[list] = [[] for _ in range(j - i)]
                hits = np.flatnonzero(q >= SPAN_FROM)
                if len(hits):
                    chars = np.cumsum((data & 0xC0) != 0x80)
                    for h, r in zip(hits.tolist(), (np.searchsorted(found.bounds, hits, "right") - 1).tolist(), strict=True):
                        a, e = int(found.begin[h]), int(found.begin[h] + found.length[h])
                        zero = int(found.begin[found.bounds[r]])
                        skipped = _chars_before(b.column(1)[i + r].as_py(), found, r)
                        first = int(chars[a] - chars[zero]) + skipped
                        out[r].append({"start": first, "length": int(chars[e - 1] - chars[a]) + 1, "probability": float(q[h])})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(found_score, pa.float64()), pa.array(out, kind)], [key, "score", "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double, spans {SPANS}")


def _chars_before(text: str, found: Tokens, row: int) -> int:
    """Characters of a text before its first token: ASCII separators only."""
    return next(i for i, c in enumerate(text) if not (c.isascii() and NON_WORD[ord(c)]))


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the threshold.

    Equal texts share a fate; repeated rows and null keys are rows like others; null and empty texts stay where the model
    scores a text without toxic tokens below the threshold; without a model all stay. No column is added, so no name clashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.concatenate([s < threshold for _, _, s, *_ in _judge(shared.value, b.column(at))] or [np.zeros(0, bool)])
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
