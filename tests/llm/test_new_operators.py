"""Fingerprints, lexical search and conversation repair against plain versions; nulls, ties, repeats, long texts, empty tables, clashing names."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import conversations, fingerprints, lexical, queries

SF = "/root/testdata/sf0.001"
CLASH = "hashed string, number string, kind string, part string, n string, terms string, copies string, at string, flaw string, _key string"
REST = ("c",) * 10
WORDS = "alpha beta Gamma delta_x ÉTÉ été 日本 x1 the of".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


# fingerprints

TEXTS = [(5, prose(1, 400)), (4, prose(1, 400)), (3, None), (2, ""), (1, "aaaaaaa" * 3000), (0, "é日a"), (9, prose(2, 4000)), (9, prose(2, 4000)), (None, "last"), (7, prose(1, 200) + prose(3, 200))]


def plain_phrases(text):
    data, seen, i = text.encode(), set(), 0
    while i < len(data):
        j = i + 1
        while data[i:j] in seen and j <= len(data):
            j += 1
        if j > len(data):
            break
        seen.add(data[i:j])
        i = j
    return seen


def plain_fingerprint_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        out.append((key, text, text[: len(text) - half] + after[:half], after))
    return out


def jaccard(a, b):
    a, b = plain_phrases(a), plain_phrases(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_parse_by_plain_slices_and_after_a_change():
    for text in ["", "a", "aaaa", "abababab", prose(4, 300), "é日" * 50]:
        for other in [text[: len(text) // 2] + "zzzz", text[:3] + prose(5, 50), text]:
            known = {}
            ends = fingerprints.parse(text.encode(), known)
            found = {text.encode()[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())}
            assert found == plain_phrases(text)
            same = len("".join(itertools.takewhile(lambda c: c, (x if x == y else "" for x, y in zip(text, other)))).encode())
            again = fingerprints.parse_changed(other.encode(), same, known, ends)
            assert again.tolist() == fingerprints.parse(other.encode(), {}).tolist()


def test_fingerprints(spark):
    df = spark.createDataFrame([(*r, *REST) for r in TEXTS], "doc_id long, text string, " + CLASH).repartition(3)
    for frame in (df, df.coalesce(1)):
        found = fingerprints.fingerprints(frame).collect()
        want = plain_fingerprint_rows(TEXTS)
        as_rows = lambda rows: collections.Counter((k, n, s) for k, n, s in rows)
        assert as_rows((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == as_rows((k, len(t), hashlib.sha256(e.encode()).hexdigest()) for k, t, e, _ in want)
        prints = {}
        for k, t, e, a in want:
            r = next(r for r in found if r.doc_id == k and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest())
            assert prints.setdefault(t, r.fingerprint) == r.fingerprint
            assert prints.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
            assert abs(r.near_edited - jaccard(t, e)) < 0.13
            assert abs(r.near_next - jaccard(t, a)) < 0.13
        assert prints[""] == ""
    assert fingerprints.fingerprints(df.limit(0)).count() == 0
    alone = fingerprints.fingerprints(df.filter("doc_id = 5")).first()
    assert (alone.near_next, alone.n_chars) == (1.0, len(TEXTS[0][1]))


def test_fingerprints_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in queries.op11_fingerprints(spark, SF).collect()}
    off = []
    for k, t, e, a in plain_fingerprint_rows(rows):
        assert (found[k].n_chars, found[k].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        off += [found[k].near_edited - jaccard(t, e), found[k].near_next - jaccard(t, a)]
    assert len(found) == len(rows)
    assert np.abs(off).max() < 0.15 and np.sqrt(np.mean(np.square(off))) < 0.04


# lexical search

def plain_search(docs, items, k):
    cut = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(d, cut(t)) for d, t in docs]
    n_docs, n_all = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    counts = [(d, len(b), collections.Counter(b)) for d, b in bags]
    out = []
    for item, t in items:
        asked = cut(t)
        df = {x: sum(x in c for _, _, c in counts) for x in set(asked)}
        scores = []
        for d, n, c in counts:
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 12 * (75 + (25 * n * n_docs) // n_all))) for x in asked if x in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_lexical_search(spark, monkeypatch):
    rng = np.random.default_rng(8)
    many = [f"w{i}" for i in range(60)] + WORDS
    docs = [(i, " ".join(rng.choice(many, rng.integers(1, 30)))) for i in range(150)]
    docs += [(i, docs[7][1]) for i in range(200, 260)] + [(7, docs[7][1]), (None, docs[7][1]), (None, "The OF-the x1_x1"), (300, None), (301, ""), (302, "--- \n"), (303, "ÉTÉ " * 5000)]
    items = [(i, " ".join(rng.choice(many, rng.integers(1, 20)))) for i in range(25)] + [(1, docs[7][1]), (1, docs[7][1]), (None, "w1 W1 w2"), (90, None), (91, ""), (92, "unheard words"), (93, "ÉTÉ été")]
    df = spark.createDataFrame([(*r, *REST) for r in docs], "doc_id long, text string, " + CLASH).repartition(3)
    asked = spark.createDataFrame([(*r, *REST) for r in items], "item_id long, text string, " + CLASH)
    want = plain_search(docs, items, 20)
    for postings, opened, block in [(1_000_000, 128, 2048), (300, 2, 2048), (1, 1, 7)]:
        monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
        monkeypatch.setattr(lexical, "OPENED", opened)
        monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
        found = lexical.search(df, asked, 20).collect()
        assert sorted(map(tuple, found), key=repr) == want
    assert lexical.search(df.limit(0), asked).count() == 0
    assert lexical.search(df, asked.limit(0)).count() == 0
    assert lexical.search(df, asked.filter("item_id = 92")).count() == 0


def test_lexical_search_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.op12_lexical_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(queries.oracle_sql()["op12_lexical_search"]).fetchall())


# conversations

def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(how, 1)
    return out


def plain_best(codes):
    """Cost, audit of the cheapest edits by relaxation over whole strings of edits, until nothing changes; and the repaired roles' marks."""
    lawful = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {(0, ""): (0, "")}
    while True:
        new = dict(best)
        for (i, last), (cost, audit) in best.items():
            ways = [(i, x, cost + 2, audit + "I") for x in "ua" if x in lawful[last]]
            if i < len(codes):
                initial, fault = codes[i]
                ways.append((i + 1, last, cost + 3, audit + "D"))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    ways += [(i + 1, x, cost + 2 + more, audit + "R") for x in "ua" if x in lawful[last]]
                    if initial and initial in lawful[last]:
                        ways.append((i + 1, initial, cost + more, audit + "K"))
            for i2, x, c, a in ways:
                if len(a) <= 2 * len(codes) + 4 and new.get((i2, x), (10**9, "")) > (c, a):
                    new[i2, x] = c, a
        if new == best:
            return min(best[len(codes), x] for x in ("", "a") if (len(codes), x) in best)
        best = new


def plain_repair(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in plain_damage(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, codes = set(), []
        for _, _, role, text in mine:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            codes.append((role[:1], fault))
        cost, audit = plain_best(codes)
        lines, last, at = [], "", 0
        for edit in audit:
            want = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{want}:")
                last = want[0]
                continue
            role, text = mine[at][2:]
            at += 1
            if edit != "D":
                role = want if edit == "R" else role
                lines.append(f"{role}:{text}")
                last = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(codes, codes[1:]))
        n = collections.Counter(f for _, f in codes)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(seed, n, convs):
    rng = np.random.default_rng(seed)
    texts = ["yes.", "no", "Why?", "", " \n", "ok!\t", "a. b", None, "é…", "x" * 50 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    return [(int(rng.choice(convs)), None if rng.random() < 0.1 else int(rng.integers(0, 12)), str(rng.choice(roles[:2])) if rng.random() < 0.8 else roles[rng.integers(0, 7)], texts[rng.integers(0, 10)]) for _ in range(n)]


def as_table(spark, rows):
    return spark.createDataFrame([(*r, *REST) for r in rows], "conv_id long, turn long, role string, text string, " + CLASH).repartition(3)


def test_cheapest_by_all_strings_of_edits():
    for codes in itertools.product([("u", 0), ("a", 0), ("s", 1), ("x", 2)], repeat=3):
        names = [(i, ["", "truncated", "blank", "duplicate"][f]) for i, f in codes]
        assert next(iter(conversations.cheapest(tuple(codes)).values())) == plain_best(names)
        halves = [conversations.lattice(tuple(codes[:1])), conversations.lattice(tuple(codes[1:]))]
        whole = conversations.composed(halves)
        assert min(whole[0, b] for b in (0, 3) if (0, b) in whole) == plain_best(names)


def test_repair(spark):
    rows = talk(1, 600, range(90)) + [(None, i, "user" if i % 2 else "assistant", "hi.") for i in range(6)] + [(500, 2**62, "user", "a."), (500, -(2**62), "assistant", "b.")]
    rows += [(700, 1, "user", "word " * 20000 + "end.")]
    rows += [r for r in rows if r[0] == 3]
    assert sorted(map(tuple, conversations.repair(as_table(spark, rows)).collect()), key=repr) == plain_repair(rows)
    assert conversations.repair(as_table(spark, rows).limit(0)).count() == 0


def test_repair_of_dropped_conversations(spark):
    gone = [(c, t) for c in range(400) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(c, t, "user", "a.") for c, t in gone]
    want = [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, _ in gone]
    assert sorted(map(tuple, conversations.repair(as_table(spark, rows)).collect())) == sorted(want)


@pytest.mark.parametrize("piece", [2, 5])
def test_repair_of_long_conversations_in_pieces(spark, monkeypatch, piece):
    rows = talk(2, 120, range(20)) + [(None, i % 9, "user" if i % 2 else "assistant", f"hi {i}.") for i in range(40)]
    c = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(c, 0, "user", f"t{i}.") for i in range(piece + 2)]
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece)
    assert sorted(map(tuple, conversations.repair(as_table(spark, rows)).collect()), key=repr) == plain_repair(rows)


def test_repair_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_conversation_repair(spark, SF)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_repair(rows)
    assert dict(found.dtypes)["gaps"] == dict(found.dtypes)["cost"] == "bigint"
    assert found.filter(F.length("repaired_sha256") != 64).count() == 0
