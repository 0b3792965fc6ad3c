"""Intervals of ranks against plain loops; changes of deep and long documents."""

import random
import time

import pytest
from pyspark.sql import functions as F

from treeloom.operators import dom, intervals
from treeloom.sources import xml as X


def nested(rng, low, high, out, depth=0):
    """Random intervals within (low, high), nested or apart, with all ends different."""
    at = low
    while at + 2 < high and (depth == 0 or rng.random() < 0.7):
        a = at + rng.randint(1, 3)
        b = a + rng.randint(1, max(1, (high - a) // 2))
        if b >= high:
            break
        out.append((a, b))
        if depth < 6:
            nested(rng, a, b, out, depth + 1)
        at = b
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    spans = [(d, a, b, f"c{d}-{a}" if a % 5 else None) for d in (1, 2) for a, b in nested(rng, 0, 700, [])]
    points = [(d, at) for d in (1, 2, 3) for at in range(0, 720, 2)]
    return spans, points, spark.createDataFrame(spans, "doc_id long, begin long, end long, carry string"), spark.createDataFrame(points, "doc_id long, at long")


def around(spans, d, at):
    return sorted(((b - a, a, c) for e, a, b, c in spans if e == d and a <= at <= b))


@pytest.mark.parametrize("bucket", [4096, 16])
def test_held_and_innermost(case, monkeypatch, bucket):
    monkeypatch.setattr(intervals, "BUCKET", bucket)
    spans, points, i, p = case
    found = {(r.doc_id, r.at): r.open for r in intervals.held(p, i, "doc_id").collect()}
    assert found == {x: len(around(spans, *x)) for x in points}
    inner = {(r.doc_id, r.at): r.inner for r in intervals.held(p, i, "doc_id", True).collect()}
    assert inner == {x: around(spans, *x)[0][2] for x in points if around(spans, *x)}


def test_covering_and_texts(case):
    spans, points, i, p = case
    found = sorted((r.doc_id, r.at, r.carry or "") for r in intervals.covering(p, i, "doc_id").collect())
    assert found == sorted((d, at, c or "") for d, at in points for _, _, c in around(spans, d, at))
    said = p.select("doc_id", "at", F.concat(F.lit("."), "at").alias("value"))
    texts = {(r.doc_id, r.begin): r.text for r in intervals.texts(said, i, "doc_id").collect()}
    want = {(d, a): "".join(f".{at}" for e, at in points if e == d and a <= at <= b) for d, a, b, _ in spans}
    assert texts == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("bucket", [4096, 8])
def test_numbered(spark, monkeypatch, bucket):
    monkeypatch.setattr(intervals, "BUCKET", bucket)
    rows = [(d, random.Random(at * 7 + d).randint(0, 10**6), at) for d in (1, 2) for at in range(200)]
    found = intervals.numbered(spark.createDataFrame(rows, "d long, r long, x long"), ["d"], F.col("r"), [F.col("r"), F.col("x")], "n").collect()
    assert sorted((r.d, r.n, r.r, r.x) for r in found) == sorted((d, 1 + sorted(y[1:] for y in rows if y[0] == d).index((a, x)), a, x) for d, a, x in rows)


def depth(n):
    return "".join(f"<e n='{i}'>" for i in range(n)) + "x" + "</e>" * n


def test_changes_of_a_deep_document(spark):
    n = 2000
    began = time.time()
    nodes = X.written(X.shred(spark.createDataFrame([(1, depth(n)), (2, "<a><e n='7'/></a>")], "doc_id long, xml string"), texts=False))
    values = X.string_values(nodes).filter("kind = 'element' AND str_value = 'x'").count()
    assert values == n
    target = nodes.filter("kind = 'attribute' AND qname = 'n' AND value = '7'").select("doc_id", F.col("parent_pre").alias("pre"))
    left = dom.erase(nodes, target)
    assert {(r.doc_id, r["count"]) for r in left.filter("kind = 'element'").groupBy("doc_id").count().collect()} == {(1, 7), (2, 1)}
    assert dom.violations(left).count() == 0
    named = dom.move_to_namespace(nodes, target, "p", "urn:p")
    assert dom.namespace_for_prefix(named, "p").count() == n - 7 + 1
    assert time.time() - began < 120


def test_sorting_inside_sorted_children(spark):
    xml = "<r><g k='2'><i k='b'>1<u/></i><i k='a'>2</i></g>t<g k='1'><i k='d'/><i k='c'/></g></r>"
    nodes = X.shred(spark.createDataFrame([(1, xml)], "doc_id long, xml string"), texts=False)
    k = nodes.filter("kind = 'attribute'").select("doc_id", F.col("parent_pre").alias("pre"), F.col("value").alias("k"))
    targets = nodes.filter("kind = 'element' AND qname IN ('r', 'g')").select("doc_id", "pre")
    out = dom.sort_children(nodes.join(k, ["doc_id", "pre"], "left"), targets, F.coalesce("k", F.lit("~")))
    assert X.from_nodes(out).first().xml == '<r><g k="1"><i k="c"></i><i k="d"></i></g><g k="2"><i k="a">2</i><i k="b">1<u></u></i></g>t</r>'
    assert dom.violations(out).count() == 0
