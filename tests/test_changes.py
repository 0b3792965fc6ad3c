"""Changes of trees that keep ranks: what they give, and that no document is numbered anew for them."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from treeloom.operators import dom
from treeloom.plans.xpath import xpath
from treeloom.sources import xml as X

XML = "<r a='1' b='2'><x k='1'/>t<y><z/></y><x k='2' m='3'>u</x></r>"


@pytest.fixture
def nodes(spark):
    return X.written(X.shred(spark.createDataFrame([(1, XML), (2, "<r/>")], "doc_id long, xml string"), texts=False))


def text(nodes):
    assert dom.violations(nodes).count() == 0
    return [r.xml for r in X.from_nodes(nodes, collapse=True).orderBy("doc_id").collect()]


def at(nodes, path):
    return xpath(nodes, path).select("doc_id", "pre")


def content(targets, *names):
    rows = [targets.select("doc_id", "pre", F.lit(i).cast("long").alias("place"), F.lit("element").alias("kind"), F.lit(n).alias("qname"), F.lit(None).cast("string").alias("value")) for i, n in reversed(list(enumerate(names)))]
    return reduce(lambda a, b: a.unionByName(b), rows)


def refused(*_):
    raise AssertionError("documents are numbered anew")


def test_attributes_keep_ranks(nodes, monkeypatch):
    monkeypatch.setattr(dom, "renumber", refused)
    out = dom.set_attribute(nodes, at(nodes, "//x"), "k", F.lit("9"))
    out = dom.set_attribute(out, at(out, "/r"), "c", F.lit("new"))
    assert text(out) == ['<r a="1" b="2" c="new"><x k="9"/>t<y><z/></y><x k="9" m="3">u</x></r>', '<r c="new"/>']
    out = dom.remove_attribute(out, at(out, "/r | //x"), "a")
    out = dom.remove_attribute(out, at(out, "//x[@m]"), "k")
    assert text(out) == ['<r b="2" c="new"><x k="9"/>t<y><z/></y><x m="3">u</x></r>', '<r c="new"/>']


def test_erasing_keeps_ranks(nodes, monkeypatch):
    monkeypatch.setattr(dom, "renumber", refused)
    out = dom.erase(nodes, at(nodes, "//x[@k = 1] | //y"))
    assert text(out) == ['<r a="1" b="2">t<x k="2" m="3">u</x></r>', "<r/>"]
    assert sorted(map(tuple, nodes.select("doc_id", "pre", "post").join(out.select("doc_id", "pre", "post"), ["doc_id", "pre", "post"]).collect())) == sorted(map(tuple, out.select("doc_id", "pre", "post").collect()))


def test_insertions_keep_order(nodes, monkeypatch):
    monkeypatch.setattr(dom, "renumber", refused)
    monkeypatch.setattr(dom, "MOST_APART", 1000)
    out = nodes
    for where, path in (("first", "/r"), ("last", "//x"), ("before", "//y"), ("after", "//z")):
        targets = at(out, path)
        out = dom.insert(out, targets, where, content(targets, f"{where[0]}1", f"{where[0]}2"))
    a = '<x k="1"><l1/><l2/></x>'
    assert text(out)[0] == f'<r a="1" b="2"><f1/><f2/>{a}t<b1/><b2/><y><z/><a1/><a2/></y><x k="2" m="3">u<l1/><l2/></x></r>'


def test_many_changes_number_anew(nodes):
    """Ranks come to lie no further apart than the limit, so any number of changes may follow each other."""
    out = nodes
    for i in range(6):
        out = dom.set_attribute(out, at(out, "/r"), f"n{i}", F.lit(str(i)))
        assert dom._apart(out) <= dom.MOST_APART
    targets = at(out, "//x[@k = 2]")
    out = dom.insert(out, targets, "last", content(targets, *[f"e{i}" for i in range(40)]))
    named = "".join(f' n{i}="{i}"' for i in range(6))
    assert text(out) == [f'<r a="1" b="2"{named}><x k="1"/>t<y><z/></y><x k="2" m="3">u{"".join(f"<e{i}/>" for i in range(40))}</x></r>', f"<r{named}/>"]
