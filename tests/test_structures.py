"""Entities, records of large files, mounts, typed binding, structs, attributes by declaration, subtrees, node sets."""

import random

import pytest
from pyspark.sql import functions as F

from treeloom.functions.uri import glob_pattern
from treeloom.operators import dom, dtd, entities, mounts, structs
from treeloom.plans.el import ElError
from treeloom.plans.template import Template
from treeloom.sources import records as R
from treeloom.sources import xml as X

NS = 'xmlns:t="http://treeloom.example/template"'


def test_entities_of_long_chains_and_circles(spark):
    chain = "".join(f'<!ENTITY c{i} "{"x" if i == 0 else f"&c{i - 1};&#65;"}">' for i in range(300))
    bomb = '<!ENTITY b0 "lol">' + "".join(f'<!ENTITY b{i} "{f"&b{i - 1};" * 10}">' for i in range(1, 40))
    circle = '<!ENTITY p "&q;"><!ENTITY q "&r;&lt;"><!ENTITY r "&p;"><!ENTITY before "a&p;"><!ENTITY apart "z">'
    docs = [(1, f"<!DOCTYPE d [{chain}]><d/>"), (2, f"<!DOCTYPE d [{bomb}]><d/>"), (3, f"<!DOCTYPE d [{circle}]><d>&p;</d>"), (4, "<d/>"), (5, None), (6, '<!DOCTYPE d [<!ENTITY u "&none;"> <!ENTITY % par "x"> <!NOTATION n PUBLIC "-//x"> <!ENTITY pic SYSTEM "s" NDATA n> broken')]
    df = spark.createDataFrame(docs, "doc_id long, xml string")
    found = {(r.doc_id, r.name): (r.cyclic, r.size) for r in entities.expanded(entities.declared(df)).collect()}
    assert all(found[1, f"c{i}"] == (False, 1.0 + i) for i in range(300))
    assert found[2, "b39"] == (False, 3e39)
    assert {n: found[3, n] for n in ("p", "q", "r", "before", "apart")} == {"p": (True, None), "q": (True, None), "r": (True, None), "before": (True, None), "apart": (False, 1.0)}
    rows = {(r.kind, r.name): r for r in entities.declared(df.filter("doc_id = 6")).collect()}
    assert set(rows) == {("general", "u"), ("parameter", "par"), ("notation", "n"), ("unparsed", "pic")} and rows["unparsed", "pic"].notation == "n"
    told = {(r.doc_id, r.problem, r.name) for r in entities.problems(df).collect()}
    assert {x for x in told if x[0] != 2} == {(3, "recursion", n) for n in ("p", "q", "r", "before")} | {(6, "undeclared entity", "none")}
    assert {x[1] for x in told if x[0] == 2} == {"too long"}


def test_records_of_one_file_read_by_many_tasks(spark, tmp_path):
    rng, parts, want = random.Random(2), ["<?xml version='1.0'?><recs a='<rec'>\n<!-- head -->"], []
    for i in range(20_000):
        body = "" if i % 3 else "".join(rng.choice(["<b/>", "t é", "&lt;", "<recx>y</recx>"[:0]]) for _ in range(rng.randint(0, 8)))
        parts.append(f"<rec n='{i}' q='>'/>" if i % 3 else f"<rec n='{i}'>{body}</rec >" if i % 2 else f"<rec n='{i}'>{body}</rec>")
        parts.append(rng.choice(["", "\n", "<other>between</other>", "  "]))
        want.append(i)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.xml").write_text("".join(parts) + "</recs>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = R.records(spark, str(tmp_path / "f"), "rec", "_n int")
        assert rows.rdd.getNumPartitions() > 10
        found = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.value["_n"] for r in found if r.error is None) == want
    assert [r for r in found if r.error] == []
    (tmp_path / "f" / "one.xml").write_text("<recs><rec n='1'><recx/></rec><rec n='2'>cut")
    found = R.records(spark, str(tmp_path / "f"), "rec", namespaces={"p": "urn:p"}).collect()
    assert [(r.xml, r.error is None) for r in found] == [(None, False), (None, False)]
    (tmp_path / "f" / "one.xml").write_text("")
    assert R.records(spark, str(tmp_path / "f"), "rec").count() == 0
    with pytest.raises(ValueError, match="not a name"):
        R.records(spark, "x", "a b")


def test_dispatch_by_trying_every_mount(spark):
    rng = random.Random(3)
    kinds = [("path", "/a/b"), ("path", "/a/{x}"), ("path", "/{x}/b/{y}"), ("path", ""), ("glob", "/a/*.txt;/c/"), ("glob", "**/z"), ("glob", "/{en,de}/**"), ("glob", "/A/b?"), ("glob", "/c/d/**/e")]
    table = [(i, rng.choice(["GET", "POST", None]), *k) for i, k in enumerate(kinds * 2)]
    rng.shuffle(table)
    words = ["a", "b", "c", "d", "e", "z", "en", "bx", "q.txt", "A"]
    requests = [(i, rng.choice(["GET", "POST", "HEAD", "OPTIONS"]), "/" + "/".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(400)] + [(900, "GET", None), (901, "GET", ""), (902, "GET", "/c/")] * 2
    import re

    def first(method, path):
        for glob in (False, True):
            for no, takes, kind, p in sorted(table, key=lambda r: r[0]):
                if (kind == "glob") != glob or path is None:
                    continue
                if not (takes in (None, method) or method == "OPTIONS" or glob and method == "HEAD"):
                    continue
                pattern = glob_pattern(p) if glob else "^/?" + re.sub(r"\\\{\w+\\\}", "([^/]+)", re.escape(p.lstrip("/"))) + "$"
                if re.search(pattern, path):
                    return no
        return None

    df = spark.createDataFrame(requests, "n int, method string, path string").repartition(3)
    found = mounts.dispatch(df, spark.createDataFrame(table, "mount_no int, method string, kind string, path string")).collect()
    assert sorted((r.n, r.mount_no) for r in found if r.mount_no is not None) == sorted((n, first(m, p)) for n, m, p in requests if first(m, p) is not None)
    assert len(found) == len(requests)
    one = mounts.dispatch(spark.createDataFrame([("GET", "/a/x%20y")], "method string, path string"), spark.createDataFrame([(1, "GET", "path", "/a/{x}")], "mount_no int, method string, kind string, path string")).first()
    assert one.parameters == {"x": "x y"}


def test_structs_of_nested_lists(spark):
    xml = "<r><g id='1'><i><v>1</v><v>x</v></i><i/></g><g id='2' k='true'/><n:t xmlns:n='u'>2024-01-02</n:t><t>later</t></r>"
    nodes = X.shred(spark.createDataFrame([(1, xml), (2, "<r/>")], "doc_id long, xml string"))
    found = {r.doc_id: r.value for r in structs.assemble(nodes, nodes.filter("level = 1 AND kind = 'element'"), "g array<struct<_id: int, _k: boolean, i: array<struct<v: array<int>>>, o: struct<p: int>>>, t date, w double", defaults={"w": 0.5, "g._k": False}).collect()}
    g = found[1]["g"]
    assert [(x["_id"], x["_k"], [y["v"] for y in x["i"]], x["o"]) for x in g] == [(1, False, [[1, None], []], None), (2, True, [], None)]
    assert (str(found[1]["t"]), found[1]["w"]) == ("2024-01-02", 0.5)
    assert (found[2]["g"], found[2]["t"], found[2]["w"]) == ([], None, 0.5)


def test_typed_attributes_keep_a_lawful_table(spark):
    xml = "<d b=' x  y '><d/><d a='1' c='2'/></d>"
    nodes = X.written(X.shred(spark.createDataFrame([(1, xml)], "doc_id long, xml string"), texts=False))
    declared = spark.createDataFrame([("d", "a", "CDATA", "A", False, False), ("d", "b", "NMTOKENS", "B", False, False), ("d", "bb", "ID", None, False, False), ("d", "bc", "CDATA", "<", False, False)], "element string, attribute string, type string, default string, required boolean, fixed boolean")
    out = dtd.typed_attributes(nodes, declared)
    assert X.from_nodes(out).first().xml == '<d a="A" b="x y" bc="&lt;"><d a="A" b="B" bc="&lt;"></d><d a="1" b="B" bc="&lt;" c="2"></d></d>'
    assert dom.violations(out).count() == 0


def test_subtrees_of_all_nodes(spark):
    xml = '<a x="1"><b>t<c><!--k--></c></b><b/>&amp;<?p q?></a>'
    nodes = X.shred(spark.createDataFrame([(1, xml)], "doc_id long, xml string"), texts=False)
    found = [r.xml for r in X.subtrees(nodes, nodes, collapse=True).orderBy("pre").collect()]
    assert found == [xml, xml, 'x="1"', "<b>t<c><!--k--></c></b>", "t", "<c><!--k--></c>", "<!--k-->", "<b/>", "&amp;", "<?p q?>"]


def test_node_sets_of_templates(spark):
    df = spark.createDataFrame([("v", "<i>1</i>", ["<j/>", "k"])], "n string, one string, more array<string>")
    row = lambda source, **files: df.select(Template(f"<x {NS}>{source}</x>", files).render(df).alias("t")).first().t
    frag = f'<q {NS} t:fragment="f(head, rest)"><t:block t:replace="${{head}}"/>|<u t:insert="${{rest}}"/><s t:text="${{head}}"/></q>'
    assert row('<t:block t:replace="~{file :: f(~{::h}, ~{})}"/><h>[[${n}]]</h>', file=frag) == "<x><q><h>v</h>|<u></u><s>&lt;h&gt;v&lt;/h&gt;</s></q><h>v</h></x>"
    assert row('<p t:insert="${one}"/><p t:insert="${more}"/>') == "<x><p><i>1</i></p><p><j/>k</p></x>"
    assert row('<t:block t:with="n=\'w\', h=~{::h}"><t:block t:each="z : ${more}"><t:block t:replace="${h}"/></t:block></t:block><h>[[${n}]]</h>') == "<x><h>w</h><h>w</h><h>v</h></x>"  # with the names that were known where it was named
    assert row('<t:block t:replace="~{::h/text()}"/><h>a<k/>b [[${n}]]</h>') == "<x>ab v<h>a<k/>b v</h></x>"
    with pytest.raises(ElError):
        row('<t:block t:replace="~{::none}"/>')


def test_rules_as_a_table(spark):
    from treeloom.operators import web

    rules = spark.createDataFrame([(1, "/in/", ["A"]), (2, "**/*.html;/x?", ["B"]), (3, "/in/y", ["C"])], "rule_no int, glob string, roles array<string>")
    found = web.rule_join(spark.createDataFrame([("/in/y",), ("/a/b.html",), ("/xz",), ("/no",), (None,)], "path string"), rules).collect()
    assert {r.path: (r.rule_no, r.roles) for r in found} == {"/in/y": (1, ["A"]), "/a/b.html": (2, ["B"]), "/xz": (2, ["B"]), "/no": (None, None), None: (None, None)}
