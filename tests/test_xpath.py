import pytest

from treeloom.plans.xpath import XPathError, parse, xpath
from treeloom.sources import xml as X

DOCS = [
    (1, '<a xml:lang="en-GB" id="r"><b n="1">x<c/>y</b><b n="2"><c>z</c></b><!--k--><d><b n="3"/></d></a>'),
    (2, '<a><b n="9"/></a>'),
    (3, "<a><b></a>"),
    (4, None),
    (5, ""),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return X.shred(spark.createDataFrame(DOCS, "doc_id long, xml string")).cache()


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("//b", [(1, 7), (1, 17), (1, 28), (2, 3)]),
        ("//b[1]", [(1, 7), (1, 28), (2, 3)]),
        ("//b[last()]", [(1, 17), (1, 28), (2, 3)]),
        ("//c/ancestor::*", [(1, 7), (1, 2), (1, 17), (1, 2)]),
        ("//b[c]", [(1, 7), (1, 17)]),
        ("//b[not(c)]", [(1, 28), (2, 3)]),
        ("//b[@n > 1]", [(1, 17), (1, 28), (2, 3)]),
        ("//b[contains(., 'x')]", [(1, 7)]),
        ("//b/preceding-sibling::*", [(1, 7)]),
        ("//*[count(b) = 2]", [(1, 2)]),
        ("//b[@n = 2]/c | //d", [(1, 20), (1, 27)]),
        ("//*[name() = 'd']/b/..", [(1, 27)]),
        ("//comment()", [(1, 25)]),
        ("//b[lang('en')]", [(1, 7), (1, 17), (1, 28)]),
        ("//b[sum(@n) = 2]", [(1, 17)]),
        ("//b[@n = $v]", [(1, 28)]),
    ],
)
def test_paths(nodes, path, want):
    found = xpath(nodes, path, variables={"v": 3}).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.pre) for r in found] == want


def test_duplicates_are_kept_unless_asked(nodes):
    assert xpath(nodes, "//c/ancestor::*").count() == 4
    assert xpath(nodes, "//c/ancestor::*", dedupe=True).count() == 3


@pytest.mark.parametrize("bad", ["//b[", "/a/unknown-axis::b", "foo(1)", "//b[count()]", "//b]"])
def test_rejects(bad):
    with pytest.raises(XPathError):
        parse(bad)


def test_verdicts_and_rewrite(spark, nodes):
    docs = spark.createDataFrame(DOCS, "doc_id long, xml string")
    assert {r.doc_id for r in X.verdicts(docs).filter("wf_error IS NULL").collect()} == {1, 2}
    again = X.shred(X.from_nodes(nodes))
    assert again.select("doc_id", "pre", "kind", "value").exceptAll(nodes.select("doc_id", "pre", "kind", "value")).count() == 0


def test_entities_are_bounded(spark):
    bomb = "<!DOCTYPE a [<!ENTITY b '" + "x" * 1000 + "'><!ENTITY c '" + "&b;" * 1000 + "'><!ENTITY d '" + "&c;" * 1000 + "'>]><a>&d;</a>"
    with pytest.raises(X.Rejected):
        X.shred_text(bomb)


def test_documents_of_any_number_of_nodes(spark, monkeypatch):
    doc = '<!DOCTYPE a [<!ATTLIST b k ID #IMPLIED d CDATA "v">]><a xmlns:p="u" xml:lang="de">x&#13;y<p:b p:n="1"><![CDATA[c<]]>t</p:b><!--k--><?pi q?><b k="i">é<c/></b>' + "<c>1</c>" * 50 + "</a>"
    columns = [c.split()[0] for c in X.NODES.split(", ")]
    whole = [[n[c] for c in columns] for n in X.shred_text(doc)]
    for name in ("MAX_NODES", "HELD_NODES", "STEP"):
        monkeypatch.setattr(X, name, 7, raising=False)
    assert [[n[c] for c in columns] for n in X.shred_text(doc)] == whole
    with pytest.raises(X.Rejected):
        next(X.shred_nodes(doc[:-4]))


def test_no_wellformed_document_is_dropped_in_silence(spark):
    bomb = "<!DOCTYPE a [<!ENTITY b '" + "x" * 1000 + "'><!ENTITY c '" + "&b;" * 1000 + "'><!ENTITY d '" + "&c;" * 1000 + "'>]><a>&d;</a>"
    docs = spark.createDataFrame([(1, bomb)], "doc_id long, xml string")
    with pytest.raises(Exception, match="Exceeds"):
        X.shred(docs).count()
    assert X.verdicts(docs).filter("wf_error IS NOT NULL").count() == 1


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/a[b/@n = 2]", [(1, 2)]),
        ("//*[b/@n != 1]", [(1, 2), (1, 27), (2, 2)]),
        ("//*[3 <= b/@n]", [(1, 27), (2, 2)]),
        ("//b[@n = ../b/@n]", [(1, 7), (1, 17), (1, 28), (2, 3)]),
        ("//b[@n < ../b/@n]", [(1, 7)]),
        ("//b[. mod 2 = 1]", []),
        ("//b[floor(.) = 0 or ceiling(.) = 0]", []),
        ("//b[substring('abc', ., 2) = 'a']", []),
        ("//b[substring('12345', 1.5, 2.6) = '234' and substring('12345', 0, 3) = '12']", [(1, 7), (1, 17), (1, 28), (2, 3)]),
        ("//b[substring('12345', 0 div 0, 3) = '' and substring('12345', -42, 1 div 0) = '12345']", [(1, 7), (1, 17), (1, 28), (2, 3)]),
        ("//b[translate(@n, @n, 'x') = 'x']", [(1, 7), (1, 17), (1, 28), (2, 3)]),
        ("//b[string(1 div 0) = 'Infinity' and string(number('x')) = 'NaN']", [(1, 7), (1, 17), (1, 28), (2, 3)]),
        ("//d/preceding::*", [(1, 7), (1, 12), (1, 17), (1, 20)]),
        ("//c[following::d]/..", [(1, 7), (1, 17)]),
    ],
)
def test_comparisons_and_numbers(nodes, path, want):
    found = xpath(nodes, path).orderBy("doc_id", "pre").collect()
    assert [(r.doc_id, r.pre) for r in found] == want


def test_interval_axes_over_many_buckets(spark, monkeypatch):
    from treeloom.plans import xpath as P

    nodes = X.shred(spark.createDataFrame([(1, "<a>" + "<b><c/><c/></b>" * 40 + "</a>")], "doc_id long, xml string")).cache()
    whole = {p: xpath(nodes, p).count() for p in ("//c/ancestor::*", "//b/following::c", "//b/preceding::c", "//a/descendant-or-self::*", "//b[descendant::c]")}
    monkeypatch.setattr(P, "BUCKET", 7)
    assert {p: xpath(nodes, p).count() for p in whole} == whole
    assert whole == {"//c/ancestor::*": 160, "//b/following::c": 40 * 39, "//b/preceding::c": 40 * 39, "//a/descendant-or-self::*": 121, "//b[descendant::c]": 40}


def test_string_values_and_target(spark):
    docs = spark.createDataFrame([(1, "<a>x<b>y<c/>z</b><?p q?><?r s?></a>"), (2, "<a/>")], "doc_id long, xml string")
    lean = X.shred(docs, texts=False)
    assert lean.filter("kind = 'element' AND str_value IS NOT NULL").count() == 0
    assert X.string_values(lean).exceptAll(X.shred(docs)).count() == 0
    assert [r.qname for r in xpath(lean, "//processing-instruction('r')").collect()] == ["r"]


def test_filter_expressions(spark):
    xml = "<r><a x='1'/><b x='2'><c x='3'/></b><a x='4'/><d><a x='5'/></d></r>"
    nodes = X.shred(spark.createDataFrame([(1, xml), (2, "<r><b x='9'/></r>")], "doc_id long, xml string"))
    chosen = xpath(nodes, "//a").select("doc_id", "pre")

    def holds(predicate):
        return [r.doc_id for r in xpath(nodes, f"/r[{predicate}]", variables={"s": chosen, "n": 2}).select("doc_id").collect()]

    assert sorted(holds("(a | b)[1]")) == [1, 2]
    assert holds("(a | b)[last()]/@x = 2") == [1]  # a union is one list: the b stands behind both a
    assert holds("(b | a)[1]/@x = 2") == [1]
    assert holds("((a | b)[@x > 1])[2]/c/@x = 3") == [1]
    assert holds("(//a)[3]/@x = 5") == [1]
    assert sorted(holds("not((//a)[4])")) == [1, 2]
    assert holds("(a | d)//a/@x = 5") == [1]
    assert holds("count((a | b)[position() > 1]) = 2") == [1]
    assert holds("$s/..") == [1]
    assert holds("$s[$n]/@x = 4") == [1]
    assert holds("count($s/ancestor::r) = 3") == [1]
    assert holds("(b[1] | b)[2]") and sorted(holds("(b[1] | b)[2]")) == [1, 2]  # nodes may repeat
    assert sorted(holds("string((a | b)[2]/@x) != '7'")) == [1, 2]
    for bad in ("(//b)[1]", "$s", "$s/a", "/r['t'[1]]", "/r[true()[1]]", "/r[(1 + 1)[1]]", "/r[(a | b)[1]"):
        with pytest.raises(XPathError):
            xpath(nodes, bad, variables={"s": chosen})
    with pytest.raises(XPathError):
        xpath(nodes, "/r[$n/a]", variables={"n": 2})
