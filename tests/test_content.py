"""Content models against regular expressions, long families included."""

import itertools
import re

import pytest

from treeloom.operators import content, dtd
from treeloom.sources import xml as X

MODELS = ["EMPTY", "(a)", "(a?)", "(a, b?, (c | d)*)", "(a+, (b, a)?)", "((a | b)+, c)", "(#PCDATA)", "(#PCDATA | a)*", "((a, a) | (a, b))", "((a | b)*, a, (a | b))", "(a, (b?, c?)+, d)"]


def declared(model):
    return next(e for e in X.dtd_declarations(f"<!ELEMENT r {model}> <!ELEMENT a EMPTY> <!ELEMENT b EMPTY> <!ELEMENT c EMPTY> <!ELEMENT d EMPTY>")["elements"] if e["element"] == "r")


def pattern(model):
    text = re.sub(r"\s", "", model).replace("#PCDATA", "t").replace(",", "")
    return "" if text == "EMPTY" else ("(t|a)*" if "t|" in text else "t*" if text == "(t)" else text)


@pytest.mark.parametrize("model", MODELS)
def test_automaton_accepts_what_the_pattern_does(model):
    m = content.automaton(declared(model)["content"])
    want = re.compile(pattern(model))
    for n in range(5):
        for word in itertools.product("abcdt", repeat=n):
            state = 0
            for c in word:
                c = content.TEXT if c == "t" else c
                state = m["table"][state][m["symbols"].index(c) if c in m["symbols"] else -1]
            assert m["accepting"][state] == bool(want.fullmatch("".join(word))), word


def test_violations_tell_the_first_misfit(spark, monkeypatch):
    docs = [("<r><a/><b/><c/></r>", None), ("<r/>", (None, None)), ("<r><a/>text</r>", (2, "#text")), ("<r><a/> <!--x--><z/></r>", (4, "z")), ("<r><a/><c/><d/><b/><a/></r>", (4, "b")), ("<r><a/><b/><b/></r>", (3, "b"))]
    nodes = X.shred(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(docs)], "doc_id long, xml string"))
    for block in (1024, 2):
        monkeypatch.setattr(content, "BLOCK", block)
        found = {r.doc_id: (r.at, r.name) for r in content.violations(nodes, [declared("(a, b?, (c | d)*)")]).collect()}
        assert found == {i: w for i, (_, w) in enumerate(docs) if w is not None}


def test_long_families_and_lists(spark):
    dtd_text = "<!ELEMENT r (a, (b | c)*, d)> <!ATTLIST r to IDREFS #IMPLIED> <!ELEMENT a (a*)> <!ELEMENT b EMPTY> <!ELEMENT c EMPTY> <!ELEMENT d EMPTY>"
    many = "<b/><c/>" * 50_000
    docs = [(1, f"<r><a/>{many}<d/></r>"), (2, f"<r><a/>{many}</r>"), (3, f"<r><a/>{many}<a/>{many}<d/></r>"), (4, "<r to='" + "i " * 20_000 + "i'><a/><d/></r>")]
    nodes = X.written(X.shred(spark.createDataFrame(docs, "doc_id long, xml string"), texts=False))
    found = {(r.doc_id, r.problem, r.detail) for r in dtd.validate(nodes, dtd_text).collect()}
    assert found == {(2, "wrong content", "too short"), (3, "wrong content", "a at 100002"), (4, "dangling reference", "i")}


def test_too_ambiguous_a_model_is_refused():
    with pytest.raises(ValueError, match="ambiguous"):
        content.automaton(declared("((a | b)*, a" + ", (a | b)" * 13 + ")")["content"])
