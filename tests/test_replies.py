"""Replies, login, files, templates from several places, writer options, SOAP texts, small string helpers."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from treeloom.functions import codec, json_values, strings
from treeloom.operators import dom, replies, soap, web
from treeloom.plans.loader import Templates, folder
from treeloom.plans.template import Template
from treeloom.sources import xml as X

NS = 'xmlns:t="http://treeloom.example/template"'


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_stock_replies_and_what_is_sent(spark):
    r = value(spark, replies.stock(F.lit(404), F.lit("<a>\x01&")))
    assert (r.reason, r.body, r.headers["Content-Length"]) == ("Not Found", "<html><body><h1>Not Found</h1><p>&lt;a&gt;&amp;</p></body></html>", str(len(r.body)))
    assert (value(spark, replies.stock(F.lit(304), F.lit("x"))).body, value(spark, replies.stock(F.lit(999), F.lit(None).cast("string"))).reason) == ("", "Error")
    moved = F.struct(F.lit(302).alias("status"), F.create_map(F.lit("Location"), F.lit("/x"), F.lit("A"), F.lit("/y")).alias("headers"), F.lit("b").alias("body"))
    r = value(spark, replies.served(moved, F.lit("HEAD"), "/ctx"))
    assert (r.headers, r.body) == ({"Location": "/ctx/x", "A": "/y"}, "")
    assert value(spark, replies.served(moved, F.lit("GET"))).body == "b"


def test_error_pages(spark):
    df = spark.createDataFrame([(404, "m<", "GET", "/x", "u"), (500, None, None, None, None)], "s int, m string, method string, uri string, user string")
    df = df.select(replies.error_model(F.col("s"), F.col("m"), F.col("method"), F.col("uri"), F.col("user")).alias("error"))
    one, two = (r.p for r in df.select(replies.error_pages(df).alias("p")).collect())
    assert "<h1><span>404</span> Not Found</h1><p>There is nothing at this address.</p><p>More: m&lt;</p><address>GET /x <em>u</em></address>" in one
    assert "More" not in two and "<address>" not in two and "Internal Server Error" in two
    own = df.select(replies.error_pages(df, templates={"error.html": f"<e {NS}>[[${{error.nr}}]]</e>"}).alias("p"))
    assert [r.p for r in own.collect()] == ["<e>404</e>", "<e>500</e>"]


def test_login_and_logout(spark):
    users = spark.range(1).select(F.lit("bob").alias("username"), codec.encode_password(F.lit("pw"), F.lit("s"), 5).alias("stored"), F.array(F.lit("A")).alias("role"))
    rows = [("bob", "pw", "http://evil/in?x", "c", "c"), ("bob", "no", "/in", "c", "c"), ("eve", "pw", None, "c", "c"), ("bob", "pw", "/in", "c", "d"), ("bob", None, None, None, None)]
    asked = spark.createDataFrame(rows, "username string, password string, uri string, csrf string, own_csrf string")
    found = replies.login(asked, users, F.lit("key"), F.lit(100))
    got = found.collect()
    assert sorted(r.status for r in got) == [200, 200, 303, 403, 403]
    good = next(r for r in got if r.status == 303)
    assert good.location == "/in?x"
    token = good.cookie.split("=", 1)[1].split(";")[0]
    claims = json.loads(value(spark, web.verify_token(F.lit(token), F.lit("key"), F.lit(200), F.array(F.lit("A"), F.lit("B")))))
    assert claims == {"username": "bob", "role": ["A"], "exp": 86500}
    assert value(spark, web.verify_token(F.lit(token), F.lit("key"), F.lit(200), F.array(F.lit("B")))) is None
    assert value(spark, web.verify_token(F.lit(token), F.lit("key"), F.lit(200), F.lit(None).cast("array<string>"))) is None
    again = next(r for r in got if r.status == 200 and r.username == "bob").page
    assert 'value="bob"' in again and 'class="is-invalid"' in again and 'value="/in"' in again
    assert tuple(value(spark, replies.logout(F.lit("//evil/x"))))[:2] == (303, "/x")


def test_static_files_and_template_folders(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a.css").write_text("x{}")
    (tmp_path / "page.xhtml").write_text("<p/>")
    os.utime(tmp_path / "page.xhtml", (1000, 1000))
    files = replies.file_table(spark, str(tmp_path))
    at = datetime.datetime(1970, 1, 1, 0, 16, 40)
    asked = spark.createDataFrame([("/sub dir/a.css", None), ("/page.xhtml", at), ("/page.xhtml", at - datetime.timedelta(seconds=1)), ("/no", None)], "path string, since timestamp")
    found = sorted((r.path, r.status, r.content_type, bytes(r.content or b"")) for r in replies.static(asked, files).collect())
    assert found == [("/no", 404, None, b""), ("/page.xhtml", 200, "application/xhtml+xml", b"<p/>"), ("/page.xhtml", 304, None, b""), ("/sub dir/a.css", 200, "text/css", b"x{}")]
    known = Templates(folder(spark, str(tmp_path)))
    assert (known["page"], known["sub dir/a.css"]) == ("<p/>", "x{}") and "login" in known["login"].lower()
    with pytest.raises(KeyError):
        known["none"]


def test_errors_in_their_places(spark):
    df = spark.createDataFrame([("v",)], "n string")
    source = f'<x {NS}><a t:text="${{n +}}">1</a><b t:text="${{n}}">2</b><c t:text="${{unknown.x}}"/></x>'
    shown = df.select(Template(source, inline_errors=True).render(df).alias("t")).first().t
    assert "<b>v</b>" in shown and shown.count("Error in") >= 1
    with pytest.raises(ValueError):
        Template(source).render(df)


def test_writer_options_and_sorted_attributes(spark):
    nodes = X.shred(spark.createDataFrame([(1, '<a x="1" y="22" z="3"><b c="1" d="2"/></a>')], "doc_id long, xml string"), texts=False)
    out = X.from_nodes(nodes, indent=2, collapse=True, wrap=True, prolog=True, doctype="<!DOCTYPE a>").first().xml
    assert out == '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE a>\n<a x="1"\n   y="22"\n   z="3">\n  <b c="1"\n     d="2"/>\n</a>'
    turned = dom.sort_attributes(nodes, nodes.filter("qname = 'a'"), -F.length("value"))
    assert X.from_nodes(turned, collapse=True).first().xml == '<a y="22" x="1" z="3"><b c="1" d="2"/></a>'
    assert dom.violations(turned).count() == 0


def test_characters_and_line_ends_of_documents(spark):
    docs = [(1, "<a>\ufffe</a>"), (2, '<?xml version="1.1"?><a>x\x85y\u2028z\r\x85w\r\nv</a>'), (3, "<a>x\x85y</a>")]
    nodes = {r.doc_id: r.str_value for r in X.shred(spark.createDataFrame(docs, "doc_id long, xml string")).filter("kind = 'root'").collect()}
    assert nodes == {2: "x\ny\nz\nw\nv", 3: "x\x85y"}


def test_soap_leaves_texts_alone(spark):
    call = '<e:Envelope xmlns:e="u"><e:Body><q:f xmlns:q="p"><q:a>see xmlns="q" and</q:a><b><![CDATA[<b:c xmlns="k">]]></b><c k="1">t</c></q:f></e:Body></e:Envelope>'
    df = spark.createDataFrame([(call,), (call.replace(":f", ":g"),), ("<x",), (None,)], "m string")
    found = [r.p for r in df.select(soap.parameters(F.col("m"), "f", "a string, b string, c struct<_k: int, _VALUE: string>").alias("p")).collect()]
    assert (found[0].a, found[0].b, found[0].c._k) == ('see xmlns="q" and', '<b:c xmlns="k">', 1) and found[1:] == [None, None, None]
    named = [r.a for r in df.select(soap.action(F.col("m")).alias("a")).collect()]
    assert [a and a.name for a in named] == ["f", "g", None, None] and "<![CDATA[<b:c" in named[0].xml


def test_small_helpers(spark):
    assert value(spark, json_values.to_safe_text(json_values.parse(F.lit('{"b":"</s>","a":1}')))) == '{"a":1,"b":"<\\/s>"}'
    assert [value(spark, json_values.to_text(json_values.number(F.lit(x)))) for x in (1.5, float("nan"), float("inf"), 5e-324)] == ["1.5", None, None, None]
    assert value(spark, strings.first_character(F.lit("😀x"))) == "😀" and value(spark, strings.without_last(F.lit("x😀"))) == "x"
    assert value(spark, strings.append_code_point(F.lit("a"), F.lit(0x1F600))) == "a😀" and value(spark, strings.append_code_point(F.lit("a"), F.lit(0xD800))) is None
    assert value(spark, strings.to_hex(F.lit(255))) == "ff"
