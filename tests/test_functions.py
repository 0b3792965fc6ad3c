import hmac

import pytest
from pyspark.sql import functions as F

from treeloom.functions import codec, json_values, strings, typed, uri
from treeloom.operators import web
from treeloom.plans.el import ElError, el


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("ref", "want"),
    [("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("#s", "http://a/b/c/d;p?q#s"), ("", "http://a/b/c/d;p?q"), ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../../../g", "http://a/g"), ("g;x=1/../y", "http://a/b/c/y")],
)
def test_resolution(spark, ref, want):
    assert value(spark, uri.resolve(F.lit(ref), F.lit("http://a/b/c/d;p?q"))) == want


@pytest.mark.parametrize(("glob", "path", "want"), [("data/*", "data/part-1", True), ("data/*", "data/2024/part-1", False), ("{raw,clean}/", "clean/2024/part.csv", True), ("**/part.csv", "raw/x/PART.CSV", True), ("p?rt", "part", True), ("*.csv", "raw/part.csv", False), ("one;two", "two", True)])
def test_globs(spark, glob, path, want):
    assert value(spark, uri.glob_match(F.lit(path), glob)) is want


def test_codecs(spark):
    # RFC 7914, section 11; RFC 1321, appendix A.5; RFC 4231, case 2
    assert value(spark, F.lower(F.hex(codec.pbkdf2(F.lit("passwd"), F.lit("salt"), 1, 16)))) == "55ac046e56e3089fec1691c22544b605"
    assert value(spark, codec.md5(F.lit("message digest"))) == "f96b697d7cb7938d525a2f31aaf161d0"
    want = "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    assert value(spark, codec.hex_lower(codec.hmac(F.lit("what do ya want for nothing?"), b"Jefe"))) == want
    assert value(spark, codec.hex_lower(codec.hmac(F.lit("what do ya want for nothing?"), F.lit("Jefe")))) == want
    for digest in ("md5", "sha1", "sha256"):
        key = b"k" * 70
        assert value(spark, codec.hmac(F.lit("m"), key, digest)) == hmac.new(key, b"m", digest).digest()
    assert value(spark, F.decode(codec.unbase32(codec.base32(F.lit("hello").cast("binary"))), "UTF-8")) == "hello"
    assert value(spark, F.decode(codec.unbase64url(codec.base64url(F.lit("a?>b").cast("binary"))), "UTF-8")) == "a?>b"
    assert value(spark, codec.password_matches(codec.encode_password(F.lit("pw"), F.lit("salt"), 10), F.lit("pw"))) is True
    assert value(spark, uri.url_decode(F.lit("a+b%20c%zz"))) == "a b czz"


def test_tokens(spark):
    token = web.issue_token(F.lit('{"sub":"x","exp":100}'), F.lit("k"))
    assert value(spark, web.verify_token(token, F.lit("k"), F.lit(50))) == '{"sub":"x","exp":100}'
    assert value(spark, web.verify_token(token, F.lit("k"), F.lit(150))) is None
    assert value(spark, web.verify_token(token, F.lit("z"), F.lit(50))) is None


def test_expressions(spark):
    df = spark.sql("SELECT array(1L, 2L) AS xs, 'q' AS s, CAST(NULL AS string) AS n, 12345.6789D AS d, named_struct('v', 7L) AS o")
    ask = lambda e: df.select(el(df, e).alias("x")).first().x
    assert ask("${xs[1] + 2.5}") == 4
    assert ask("${2.5 + xs[0]}") == 3.5
    assert ask("${n ?: 'none'}") == "none"
    assert ask("${not n ? 'a' : 'b'}") == "a"
    assert ask("${3 in xs or s == 'q'}") is True
    assert ask("|${s}: ${o.v}|") == "q: 7"
    assert ask("${xs.length}") == 2
    assert ask("#numbers.formatDecimal(d, 1, 2)") == "12,345.68"
    assert ask("#numbers.formatDiskSize(12345, 2)") == "12.06 K"
    with pytest.raises(ElError):
        ask("${1 +}")


def test_json_values(spark):
    v = lambda t: json_values.parse(F.lit(t))
    whole = lambda c: value(spark, json_values.get(c, "$", "string"))
    assert whole(json_values.add(v("1"), v("2.5"))) == "3"
    assert whole(json_values.add(v('"a"'), v('"b"'))) == "ab"
    assert whole(json_values.add(v("null"), v("4"))) == "4"
    order = ["null", "true", "3", '{"a":1}', "[1]", '"x"']
    assert all(value(spark, json_values.less(v(a), v(b))) for a, b in zip(order, order[1:]))
    assert value(spark, json_values.parse(F.lit("01"))) is None
    assert [value(spark, json_values.truth(v(t))) for t in ("0", '""', "[]", "[0]", "false", "1.5")] == [False, False, False, True, False, True]


def test_requests(spark):
    raw = "POST /a?x=1 HTTP/1.1\r\nHost: h\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
    r = value(spark, web.parse_request(F.lit(raw)))
    assert (r.method, r.body, r.headers["host"]) == ("POST", b"hello world", "h")
    assert value(spark, web.parse_request(F.lit("junk"))) is None
    odd = "POST /a HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n2\r\né\r\n3\r\nabc\r\n0\r\n\r\n"
    assert value(spark, web.parse_request(F.lit(odd))).body == "éabc".encode()
    many = "GET /a HTTP/1.1\r\n" + "".join(f"H{i}: {i}\r\n" for i in range(12_000)) + "h7: last\r\n\r\n"
    assert len(value(spark, web.parse_request(F.lit(many))).headers) == 12_000
    assert value(spark, web.cookie(F.lit("a=" + "x" * 200_000), "a")) == "x" * 200_000
    assert all(value(spark, web.unchunk(web.chunk(F.lit("aé日😀z" * 3000), n))) == ("aé日😀z" * 3000).encode() for n in (7, 10240))
    assert [(p.name, p.value) for p in value(spark, uri.query_parameters(F.lit("from=x+y&to=%C3%A9;flag&from=2")))] == [("from", "x y"), ("to", "é"), ("flag", ""), ("from", "2")]
    assert value(spark, web.cookie(F.lit("a=1; b=2; a=3"), "a")) == "1"


def test_typed(spark):
    assert value(spark, typed.from_text(F.lit("x"), "xsd:int")) is None
    assert value(spark, typed.from_text(F.lit("2022-12-06T00:01Z"), "xsd:dateTime")) is not None
    assert value(spark, strings.is_name(F.lit("a-b"))) is True
    assert value(spark, strings.is_name(F.lit("1b"))) is False
    assert value(spark, strings.split(F.lit("|x||y|"), "|", True)) == ["x", "y"]
