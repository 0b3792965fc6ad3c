"""Registered queries over values: JSON, expressions, templates, strings, codecs, types, URIs, requests."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import codec, json_values, strings, typed, uri
from .operators import messages, mounts, replies, soap, web
from .plans.el import Compiler, el, el_or_text, utility
from .plans.template import Template, template
from .registry import query, table

TPL = 'xmlns:t="http://treeloom.example/template"'
TPL1 = 'xmlns:m="http://treeloom.example/template-v1"'
_K = "(SELECT event_id, event_type, user_id, value, props, (props->>'k')::BIGINT AS k FROM events)"


def _numbers(spark, d):
    """Events with an object of a number, a list and a text as JSON text."""
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), json_values.parse(F.to_json(F.struct(F.col("user_id").alias("n"), F.array(F.col("event_id"), F.col("user_id")).alias("xs"), F.col("event_type").alias("s")))).alias("v"))


@query(f"SELECT event_id, '[' || event_id || ',' || user_id || ',' || k || ']' AS pushed, '[' || event_id || ',' || k || ',' || user_id || ']' AS inserted, '[' || user_id || ']' AS erased, '{{\"k\":' || k || ',\"n\":' || user_id || ',\"s\":\"' || event_type || '\",\"xs\":[' || event_id || ',' || user_id || ']}}' AS emplaced, '{{\"n\":' || user_id || ',\"s\":' || k || '}}' AS changed, -user_id AS negated, '[]' || '0' || '\"\"' || '{{}}' AS cleared FROM {_K}")
def json_changes(spark, d):
    """Members added, put in, taken out and replaced; values emptied and negated."""
    v, k = F.col("v"), F.to_variant_object(F.array("k"))
    k, xs = F.try_variant_get(k, "$[0]", "variant"), json_values.get(v, "$.xs")
    shown = json_values.to_text
    changed = json_values.put(json_values.erase_key(v, F.lit("xs")), F.lit("s"), k)
    emplaced = json_values.emplace(json_values.emplace(v, F.lit("k"), k), F.lit("n"), k)
    empty = [shown(json_values.clear(json_values.get(v, p))) for p in ("$.xs", "$.n", "$.s", "$")]
    return _numbers(spark, d).select(
        "event_id", shown(json_values.push_back(xs, k)).alias("pushed"), shown(json_values.insert_at(xs, F.lit(1), k)).alias("inserted"), shown(json_values.erase_at(xs, F.lit(0))).alias("erased"), shown(emplaced).alias("emplaced"), shown(changed).alias("changed"),
        json_values.get(json_values.negate(json_values.get(v, "$.n")), "$", "bigint").alias("negated"), F.concat(*empty).alias("cleared"),
    )


@query(f"SELECT event_id, 'n' AS key, user_id::VARCHAR AS value FROM {_K} UNION ALL SELECT event_id, 's', '\"' || event_type || '\"' FROM {_K} UNION ALL SELECT event_id, 'xs', '[' || event_id || ',' || user_id || ']' FROM {_K}")
def json_items(spark, d):
    rows = _numbers(spark, d).select("event_id", F.explode(json_values.items(F.col("v"))).alias("i"))
    return rows.select("event_id", "i.key", json_values.to_text(F.col("i.value")).alias("value"))


@query(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' WHEN 3 THEN 'integer' ELSE 'float' END AS kind, CASE event_id % 5 WHEN 3 THEN user_id % 3 <> 0 WHEN 4 THEN true WHEN 2 THEN event_type <> '' ELSE true END AS truth, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN user_id % 3 + 1 ELSE 1 END::INTEGER AS size, CASE WHEN event_id % 5 = 1 THEN event_id END AS first, event_id % 5 = 0 AS has_b FROM {_K}")
def json_kinds(spark, d):
    """Objects, arrays, texts, whole and broken numbers made from columns: their kind, truth, size, members."""
    e = table(spark, d, "events")
    m = F.col("user_id") % 3
    made = [
        F.to_json(F.struct(F.col("event_id").alias("a"), F.lit("x").alias("b"))), F.to_json(F.concat(F.array("event_id"), F.array_repeat(F.lit(7).cast("bigint"), m.cast("int")))), F.concat(F.lit('"'), "event_type", F.lit('"')), m.cast("string"),
        F.concat((m + 1).cast("string"), F.lit(".5")),
    ]
    v = json_values.parse(F.element_at(F.array(*made), (F.col("event_id") % 5 + 1).cast("int")))
    first = F.when(json_values.type_name(F.col("v")) == "array", json_values.get(json_values.at(F.col("v"), F.lit(0)), "$", "bigint"))
    return e.select("event_id", v.alias("v")).select("event_id", json_values.type_name(F.col("v")).alias("kind"), json_values.truth(F.col("v")).alias("truth"), json_values.size(F.col("v")).alias("size"), first.alias("first"), F.coalesce(json_values.contains(F.col("v"), F.lit("b")), F.lit(False)).alias("has_b"))


@query(f"SELECT event_id, k AS found, coalesce(CASE WHEN k % 2 = 0 THEN k END, -1) AS filled, event_type || k AS text FROM {_K}")
def json_typed(spark, d):
    """Typed values with a default for null; structs to objects and back; missing members take their default."""
    made = F.to_json(F.struct(F.col("k"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("even"), F.col("event_type").alias("s")), {"ignoreNullFields": "false"})
    v = json_values.parse(made)
    back = typed.from_json(made, "k bigint, s string, more string", {"more": F.lit("")})
    return _numbers(spark, d).select("event_id", json_values.extract(json_values.get(v, "$.k"), "bigint", F.lit(0)).alias("found"), json_values.extract(json_values.get(v, "$.even"), "bigint", F.lit(-1)).alias("filled"), F.concat(back["s"], back["k"].cast("string"), back["more"]).alias("text"))


@query(f"SELECT event_id, value > 50 OR event_type = 'click' AS a, NOT (user_id <> 5) AND value <= 90 AS b, -user_id AS c, 2 AS d, event_type AS e, k AS f, NOT (event_type IN ('click', 'view')) AS g, length(event_type) AS h, (k + 1) * 2 AS i, CASE WHEN k > 3 THEN event_type END AS j, k % 7 AS m FROM {_K}")
def el_operators(spark, d):
    """Words and signs of all operators, paths into structs and lists, pseudo-members, bound names."""
    e = table(spark, d, "events").select("*", F.array("event_type", F.lit("x")).alias("xs"), F.from_json("props", "k bigint").alias("p"))
    forms = {"a": "${value > 50 or event_type eq 'click'}", "b": "${not (user_id ne 5) and value le 90}", "c": "${-user_id}", "d": "${xs.length}", "e": "${xs[0]}", "f": "${p.k}", "g": "${event_type not in {'click', 'view'}}", "h": "${event_type.length}", "j": "${p.k gt 3 ? event_type}", "m": "${p.k mod 7}"}
    bound = Compiler.over(e).bind("one=${p.k + 1},two=${one * 2}").evaluate("${two}")[0]
    selected = Compiler(Compiler.over(e).scope, (F.col("p"), T.StructType().add("k", T.LongType()))).evaluate("*{k}")[0]
    return e.select("event_id", *[el(e, f).alias(n) for n, f in forms.items() if n != "f"], selected.alias("f"), bound.alias("i"))


@utility("text", "twice")
def _twice(_, said):
    return F.concat(said[0], said[0]), T.StringType()


@query("SELECT event_id, event_type = 'click' AS role, true AS known, 'u' || user_id AS who, '/p/' || event_id || '?a=' || user_id AS uri, 'http://h/p/' || event_id || '?a=' || user_id AS url, user_id::VARCHAR AS parameter, event_type || event_type AS twice, user_id > 3 AND value > 10 AS holds, 'id=' || event_id || ';n=' || (user_id + 1) AS listed, 'Error' AS wrong FROM events")
def el_utilities(spark, d):
    """Utility objects of security and requests, one of our own, lists of conditions and of attributes, and the text of an error."""
    e = table(spark, d, "events").select("*", F.array("event_type").alias("roles"), F.concat(F.lit("u"), "user_id").alias("username"), F.concat(F.lit("/p/"), "event_id", F.lit("?a="), "user_id").alias("uri"), F.lit("h").alias("host"))
    c = Compiler.over(e)
    listed = c.attributes("id=${event_id},n=${user_id + 1}")
    text = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v[0].cast("string")) for k, v in listed.items()])
    forms = {"role": "${#security.hasRole('click')}", "known": "${#security.authorized()}", "who": "${#security.username()}", "uri": "${#request.getRequestURI()}", "url": "${#request.getRequestURL()}", "parameter": "${#request.getParameter('a')}", "twice": "${#text.twice(event_type)}"}
    return e.select("event_id", *[el(e, f).alias(n) for n, f in forms.items()], c.holds("${user_id > 3},${value > 10}").alias("holds"), text.alias("listed"), el_or_text(e, "${1 +}").substr(1, 5).alias("wrong"))


@query("SELECT event_id, format('{:,.2f}', floor(abs(v) * 100 + 0.5) / 100 * sign(v)) AS two, format('{:,}', (floor(abs(v) + 0.5) * sign(v))::BIGINT) AS whole, CASE WHEN b <= 1024 THEN format('{:,.1f}', floor(b * 10 + 0.5) / 10) || ' B' WHEN b <= 1048576 THEN format('{:,.1f}', floor(b / 1024 * 10 + 0.5) / 10) || ' K' ELSE format('{:,.1f}', floor(b / 1048576 * 10 + 0.5) / 10) || ' M' END AS size FROM (SELECT event_id, (event_id * 1000 + 125)::DECIMAL(18,3) / 1000 * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS v, event_id * 128.0 AS b FROM (SELECT event_id::DECIMAL(18,3) AS event_id FROM events))".replace("SELECT event_id, format", "SELECT event_id::BIGINT AS event_id, format"))
def el_rounding(spark, d):
    """Decimals and sizes with halves, which go up: eighths of both signs."""
    e = table(spark, d, "events").withColumn("v", (F.col("event_id") + 0.125) * F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)).withColumn("b", F.col("event_id") * 128)
    return e.select("event_id", el(e, "#numbers.formatDecimal(v, 1, 2)").alias("two"), el(e, "#numbers.formatDecimal(v, 1, 0)").alias("whole"), el(e, "#numbers.formatDiskSize(b, 1)").alias("size"))


_MONTHS = "['januari', 'februari', 'maart', 'april', 'mei', 'juni', 'juli', 'augustus', 'september', 'oktober', 'november', 'december']"


@query(f"SELECT event_id, lpad(day(ts)::VARCHAR, 2, ' ') || ' ' || {_MONTHS}[month(ts)] || ' ' || year(ts) || strftime(ts, ', %H:%M') AS dutch, strftime(ts, '%d/%b/%Y') AS english FROM events")
def el_dates(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", el(e, "#dates.format(ts, '%e %B %Y, %H:%M', 'nl_NL')").alias("dutch"), el(e, "#dates.format(ts, '%d/%b/%Y')").alias("english"))


@query("SELECT n_nationkey, '<div title=\"' || n_name || '\" id=\"n' || n_nationkey || '\"><b>' || (n_regionkey + 1) || '</b>' || '<i>' || n_name || '</i>' || '<input' || CASE WHEN n_regionkey > 1 THEN ' checked=\"checked\"' ELSE '' END || '/>' || '<ul><li>first</li></ul>' || '<em/>' || 'kept' || CASE WHEN n_regionkey > 0 THEN '<s>ok</s>' ELSE 'Error: assertion failed: ${n_regionkey &gt; 0}' END || '<u>&lt;b&gt;' || n_name || '</u></div>' AS html FROM nation")
def tpl_attributes(spark, d):
    """with, object, attr, generic and boolean attributes, all ways of remove, assert told in its node, inline none."""
    n = table(spark, d, "nation").withColumn("o", F.struct("n_name"))
    source = f"""<div {TPL} t:attr="title=${{n_name}}" t:id="|n${{n_nationkey}}|"><b t:with="k=${{n_regionkey + 1}}" t:text="${{k}}"/><i t:object="${{o}}" t:text="*{{n_name}}"/><input t:checked="${{n_regionkey > 1}}"/><ul t:remove="all-but-first"><li>first</li><li>second</li></ul><em t:remove="body">gone</em><p t:remove="all">gone</p><q t:remove="tag">kept</q><s t:assert="${{n_regionkey > 0}}">ok</s><u>&lt;b&gt;[[${{n_name}}]]</u></div>"""
    return n.select("n_nationkey", template(n, source).alias("html"))


@query("SELECT r, '<d>' || CASE WHEN r > 1 THEN '<b>big</b>' ELSE '' END || string_agg('<i>' || n_name || '</i>', '' ORDER BY n_name) || '<select>' || string_agg('<option value=\"' || n_name || '\"' || CASE WHEN n_name = least THEN ' selected=\"selected\"' ELSE '' END || '>' || n_name || '</option>', '' ORDER BY n_name) || '</select><input type=\"checkbox\" name=\"c\" value=\"true\"' || CASE WHEN r > 1 THEN ' checked=\"checked\"' ELSE '' END || '/>' || format('{:,}', r * 1234567) || '</d>' AS html FROM (SELECT n_regionkey AS r, n_name, min(n_name) OVER (PARTITION BY n_regionkey) AS least FROM nation) GROUP BY r")
def tpl_older_form(spark, d):
    """The older form's if, iterate, options, checkbox and number."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.array_sort(F.collect_list("n_name")).alias("names"), F.min("n_name").alias("least"))
    n = n.withColumn("big", F.col("r") * 1234567)
    source = f"""<d {TPL1}><m:if test="${{r > 1}}"><b>big</b></m:if><m:iterate collection="names" var="x"><i>${{x}}</i></m:iterate><select><m:options collection="names" selected="least"/></select><m:checkbox name="c" checked="${{r > 1}}"/><m:number n="big" f="#,##0"/></d>"""
    return n.select("r", template(n, source).alias("html"))


@query("SELECT n_nationkey, '<f><form><input type=\"hidden\" name=\"_csrf\" value=\"t' || n_nationkey || '\"/><a/></form><form><input name=\"_csrf\"/></form></f>' AS html, '<script>var x = \"' || n_name || '\";</script>' AS script FROM nation")
def tpl_forms(spark, d):
    """Hidden inputs against forged requests in every form that has none; values in scripts."""
    n = table(spark, d, "nation").withColumn("token", F.concat(F.lit("t"), "n_nationkey"))
    forms = Template("<f><form><a/></form><form><input name=\"_csrf\"/></form></f>", csrf="token").render(n)
    script = template(n, f'<script {TPL} t:inline="javascript">var x = [[${{n_name}}]];</script>')
    return n.select("n_nationkey", forms.alias("html"), script.alias("script"))


@query("SELECT n_nationkey, '<x><i k=\"v\">' || n_name || '</i><li>two ' || n_regionkey || '</li><u class=\"k\" id=\"n\">' || n_nationkey || '</u><em>a</em><em>b</em></x>' AS html, '<style>a { width: ' || n_nationkey || '; height: ' || n_regionkey || '; }</style>' AS style, '<b title=\"' || n_name || '\"><option value=\"' || n_nationkey || '\"' || CASE WHEN n_regionkey = n_nationkey THEN ' selected=\"selected\"' ELSE '' END || '>' || n_name || '</option></b>' AS older, '<b>' || CASE WHEN big <= 1024 THEN format('{:,}', big) || ' B' WHEN big // 1024 <= 1024 THEN format('{:,}', big // 1024) || ' K' ELSE format('{:,}', big // 1048576) || ' M' END || '|n_nationkey</b>' AS size FROM (SELECT *, n_nationkey::BIGINT * 65600 + 1000 AS big FROM nation)")
def tpl_selectors(spark, d):
    """Fragments by selectors: attributes, places, classes, ids, paths; values in styles and behind comments; the older form's attributes, options and number pictures."""
    n = table(spark, d, "nation").withColumn("big", F.col("n_nationkey").cast("bigint") * 65600 + 1000)
    files = {"parts.html": f"""<p {TPL}><i k="v">[[${{n_name}}]]</i><ul><li>one</li><li>two [[${{n_regionkey}}]]</li></ul><u class="k" id="n">[[${{n_nationkey}}]]</u><ol><em>a</em><em>b</em></ol></p>"""}
    wanted = ("//i[@k='v']", "ul/li[2]", "u.k#n", "/p/ol/em")
    html = template(n, f"<x {TPL}>" + "".join(f'<q t:replace="~{{parts :: {w}}}"/>' for w in wanted) + '<q t:replace="~{}"/></x>', files)
    style = template(n, f'<style {TPL} t:inline="css">a {{ width: [[${{n_nationkey}}]]; height: /*[[${{n_regionkey}}]]*/ 10px; }}</style>')
    older = template(n, f"""<b {TPL1} title="${{n_name}}"><m:option value="${{n_nationkey}}" selected="${{n_regionkey}}">${{n_name}}</m:option></b>""")
    size = template(n, f"""<b {TPL1}><m:number n="big" f="#,##0B"/>|<m:number n="n_nationkey" f="0.00"/></b>""")
    return n.select("n_nationkey", html.alias("html"), style.alias("style"), older.alias("older"), size.alias("size"))


@query("SELECT p_partkey, lower(p_name) = lower(upper(p_name)) AS same, length(string_split(p_name, ' ')) AS parts, array_to_string(string_split(p_name, ' '), '-') AS joined, replace(p_name, 'a', '<a>') AS replaced, trim('  ' || p_brand || ' ') AS trimmed, p_size % 2 = 0 AS blank, p_size % 3 <> 0 AS name FROM part")
def string_helpers(spark, d):
    p = table(spark, d, "part")
    n = F.col("p_name")
    some = F.when(F.col("p_size") % 2 == 0, " \t").otherwise(n)
    name = F.concat(F.when(F.col("p_size") % 3 == 0, "1").otherwise("a:"), F.lit("b-c.é"))
    return p.select("p_partkey", strings.iequals(n, F.upper(n)).alias("same"), F.size(strings.split(n, " ")).cast("bigint").alias("parts"), strings.join(strings.split(n, " ", True), "-").alias("joined"), strings.replace_all(n, "a", "<a>").alias("replaced"), strings.trim(F.concat(F.lit("  "), "p_brand", F.lit(" \n"))).alias("trimmed"), strings.is_space(some).alias("blank"), strings.is_name(name).alias("name"))


def _pads(key: bytes) -> tuple[str, str]:
    block = key.ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in block).hex(), bytes(x ^ 0x5C for x in block).hex()


_IN, _OUT = _pads(b"a key")


@query(f"SELECT event_id, lower(sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode(props))))) AS mac, lower(sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode(props))))) AS mac_by_column, lower(sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode(event_type) || unhex('00000001'))))) AS derived, true AS matches, event_type AS back FROM events")
def codecs_keyed(spark, d):
    """Keyed digests by a literal and by a column, a derived key of one round, a stored password, base 32 there and back."""
    e = table(spark, d, "events")
    stored = codec.encode_password(F.col("event_type"), F.lit("salt"), 3)
    return e.select(
        "event_id", codec.hex_lower(codec.hmac(F.col("props"), b"a key")).alias("mac"), codec.hex_lower(codec.hmac(F.col("props"), F.lit("a key"))).alias("mac_by_column"), codec.hex_lower(codec.pbkdf2(F.lit("a key"), F.col("event_type"), 1, 32)).alias("derived"),
        (codec.password_matches(stored, F.col("event_type")) & ~codec.password_matches(stored, F.lit("other")) & (F.length(codec.random_token()) == 32)).alias("matches"), F.decode(codec.unbase32(codec.base32(F.col("event_type").cast("binary"))), "UTF-8").alias("back"),
    )


@query(f"SELECT p_partkey, p_size % 3 = 0 AS flag, p_size AS n, '{hashlib.md5(b'').hexdigest()}' AS none, '<part><p_partkey>' || p_partkey || '</p_partkey><p_size>' || p_size || '</p_size></part>' AS xml FROM part")
def typed_more(spark, d):
    """Booleans by their three words, structs to XML by a schema that is printed as XML Schema."""
    p = table(spark, d, "part")
    word = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("maybe")), (F.col("p_size") % 3 + 1).cast("int"))
    schema = typed.schema_of(p.select("p_partkey", "p_size"), "part")
    assert 'name="p_size" type="xsd:int"' in schema
    assert schema.count("<xsd:element") == 3
    return p.select("p_partkey", typed.from_text(word, "xsd:boolean").alias("flag"), typed.from_text(F.concat(F.lit(" "), F.col("p_size").cast("string")), "xsd:int").alias("n"), codec.md5(F.lit("").cast("binary")).alias("none"), typed.to_xml(F.struct("p_partkey", "p_size"), "part").alias("xml"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_SITE = "regexp_extract(url, '^[a-z]+://[^/?#]*', 0)"


@query(f"SELECT page_id, {_SITE} || '/a%20b/' || page_id AS path_set, {_SITE} || {_PATH} || '?q=' || page_id || '%20x' AS query_set, {_SITE} || rtrim({_PATH}, '/') || '/more/' || page_id AS appended, page_id % 2 = 0 AS same, 'a b' || page_id AS segment, {_SITE} || '/a b' AS plain FROM pages WHERE url LIKE '%://%'")
def uri_changes(spark, d):
    """Parts set with coding, paths appended, equality, decoded segments."""
    p = table(spark, d, "pages").filter("url LIKE '%://%'")
    u, n = F.col("url"), F.col("page_id").cast("string")
    bare = F.regexp_replace(u, "[?#].*$", "")
    site = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    other = F.when(F.col("page_id") % 2 == 0, F.concat(F.upper(F.regexp_extract("url", "^[a-z]+", 0)), F.lit("://"), F.regexp_replace(F.concat(bare, F.lit("/%61")), "^[a-z]+://", ""))).otherwise(F.concat(bare, F.lit("/b")))
    return p.select(
        "page_id", uri.set_path(site, F.concat(F.lit("/a b/"), n)).alias("path_set"), uri.set_query(bare, F.concat(F.lit("q="), n, F.lit(" x"))).alias("query_set"), uri.append_path(bare, F.concat(F.lit("/x/../more/"), n)).alias("appended"), uri.equal(F.concat(bare, F.lit("/a")), other).alias("same"),
        F.get(uri.parse(F.concat(F.lit("http://h/a%20b"), n, F.lit("/c")))["segments"], F.lit(1)).alias("segment"), uri.raw(F.concat(site, F.lit("/a%20b"))).alias("plain"),
    )


@query("SELECT event_id, event_type || 'é' || user_id AS body, octet_length(encode(event_type || 'é' || user_id)) AS size, left(event_type || 'é', 3) AS cut, 'new' || event_id AS cookie, 400 + event_id % 100 AS status, 'Not ' || event_type AS reason, 's' || user_id AS server, left(props, 5) AS said FROM events")
def http_messages(spark, d):
    """Bodies in chunks of few bytes, whose sizes count bytes, put together again; a body cut by its length; cookies set; replies parsed."""
    body = F.concat("event_type", F.lit("é"), "user_id")
    chunked = F.concat(F.lit("POST /x HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n").cast("binary"), web.chunk(body, 3))
    in_threes = F.concat(F.lit("POST /x HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n"), F.lower(F.hex(F.octet_length("event_type"))), F.lit(";ext=1\r\n"), "event_type", F.lit("\r\n2\r\né\r\n"), F.hex(F.octet_length(F.col("user_id").cast("string"))), F.lit("\r\n"), F.col("user_id").cast("string"), F.lit("\r\n0\r\n\r\n"))
    start = F.left(F.concat("event_type", F.lit("é")), F.lit(3))
    sized = F.concat(F.lit("PUT /x HTTP/1.1\r\nA: b\r\nContent-Length: "), F.octet_length(start).cast("string"), F.lit("\r\n\r\n"), "event_type", F.lit("é and more"))
    reply = F.concat(F.lit("HTTP/1.1 "), 400 + F.col("event_id") % 100, F.lit(" Not "), "event_type", F.lit("\r\nServer: s"), "user_id", F.lit("\r\nContent-Length: 5\r\n\r\n"), "props")
    cookies = web.set_cookie(F.concat(F.lit("a=1; b="), "user_id", F.lit("; c")), "b", F.concat(F.lit("new"), "event_id"))
    rows = table(spark, d, "events").select("event_id", "event_type", cookies.alias("cookies"), web.parse_request(chunked)["body"].alias("one"), web.parse_request(in_threes)["body"].alias("two"), web.parse_request(sized)["body"].alias("cut"), web.parse_reply(reply).alias("r"))
    return rows.select(
        "event_id", strings.as_text(F.when(F.col("one") == F.col("two"), F.col("one"))).alias("body"), F.octet_length("two").alias("size"), strings.as_text(F.col("cut")).alias("cut"), web.cookie(F.col("cookies"), "b").alias("cookie"), "r.status", "r.reason",
        web.header(F.col("r.headers"), "Server").alias("server"), strings.as_text(F.col("r.body")).alias("said"),
    )


_SENT = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS message, min(CASE WHEN event_id % 29 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS broken FROM events)"


@query(f"SELECT user_id AS connection, message, event_id % 29 <> 0 AS complete, CASE WHEN event_id % 29 <> 0 THEN '/e/' || event_id END AS uri, CASE WHEN event_id % 29 <> 0 THEN CASE event_id % 3 WHEN 2 THEN '' ELSE props END END AS said FROM {_SENT} WHERE broken IS NULL OR event_id <= broken")
def http_fragments(spark, d):
    """Each user's events as requests of one connection, sized, chunked or without a body, cut into fragments of 16 bytes that do not care where a message ends; a malformed request ends its connection."""
    n = F.col("event_id")
    size, line = F.octet_length("props").cast("string"), F.lit("\r\n")
    head = F.concat(F.when(n % 29 == 0, "POST?").otherwise("POST "), F.lit("/e/"), n, F.lit(" HTTP/1.1\r\nHost: h\r\n"))
    rest = F.when(n % 3 == 0, F.concat(F.lit("Content-Length: "), size, line, line, "props")).when(n % 3 == 1, F.concat(F.lit("Transfer-Encoding: gzip, chunked\r\n\r\n"), F.decode(web.chunk(F.col("props"), 7), "UTF-8"))).otherwise(line)
    raw = table(spark, d, "events").select("user_id", "event_id", F.concat(head, rest).cast("binary").alias("raw"))
    pieces = F.transform(F.sequence(F.lit(0), F.octet_length("raw"), F.lit(16)), lambda i: F.struct(i.alias("at"), F.substring(F.col("raw"), i + 1, F.lit(16)).alias("data")))
    cut = raw.select("user_id", "event_id", F.explode(pieces).alias("p")).select(F.col("user_id").alias("connection"), F.struct("event_id", "p.at").alias("seq"), "p.data")
    return messages.scan(cut).select("connection", "message", "complete", "uri", strings.as_text(F.col("body")).alias("said"))


@query("SELECT event_id, event_type AS kind, 'f' || event_id || '.json' AS filename, 'application/json' AS mimetype, props AS data, user_id::VARCHAR AS user_id, 2 AS parts FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, 'none', NULL FROM events WHERE event_id % 3 = 0")
def http_multipart(spark, d):
    """Files and fields of multipart forms in bytes; a part's value as a parameter where no form, query or JSON has it. Every third form has no boundary."""
    bad = F.col("event_id") % 3 == 0
    kind = F.when(bad, "multipart/form-data").otherwise(F.concat(F.lit('multipart/form-data; boundary="b-'), "event_id", F.lit('"')))
    line = F.concat(F.lit("--b-"), "event_id")
    body = F.concat(F.lit("ignored\r\n"), line, F.lit('\r\nContent-Disposition: form-data; name="user"\r\n\r\n'), "user_id", F.lit("\r\n"), line, F.lit('\r\ncontent-disposition: form-data; filename="f'), "event_id", F.lit('.json"; name="'), "event_type", F.lit('"\r\nContent-Type: application/json\r\n\r\n'), "props", F.lit("\r\n"), line, F.lit("--\r\n"), line)
    rows = table(spark, d, "events").select("event_id", web.multipart(kind, body).alias("parts"))
    none, file = F.lit(None).cast("string"), F.get("parts", F.lit(1))
    user = F.coalesce(web.parameter(none, none, none, "user", F.col("parts")), F.lit("none"))
    return rows.select("event_id", file["name"].alias("kind"), file["filename"].alias("filename"), file["mimetype"].alias("mimetype"), strings.as_text(file["data"]).alias("data"), user.alias("user_id"), F.nullif(F.size("parts"), F.lit(0)).alias("parts"))


@query("SELECT n, CASE WHEN n % 3 <> 0 THEN 'é' || n END AS text, CASE WHEN n % 3 <> 0 THEN 'wide' || n END AS wide, CASE WHEN n % 3 <> 0 THEN 80 + n % 100 END AS port, CASE WHEN n % 3 <> 0 THEN 9223372036854775807 - n END AS long, CASE WHEN n % 3 <> 0 THEN 'x' || n END AS bytes, CASE WHEN n % 3 <> 0 THEN '{\"u\":' || n || '}' END AS claims, CASE WHEN n % 3 = 0 THEN 'c' ELSE 'c' || n % 10 END AS body FROM (SELECT event_id AS n FROM events)")
def malformed_values(spark, d):
    """Every third row has bytes that are no text, an impossible port, a number beyond 64 bits, letters that are no code and a forged token with such bytes: null, never the end of the query. A body's length may divide a character."""
    n, bad = F.col("event_id"), F.col("event_id") % 3 == 0
    text = n.cast("string")
    junk = F.unhex(F.lit("C328FF"))
    number = json_values.parse(F.concat(F.lit(""), F.lit(2**63 - 1)))
    token = F.concat(codec.base64url(F.lit('{"alg":"HS256"}').cast("binary")), F.lit("."), codec.base64url(F.when(bad, junk).otherwise(F.concat(F.lit('{"u":'), text, F.lit("}")).cast("binary"))))
    signed = F.concat(token, F.lit("."), codec.base64url(codec.hmac(token, b"key")))
    forged = F.when(n % 6 == 0, F.concat(token, F.lit(".AAAA"))).when(n % 9 == 0, F.lit("a.%%%.c")).otherwise(signed)
    request = F.concat(F.lit("PUT / HTTP/1.1\r\nContent-Length: 2\r\n\r\nc"), F.when(bad, "é").otherwise((n % 10).cast("string")), F.lit("more"))
    body = web.parse_request(request)["body"]
    return table(spark, d, "events").select(
        n.alias("n"), strings.decode_document(F.when(bad, junk).otherwise(F.concat(F.lit("é"), text).cast("binary"))).alias("text"),
        strings.decode_by_mark(F.concat(F.unhex(F.lit("FFFE")), F.when(bad, F.unhex(F.lit("00D841"))).otherwise(F.encode(F.concat(F.lit("wide"), text), "UTF-16LE")))).alias("wide"),
        uri.parse(F.concat(F.lit("http://h:"), F.when(bad, "99999999999").otherwise((80 + n % 100).cast("string")), F.lit("/")))["port"].alias("port"),
        json_values.get(F.when(bad, json_values.add(number, json_values.parse((n + 1).cast("string")))).otherwise(json_values.subtract(number, json_values.parse(text))), "$", "bigint").alias("long"),
        strings.as_text(codec.unbase32(F.when(bad, "!1").otherwise(codec.base32(F.concat(F.lit("x"), text).cast("binary"))))).alias("bytes"),
        web.verify_token(forged, F.lit("key"), F.lit(0)).alias("claims"), F.coalesce(strings.as_text(body), strings.as_text(F.substring(body, 1, 1))).alias("body"),
    )


@query("SELECT event_id, event_id % 4 = 0 AS below, event_id % 3 <> 1 AS forged_free, CASE WHEN event_id % 2 = 0 THEN 'https://a' END AS origin, 'h' || event_id AS address, CASE WHEN event_id % 5 = 0 THEN 500 ELSE 200 END AS status, CASE WHEN event_id % 5 = 0 THEN '{\"error\":\"e' || event_id || '\"}' ELSE '{\"id\":' || event_id || '}' END AS body, CASE event_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/css' ELSE 'text/plain' END AS mime, '/in/' || event_id AS lead, CASE WHEN event_id % 7 = 0 THEN 'seven' WHEN event_id % 2 = 0 THEN 'even' END AS handled, CASE event_id % 3 WHEN 0 THEN 'Not Found' WHEN 1 THEN 'OK' ELSE 'Found it' END AS head, CASE WHEN event_id % 2 = 0 THEN 304 ELSE 200 END AS cached FROM events")
def web_rules(spark, d):
    """Prefixes, forged requests, origins, addresses, results and errors as replies, types of files, safe redirects, chains of handlers."""
    e, n = table(spark, d, "events"), F.col("event_id")
    text = n.cast("string")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    result = web.result_reply(F.struct(n.alias("id")), F.when(n % 5 == 0, F.concat(F.lit("e"), text)))
    return e.select(
        "event_id", web.has_prefix(F.concat(pick("/in/side/", "/inside/", "/", "/side/in/"), text), "/in/side").alias("below"), web.csrf_ok(F.lit("POST"), pick("t", "x", "t"), F.lit("t")).alias("forged_free"), F.try_element_at(web.allow_origin(pick("https://a", "https://b"), ["https://a"]), F.lit("Access-Control-Allow-Origin")).alias("origin"),
        web.client_address(F.concat(F.lit("x, h"), text), F.lit("z")).alias("address"), result["status"].alias("status"), result["body"].alias("body"), web.mime_type(pick("/a/b.HTML", "c.css", "d")).alias("mime"), web.safe_redirect(F.concat(pick("https://evil.net", "//evil", ""), F.lit("/in/"), text)).alias("lead"),
        web.first_accepting((n % 7 == 0, F.lit("seven")), (n % 2 == 0, F.lit("even"))).alias("handled"), F.when(n % 3 == 2, "Found it").otherwise(web.error_page(F.when(n % 3 == 0, 404).otherwise(200), F.lit("m"), F.lit("/"), F.lit("u"))["head"]).alias("head"), web.not_modified(n % 2, F.lit(0)).alias("cached"),
    )


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size % 3 = 1 THEN 'other' ELSE 'price' END AS action, CASE WHEN p_size % 3 = 0 THEN p_partkey END AS part, CASE WHEN p_size % 3 = 0 THEN '<env:Envelope xmlns:env=\"http://schemas.xmlsoap.org/soap/envelope/\"><env:Body><m:priceResponse xmlns:m=\"urn:p\"><twice>' || 2 * p_size || '</twice></m:priceResponse></env:Body></env:Envelope>' ELSE '<env:Envelope xmlns:env=\"http://schemas.xmlsoap.org/soap/envelope/\"><env:Body><env:Fault><faultcode>env:Server</faultcode><faultstring>no &lt;' || p_partkey || '&gt;</faultstring></env:Fault></env:Body></env:Envelope>' END AS reply, true AS described FROM part")
def soap_calls(spark, d):
    """Envelopes to actions and typed parameters, results and faults to envelopes; the service's description has all parts."""
    p = table(spark, d, "part")
    kind = F.col("p_size") % 3
    name = F.when(kind == 1, "other").otherwise("price")
    call = F.concat(F.lit('<?xml version="1.0"?><e:Envelope xmlns:e="http://schemas.xmlsoap.org/soap/envelope/"><e:Header/><e:Body><q:'), name, F.lit(' xmlns:q="urn:p"><q:part>'), "p_partkey", F.lit("</q:part><q:n>"), "p_size", F.lit("</q:n></q:"), name, F.lit("></e:Body></e:Envelope>"))
    message = F.when(kind == 2, "<no/>").otherwise(call)
    asked = soap.parameters(message, "price", "part bigint, n int")
    answer = F.when(asked.isNotNull(), soap.response("price", F.struct((2 * asked["n"]).alias("twice")), "urn:p")).otherwise(soap.fault(F.concat(F.lit("no <"), "p_partkey", F.lit(">"))))
    made = soap.describe("Prices", "urn:p", "http://h/p", {"price": (T.StructType().add("part", T.LongType()).add("n", T.IntegerType()), T.StructType().add("twice", T.IntegerType()))})
    wanted = ("wsdl:types", 'name="priceResponse"', 'message="ns:priceMessage"', "soap:binding", 'location="http://h/p"')
    return p.select("p_partkey", soap.action(message)["name"].alias("action"), asked["part"].alias("part"), answer.alias("reply"), F.lit(all(x in made for x in wanted)).alias("described"))


_URLS = "(SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"


@query(f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 11 ELSE NULL END WHEN page_id % 5 = 1 THEN 12 WHEN page_id % 5 = 2 THEN CASE WHEN page_id % 2 = 0 THEN 13 ELSE 20 END WHEN path LIKE '%.html' THEN 21 ELSE NULL END AS mount_no, CASE WHEN page_id % 5 = 1 THEN 'p ' || page_id END AS id FROM {_URLS}""")
def mount_table(spark, d):
    """Requests of pages find their mounts in a table: exact paths by method, paths with names, a glob with alternatives and one for all names."""
    p = table(spark, d, "pages")
    n, k = F.col("page_id"), F.col("page_id") % 5
    path = F.when(k == 0, "/Exact/path").when(k == 1, F.concat(F.lit("/user/p%20"), n, F.lit("/show"))).when(k == 2, F.concat(F.lit("/files/"), n, F.lit(".txt"))).otherwise(uri.parse(F.col("url"))["path"])
    method = F.when((k == 0) & (n % 2 == 1), "POST").when((k == 2) & (n % 2 == 1), "HEAD").otherwise("GET")
    table_ = spark.createDataFrame(
        [(11, "GET", "path", "/Exact/path"), (12, "GET", "path", "/user/{id}/{what}"), (14, "GET", "path", "/user/{id}/show"), (13, "GET", "path", "/files/{name}"), (20, "GET", "glob", "/nowhere/;/files/*.txt"), (21, None, "glob", "**/*.html;/*.html")],
        "mount_no int, method string, kind string, path string",
    )
    found = mounts.dispatch(p.select("page_id", path.alias("path"), method.alias("method")), table_)
    return found.select("page_id", "mount_no", F.try_element_at("parameters", F.lit("id")).alias("id"))


@query("SELECT event_id, user_id AS id, event_id % 2 = 0 AS flag, [event_id, user_id] AS list, 'n' || user_id AS name, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS kind, CASE WHEN event_id % 4 <> 0 THEN event_id END AS number, '2024-01-02'::DATE AS day FROM events")
def rest_binding(spark, d):
    """Arguments of calls by type: numbers, truth values, lists and structs in JSON, enums, dates; texts that are none are null."""
    n, user = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    values = F.create_map(
        F.lit("id"), F.concat(F.lit(" "), user), F.lit("flag"), F.when(n % 2 == 0, "true").otherwise("no"), F.lit("list"), F.concat(F.lit("["), n, F.lit(", "), user, F.lit("]")), F.lit("who"), F.concat(F.lit('{"name": "n'), user, F.lit('", "more": 1}')),
        F.lit("kind"), F.element_at(F.array(F.lit("low"), F.lit("high"), F.lit("odd")), (n % 3 + 1).cast("int")), F.lit("number"), F.when(n % 4 == 0, F.lit("99999999999999999999")).otherwise(text(n)), F.lit("day"), F.lit("2024-01-02"),
    )
    a = mounts.bind(values, "id bigint, flag boolean, list array<bigint>, who struct<name: string>, kind int, number bigint, day date, missing array<string>", {"kind": {1: "low", 2: "high"}})
    rows = table(spark, d, "events").select("event_id", a.alias("a")).filter("a.missing IS NULL")
    return rows.select("event_id", "a.id", "a.flag", "a.list", F.col("a.who.name").alias("name"), "a.kind", "a.number", "a.day")


_REASON = "CASE event_id % 3 WHEN 0 THEN 'Not Found' WHEN 1 THEN 'Forbidden' ELSE 'Not Modified' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 2 OR event_id % 4 = 0 THEN '' ELSE '<html><body><h1>' || {_REASON} || '</h1><p>&lt;' || event_type || '&gt;</p></body></html>' END AS body,
CASE WHEN event_id % 3 <> 2 THEN (octet_length(encode('<html><body><h1>' || {_REASON} || '</h1><p>&lt;' || event_type || '&gt;</p></body></html>')))::VARCHAR END AS size,
CASE WHEN event_id % 5 = 0 THEN '/ctx/in/' || event_id ELSE 'http://h/' || event_id END AS location, '/in/' || event_id AS after FROM events""")
def web_replies(spark, d):
    """Stock pages, bodies that HEAD leaves out, redirections below a context, where a logout leads."""
    n, k = F.col("event_id"), F.col("event_id") % 3
    status = F.when(k == 0, 404).when(k == 1, 403).otherwise(304)
    made = replies.served(replies.stock(status, F.concat(F.lit("<\x01"), "event_type", F.lit(">"))), F.when(n % 4 == 0, "HEAD").otherwise("GET"))
    moved = F.struct(F.lit(302).alias("status"), F.create_map(F.lit("Location"), F.concat(F.when(n % 5 == 0, "/in/").otherwise("http://h/"), n)).alias("headers"), F.lit("").alias("body"))
    rows = table(spark, d, "events").select("event_id", made.alias("r"), replies.served(moved, F.lit("GET"), "/ctx").alias("m"), replies.logout(F.concat(F.lit("//evil.net/in/"), n)).alias("o"))
    return rows.select("event_id", "r.body", F.try_element_at("r.headers", F.lit("Content-Length")).alias("size"), F.try_element_at("m.headers", F.lit("Location")).alias("location"), F.col("o.location").alias("after"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 403 WHEN event_id % 2 = 1 THEN 303 ELSE 200 END AS status, CASE WHEN event_id % 4 <> 0 AND event_id % 2 = 1 THEN '/e/' || event_id END AS location, CASE WHEN event_id % 4 <> 0 AND event_id % 2 = 1 THEN user_id END AS known, CASE WHEN event_id % 4 = 2 THEN true END AS form, '404 ' || event_type AS page FROM events")
def web_logins(spark, d):
    """Logins of the events' users: forged ones, right ones with a token that verifies, wrong ones with the form again; an error page by a template."""
    e, n = table(spark, d, "events"), F.col("event_id")
    name = F.concat(F.lit("u"), "user_id")
    users = e.select(name.alias("username")).distinct().select("username", codec.encode_password(F.concat(F.lit("pw"), "username"), F.lit("salt"), 2).alias("stored"), F.array(F.lit("USER")).alias("role"))
    asked = e.select("event_id", "event_type", "user_id", name.alias("username"), F.concat(F.when(n % 2 == 1, "pw").otherwise("no"), name).alias("password"), F.concat(F.lit("//x/e/"), n).alias("uri"), F.lit("c").alias("csrf"), F.when(n % 4 == 0, "d").otherwise("c").alias("own_csrf"))
    rows = replies.login(asked, users, F.lit("key"), F.lit(1_000)).withColumn("token", F.regexp_extract("cookie", "^access_token=([^;]*)", 1))
    claims = web.verify_token(F.col("token"), F.lit("key"), F.lit(2_000), F.array(F.lit("USER")))
    rows = rows.withColumn("error", replies.error_model(F.lit(404), F.col("event_type"), F.lit("GET"), F.lit("/"), F.col("username")))
    page = replies.error_pages(rows, templates={"error": '<e xmlns:t="http://treeloom.example/template">[[${error.nr}]] [[${error.message}]]</e>'})
    known = F.regexp_extract(F.get_json_object(claims, "$.username"), "([0-9]+)", 1).try_cast("bigint")
    form = F.when(F.contains("page", F.concat(F.lit('name="username" value="'), name, F.lit('"'))), True)
    return rows.select("event_id", "status", "location", known.alias("known"), form.alias("form"), F.regexp_extract(page, "<e>(.*)</e>", 1).alias("page"))


@query("SELECT event_id, event_type || ' xmlns=\"q\" and' AS a, '<b:c xmlns=\"k\">' || user_id AS b, user_id AS k FROM events")
def soap_texts(spark, d):
    """Calls whose texts look like names and namespaces keep them."""
    call = F.concat(F.lit('<e:Envelope xmlns:e="u"><e:Body><q:f xmlns:q="p"><q:a>'), "event_type", F.lit(' xmlns="q" and</q:a><b><![CDATA[<b:c xmlns="k">'), "user_id", F.lit(']]></b><c k="'), "user_id", F.lit('">t</c></q:f></e:Body></e:Envelope>'))
    p = soap.parameters(call, "f", "a string, b string, c struct<_k: bigint, _VALUE: string>")
    return table(spark, d, "events").select("event_id", p.alias("p")).select("event_id", "p.a", "p.b", F.col("p.c._k").alias("k"))


@query(f"SELECT event_id, '[' || event_id || ',' || CASE event_id % 3 WHEN 0 THEN k || ']' WHEN 1 THEN user_id || ',' || k || ']' ELSE user_id || ',null,' || k || ']' END AS put, '[' || user_id || ']' AS cut, true AS own, event_id = user_id * 2 AS double, CASE WHEN event_id % 3 = 0 THEN '[null,' || k || ']' ELSE '[' || k || ']' END AS fresh FROM {_K}".replace("event_id = user_id * 2 AS double", "(event_id = user_id * 2 OR user_id = 0) AS double"))
def json_arrays(spark, d):
    """Members set beyond an array's end, ranges taken out, members of any kind found."""
    v, n = F.col("v"), F.col("event_id")
    one = lambda c: F.try_variant_get(F.to_variant_object(F.array(c)), "$[0]", "variant")
    xs, k, show = json_values.get(v, "$.xs"), one(F.col("k")), json_values.to_text
    none = json_values.parse(F.lit("null"))
    return _numbers(spark, d).select(
        "event_id", show(json_values.put_at(xs, (n % 3 + 1).cast("int"), k)).alias("put"), show(json_values.erase_range(xs, F.lit(0), F.lit(1))).alias("cut"), json_values.has_member(xs, one(n.cast("double"))).alias("own"),
        json_values.has_member(xs, json_values.multiply(one(F.col("user_id")), json_values.parse(F.lit("2")))).alias("double"), show(json_values.put_at(none, F.when(n % 3 == 0, 1).otherwise(0), k)).alias("fresh"),
    )
