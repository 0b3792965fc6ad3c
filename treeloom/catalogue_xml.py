"""Registered queries over XML: axes, predicates, functions, changes of trees, writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .catalogue import customer_nodes, order_nodes
from .functions import strings
from .operators import dom, dtd, entities, structs
from .plans import xpath as P
from .plans.template import Template
from .plans.xpath import xpath
from .registry import query, table
from .sources import records as R
from .sources import xml as X

_ORDERS = "(SELECT o_orderkey AS doc_id, l_linenumber AS no, l_returnflag AS flag, l_quantity::INTEGER AS qty, l_extendedprice::DECIMAL(18,2)::DOUBLE AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
_CUSTOMERS = "(SELECT o_custkey AS doc_id, o_orderkey, l_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL)"


#: One line for each number of an order, so that lines have an order of their own.
_LINES = "(SELECT l_orderkey AS doc_id, l_linenumber AS no, min(l_returnflag) AS flag, max(l_quantity)::INTEGER AS qty FROM lineitem GROUP BY ALL)"


def _line_nodes(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("no")).agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").cast("int").alias("qty"))
    line = X.element("line", {"no": F.col("no"), "flag": F.col("flag"), "qty": F.col("qty")})
    docs = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("x")))), lambda s: s["x"]), "").alias("x"))
    return X.written(X.shred(docs.select("doc_id", X.element("order", {}, F.col("x")).alias("xml")), texts=False))


def _counts(nodes, **paths):
    """doc_id and the number of nodes that each path selects, 0 included, from one pass over the paths' rows."""
    tagged = [xpath(nodes, p).select("doc_id", F.lit(name).alias("of")) for name, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged).groupBy("doc_id").agg(*[F.count_if(F.col("of") == name).alias(name) for name in paths])


@query(f"SELECT doc_id, 3 * count(l_orderkey) AS around, count(DISTINCT o_orderkey) + count(l_orderkey) AS inside, count(l_orderkey) AS parents, count(l_orderkey) AS selves FROM {_CUSTOMERS} GROUP BY 1")
def xpath_self_axes(spark, d):
    """ancestor-or-self, descendant-or-self, parent and self; duplicates are kept."""
    return _counts(customer_nodes(spark, d), around="//line/ancestor-or-self::*", inside="//order/descendant-or-self::*", parents="//line/..", selves="//line/self::line")


def _named_parts(spark, d):
    p = table(spark, d, "part")
    item = X.element("item", {"xml:id": F.concat(F.lit("i"), (F.col("p_partkey") % 7).cast("string")), "p:size": F.col("p_size")}, strings.escape_xml(F.col("p_name")))
    other = F.when(F.col("p_size") % 2 == 0, X.element("p:even", {"n": F.col("p_size")})).otherwise(X.element("odd", {}))
    spaces = {"xmlns": F.when(F.col("p_size") % 3 == 0, "urn:three"), "xmlns:p": F.concat(F.lit("urn:p"), (F.col("p_size") % 5).cast("string"))}
    return X.written(X.shred(p.select(F.col("p_partkey").alias("doc_id"), X.element("p:part", spaces, item, other).alias("xml")), texts=False))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS spaces, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 6 = 3 THEN 1 ELSE 0 END AS in_three, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS evens, CASE WHEN p_partkey % 7 = 3 THEN 1 ELSE 0 END AS third FROM part")
def xpath_names(spark, d):
    """namespace axis, namespace-uri(), name(), local-name() and id()."""
    return _counts(_named_parts(spark, d), spaces="/*/namespace::*", in_three="//*[namespace-uri() = 'urn:three']", evens="//*[name() = 'p:even' and local-name(.) = 'even']", third="//item[id() = 'i3']")


@query("SELECT p_partkey AS doc_id, 'p:part' AS qname, 'p' AS prefix, 'part' AS local, 'urn:p' || (p_size % 5) AS ns_uri FROM part UNION ALL SELECT p_partkey, 'p:even', 'p', 'even', 'urn:p' || (p_size % 5) FROM part WHERE p_size % 2 = 0")
def xml_name_parts(spark, d):
    """Name parts and namespaces of elements with a prefix."""
    return xpath(_named_parts(spark, d), "//*").filter("prefix IS NOT NULL").select("doc_id", "qname", "prefix", "local", "ns_uri")


@query(f"SELECT doc_id, bool_or(qty = 17) AS eq, bool_or(qty <> 17) AS ne, bool_or(price > 90000) AS gt, bool_or(price <= 5000) AS le, bool_or(qty = no) AND count(*) > 0 AS unused FROM {_ORDERS} GROUP BY 1".replace(", bool_or(qty = no) AND count(*) > 0 AS unused", ""))
def xpath_any_node(spark, d):
    """A comparison with a node-set holds if one of its nodes compares."""
    nodes = order_nodes(spark, d)
    paths = {"eq": "/order[line/@qty = 17]", "ne": "/order[line/@qty != 17]", "gt": "/order[line/@price > 90000]", "le": "/order[5000 >= line/@price]"}
    found = _counts(nodes, all="/order", **paths)
    return found.select("doc_id", *[(F.col(k) > 0).alias(k) for k in paths])


@query(f"SELECT a.doc_id FROM (SELECT doc_id, list(DISTINCT qty) AS q, list(DISTINCT no) AS n, min(qty) AS least, max(no) AS most FROM {_ORDERS} GROUP BY 1) a WHERE list_has_any(q, n) OR least > most")
def xpath_set_to_set(spark, d):
    """Two node-sets compare if one pair of their nodes does."""
    return xpath(order_nodes(spark, d), "/order[line/@qty = line/@no or not(line/@qty <= line/@no)]").select("doc_id")



_MIXED = "(SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS v, p_size, p_name FROM part)"


def _mixed_parts(spark, d):
    p = table(spark, d, "part")
    v = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return X.written(X.shred(p.select(F.col("p_partkey").alias("doc_id"), X.element("part", {"v": v, "n": F.col("p_size"), "from": F.lit("aeo"), "to": F.lit("AE")}, strings.escape_xml(F.col("p_name"))).alias("xml"))))


@query(f"SELECT doc_id, (p_size % 4 = 2 AND p_size % 2 = 0)::INT AS rest, (p_size % 2 = 0)::INT AS whole, (p_size % 2 = 0)::INT AS self, (p_size % 2 = 1)::INT AS unlike, (p_size % 2 = 0 AND p_size <= 9)::INT AS cut, (p_size % 2 = 0 AND p_size > 20)::INT AS big FROM {_MIXED}")
def xpath_nan(spark, d):
    """Numbers of texts that are none are NaN: equal to nothing, in no order, and no error anywhere."""
    return _counts(
        _mixed_parts(spark, d), rest="/part[@v mod 4 = 2]", whole="/part[floor(@v) = ceiling(@v)]", self="/part[number(@v) = number(@v)]", unlike="/part[string(number(@v)) = 'NaN']", cut="/part[substring('123456789', @v, 1) != '']",
        big="/part[round(@v) > 20]", all="/part",
    ).drop("all")


@query(f"SELECT doc_id, (length(split_part(p_name, ' ', 1)) > 5 AND contains(p_name, ' '))::INT AS before, (contains(p_name, ' ') AND (length(p_name) - strpos(p_name, ' ')) % 2 = 0)::INT AS behind, (translate(p_name, 'aeo', 'AE') LIKE '%A%E%')::INT AS turned, (substr(p_name, p_size % 10 + 1, 3) LIKE '%a%')::INT AS cut, (length(trim(regexp_replace('  ' || p_name, '\\s+', ' ', 'g'))) > 18)::INT AS spaced FROM {_MIXED}")
def xpath_substring_parts(spark, d):
    """substring-before, substring-after, translate with nodes as arguments, substring with computed places, normalize-space."""
    return _counts(
        _mixed_parts(spark, d), before="/part[string-length(substring-before(., ' ')) > 5]", behind="/part[contains(., ' ') and string-length(substring-after(., ' ')) mod 2 = 0]",
        turned="/part[contains(substring-after(translate(., @from, @to), 'A'), 'E')]", cut="/part[contains(substring(., @n mod 10 + 1, 3), 'a')]", spaced="/part[string-length(normalize-space(concat('  ', .))) > 18]", all="/part",
    ).drop("all")


@query(f"SELECT doc_id, count(*) FILTER (no = 3) AS third, count(*) FILTER (flag = 'R') AS returned, 1 AS first, count(*) FILTER (no > 2) AS members FROM {_ORDERS} GROUP BY 1")
def xpath_variables(spark, d):
    """Variables, the first match of each document, and membership of nodes in a result."""
    nodes = order_nodes(spark, d)
    third = xpath(nodes, "//line[@no = $n]", variables={"n": 3}).select("doc_id", F.lit("third").alias("of"))
    returned = xpath(nodes, "//line[@flag = $f]", variables={"f": "R"}).select("doc_id", F.lit("returned").alias("of"))
    first = P.first(nodes, "/order/line").select("doc_id", F.lit("first").alias("of"))
    members = P.matches(nodes, nodes.filter("kind = 'element' AND level = 2"), "//line[@no > 2]").select("doc_id", F.lit("members").alias("of"))
    rows = third.unionByName(returned).unionByName(first).unionByName(members)
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("of") == x).alias(x) for x in ("third", "returned", "first", "members")])


@query(f"""SELECT doc_id, coalesce(arg_min(no, rank) > 2, false)::INT AS first, (count(*) FILTER (flag <> 'N') > 1 AND max(CASE WHEN flag = 'R' THEN no END) IS NOT NULL)::INT AS others,
(count(*) FILTER (qty > 40) > 1)::INT AS two_big, (count(*) FILTER (qty > 40) > 0 AND min(no) = 1)::INT AS up, (sum(no) + sum(qty) > 100)::INT AS both, (count(*) FILTER (flag = 'A' AND qty > 40) > 0)::INT AS any_big
FROM (SELECT *, CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN 100 ELSE NULL END + no AS rank FROM {_LINES}) GROUP BY 1""")
def xpath_filter_sets(spark, d):
    """Predicates and steps on whole node-sets: the first of a union, steps from a union and from a variable's nodes."""
    nodes = _line_nodes(spark, d)
    big = xpath(nodes, "//line[@qty > 40]").select("doc_id", "pre")
    paths = {
        "first": "/order[(line[@flag = 'R'] | line[@flag = 'A'])[1]/@no > 2]", "others": "/order[(line[@flag = 'R'] | line[@flag = 'A'])[position() > 1]/../line[@flag = 'R']]", "two_big": "/order[($big)[2]]",
        "up": "/order[$big/../line[1]/@no = 1]", "both": "/order[sum((line/@no | line/@qty)[string-length(.) > 0 or true()]) > 100]", "any_big": "/order[$big[@flag = 'A']]",
    }
    tagged = [xpath(nodes, p, variables={"big": big}).select("doc_id", F.lit(name).alias("of")) for name, p in paths.items()]
    rows = reduce(lambda a, b: a.unionByName(b), [xpath(nodes, "/order").select("doc_id", F.lit("all").alias("of")), *tagged])
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("of") == name).cast("int").alias(name) for name in paths])


@query(f"SELECT doc_id FROM {_ORDERS} GROUP BY 1 HAVING sum(qty) > 60 AND floor(sum(qty) / count(*) + 0.5)::INT % 2 = 0 AND count(*) > 1 AND count(*)::VARCHAR <> '4'")
def xpath_sum_round(spark, d):
    """sum, round, unary minus, boolean, true, false and text of numbers."""
    return xpath(order_nodes(spark, d), "/order[sum(line/@qty) > 60 and round(sum(line/@qty) div count(line)) mod 2 = 0 and boolean(line[2]) = true() and not(false()) and -count(line) < -1 and string(count(line)) != '4']").select("doc_id")


@query(f"SELECT doc_id, no FROM (SELECT doc_id, no, row_number() OVER (PARTITION BY doc_id ORDER BY no, price) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {_ORDERS}) WHERE k > 1 AND k < n")
def xpath_positions(spark, d):
    return xpath(order_nodes(spark, d), "/order/line[position() > 1 and position() != last()]/@no").select("doc_id", F.col("value").cast("int").alias("no"))


@query("SELECT event_id AS doc_id, (event_type = 'click')::INT AS clicks, 2 AS instructions, (event_id % 3 = 0)::INT AS comments, (event_id % 2 = 0)::INT + (event_id % 5 = 0)::INT AS texts FROM events")
def xpath_node_kinds(spark, d):
    """Tests by kind of node: processing instructions by target, comments, text and CDATA."""
    e = table(spark, d, "events")
    inner = [F.concat(F.lit("<?"), "event_type", F.lit(" x?>")), F.lit("<?other y?>"), F.when(F.col("event_id") % 3 == 0, "<!--c-->"), F.when(F.col("event_id") % 2 == 0, "some text"), F.lit("<e/>"), F.when(F.col("event_id") % 5 == 0, "<![CDATA[a < b]]>")]
    nodes = X.written(X.shred(e.select(F.col("event_id").alias("doc_id"), X.element("d", {}, *inner).alias("xml")), texts=False))
    return _counts(nodes, clicks="//processing-instruction('click')", instructions="//processing-instruction()", comments="//comment()", texts="//text()")


def _orders(spark, d):
    """Documents of orders and the places of their elements."""
    nodes = order_nodes(spark, d)
    return nodes, xpath(nodes, "/order").select("doc_id", "pre"), xpath(nodes, "/order/line")


_LINE = "'<line flag=\"' || flag || '\" no=\"' || no || '\" price=\"' || price_text || '\" qty=\"' || qty || '\"/>'"
_WRITTEN = "(SELECT o_orderkey AS doc_id, o_orderstatus AS status, l_linenumber AS no, l_returnflag AS flag, l_quantity::INTEGER AS qty, l_extendedprice::DECIMAL(18,2)::VARCHAR AS price_text, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@query(f"SELECT doc_id, '<order id=\"x' || doc_id || '\" status=\"' || status || '\" size=\"' || count(*) || '\">' || string_agg({_LINE.replace('/>', ' kind=\"l\"/>')}, '' ORDER BY no, part, flag, qty::VARCHAR, price_text) || '</order>' AS xml FROM {_WRITTEN} GROUP BY doc_id, status")
def dom_set_attribute(spark, d):
    """An attribute changed, one added from other columns, one added to all children."""
    nodes, order, lines = _orders(spark, d)
    n = lines.groupBy("doc_id").agg(F.count("*").alias("n"))
    out = dom.set_attribute(nodes, order, "id", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    out = dom.set_attribute(out, xpath(out, "/order").select("doc_id", "pre").join(n, "doc_id"), "size", F.col("n"))
    return X.from_nodes(dom.set_attribute(out, xpath(out, "/order/line"), "kind", F.lit("l")), collapse=True)


@query(f"SELECT doc_id, '<order id=\"' || doc_id || '\" status=\"' || status || CASE WHEN count(*) FILTER (flag <> 'R') = 0 THEN '\"/>' ELSE '\">' END || coalesce(string_agg({_LINE.replace("flag=\"' || flag || '\" ", "")}, '' ORDER BY no, part, flag, qty::VARCHAR, price_text) FILTER (flag <> 'R'), '') || CASE WHEN count(*) FILTER (flag <> 'R') = 0 THEN '' ELSE '</order>' END AS xml FROM {_WRITTEN} GROUP BY doc_id, status")
def dom_erase(spark, d):
    """Elements erased, an attribute removed from the others."""
    nodes, _, _ = _orders(spark, d)
    out = dom.erase(nodes, xpath(nodes, "/order/line[@flag = 'R']"))
    return X.from_nodes(dom.remove_attribute(out, xpath(out, "//line"), "flag"), collapse=True)


@query(f"SELECT doc_id, '<order id=\"' || doc_id || '\" status=\"' || status || '\"><!--n=' || count(*) || '-->' || string_agg({_LINE} || '<gap/>', '' ORDER BY no, part, flag, qty::VARCHAR, price_text) || '<end/></order>' AS xml FROM {_WRITTEN} GROUP BY doc_id, status")
def dom_insert(spark, d):
    """Nodes put in first, last and after others."""
    nodes, _, lines = _orders(spark, d)
    zero, none = F.lit(0).cast("long").alias("place"), F.lit(None).cast("string")
    n = lines.groupBy("doc_id").agg(F.count("*").alias("n"))
    note = lambda order: order.join(n, "doc_id").select("doc_id", "pre", zero, F.lit("comment").alias("kind"), none.alias("qname"), F.concat(F.lit("n="), "n").alias("value"))
    one = lambda rows, name: rows.select("doc_id", "pre", zero, F.lit("element").alias("kind"), F.lit(name).alias("qname"), none.alias("value"))
    out = dom.insert(nodes, lines, "after", one(lines, "gap"))
    order = xpath(out, "/order").select("doc_id", "pre")
    out = dom.insert(out, order, "first", note(order))
    order = xpath(out, "/order")
    return X.from_nodes(dom.insert(out, order, "last", one(order, "end")), collapse=True)


@query(f"SELECT doc_id, '<order id=\"' || doc_id || '\" status=\"' || status || '\">' || string_agg({_LINE.replace('/>', '>')} || qty || '&lt;</line>', '' ORDER BY qty DESC, no, part) || '</order>' AS xml FROM {_WRITTEN} GROUP BY doc_id, status")
def dom_text_and_sort(spark, d):
    """Texts set from attributes, added to and merged; children sorted by an attribute."""
    nodes, order, _ = _orders(spark, d)
    qty = xpath(nodes, "//line/@qty").select("doc_id", F.col("parent_pre").alias("pre"), "value")
    out = dom.set_content(nodes, qty, F.col("value"))
    lines = xpath(out, "//line")
    more = lines.select("doc_id", "pre", F.lit(0).cast("long").alias("place"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("qname"), F.lit("<").alias("value"))
    out = dom.merge_text(dom.insert(out, lines, "last", more))
    said = dom.direct_text(out).select("doc_id", "pre", F.regexp_extract("text", "^[0-9]+", 0).try_cast("int").alias("q"))
    out = out.join(said, ["doc_id", "pre"], "left")
    return X.from_nodes(dom.sort_children(out, xpath(out, "/order"), -F.coalesce("q", F.lit(0))))


@query(f"SELECT doc_id, count(*) AS elements, count(*) FILTER (flag = 'R') AS other FROM {_ORDERS} GROUP BY 1")
def dom_namespaces(spark, d):
    """Elements moved to a namespace; what a prefix and a namespace stand for around every element."""
    nodes, order, _ = _orders(spark, d)
    out = X.written(dom.move_to_namespace(nodes, order, "n", "urn:n"))
    back = dom.namespace_for_prefix(out, "n").filter("uri = 'urn:n'").join(dom.prefix_for_namespace(out, "urn:n").filter("prefix = 'n'"), ["doc_id", "pre"])
    lines = out.filter("qname = 'n:line' AND ns_uri = 'urn:n' AND prefix = 'n'").select("doc_id", "pre")
    flags = xpath(out, "//line[@flag = 'R']").select("doc_id", F.lit(1).alias("r")).groupBy("doc_id").agg(F.count("*").alias("other"))
    n = lines.join(back, ["doc_id", "pre"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("elements"))
    return n.join(flags, "doc_id", "left").na.fill({"other": 0}).select("doc_id", "elements", "other")


@query("SELECT p_partkey AS doc_id, p_size % 3 <> 0 AS equal FROM part")
def dom_equal(spark, d):
    """Trees are equal whatever the order of attributes, white space between elements and comments; a changed text or a missing element makes them unequal."""
    p = table(spark, d, "part")
    a, b = F.col("p_brand"), F.col("p_size").cast("string")
    one = F.concat(F.lit('<p a="'), a, F.lit('" b="'), b, F.lit('"><q>'), b, F.lit("</q><r/></p>"))
    two = F.concat(F.lit("<p b='"), b, F.lit("' a='"), a, F.lit("'>\n  <q>"), F.when(F.col("p_size") % 6 == 0, "other").otherwise(b), F.lit("</q><!-- c -->\n"), F.when(F.col("p_size") % 6 == 3, "").otherwise("<r></r>"), F.lit("\n</p>"))
    left, right = (X.shred(p.select(F.col("p_partkey").alias("doc_id"), x.alias("xml")), texts=False) for x in (one, two))
    return dom.equal(left, right)


@query(f"SELECT 2 * doc_id + 1 AS doc_id, no, next, previous FROM (SELECT doc_id, no, lead(no) OVER w AS next, lag(no) OVER w AS previous FROM {_ORDERS} WINDOW w AS (PARTITION BY doc_id ORDER BY no, price))")
def dom_neighbours(spark, d):
    """Cloned documents under new keys; every line with the numbers of its next and previous sibling."""
    nodes = dom.clone(order_nodes(spark, d), 2 * F.col("doc_id") + 1)
    no = xpath(nodes, "//line/@no").select("doc_id", F.col("parent_pre").alias("pre"), F.col("value").cast("int").alias("no"))
    rows = dom.neighbours(nodes).filter("local = 'line'").select("doc_id", "pre", "next_element", "previous_element").join(no, ["doc_id", "pre"])
    for side in ("next", "previous"):
        rows = rows.join(no.select("doc_id", F.col("pre").alias(f"{side}_element"), F.col("no").alias(side)), ["doc_id", f"{side}_element"], "left")
    return rows.select("doc_id", "no", "next", "previous")


@query("SELECT p_partkey AS doc_id, CASE p_size % 4 WHEN 0 THEN 'outside of its parent' WHEN 1 THEN 'wrong place among siblings' WHEN 2 THEN 'no parent' END AS problem FROM part WHERE p_size % 4 <> 3")
def dom_violations(spark, d):
    """Broken tables are told: ranks, places and parents are spoilt by the part's size."""
    p = table(spark, d, "part")
    nodes = X.shred(p.select(F.col("p_partkey").alias("doc_id"), F.lit("<a><b/><c/></a>").alias("xml")), texts=False).join(p.select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 4).alias("how")), "doc_id")
    c = F.col("local") == "c"
    spoilt = nodes.withColumn("post", F.when(c & (F.col("how") == 0), 99).otherwise(F.col("post"))).withColumn("ord", F.when(c & (F.col("how") == 1), 7).otherwise(F.col("ord"))).withColumn("parent_pre", F.when(c & (F.col("how") == 2), 77).otherwise(F.col("parent_pre")))
    return dom.violations(spoilt.drop("how")).select("doc_id", "problem")


@query("SELECT p_partkey AS doc_id, '<part>' || chr(10) || '  <n>' || p_size || '</n>' || chr(10) || '  <m a=\"' || p_brand || '\">x <b>y</b></m>' || CASE WHEN p_size % 2 = 0 THEN chr(10) || '  <e/>' ELSE '' END || chr(10) || '</part>' AS indented, '<part><n>' || p_size || '</n><m a=\"' || p_brand || '\">x <b>y</b></m>' || CASE WHEN p_size % 2 = 0 THEN '<e></e>' ELSE '' END || '<br></part>' AS html FROM part")
def xml_write_options(spark, d):
    """Indented with collapsed empty tags and without comments; and as HTML with void elements."""
    p = table(spark, d, "part")
    body = [X.element("n", {}, F.col("p_size").cast("string")), F.lit("  "), X.element("m", {"a": F.col("p_brand")}, F.lit("x <b>y</b>")), F.lit("<!--c-->"), F.when(F.col("p_size") % 2 == 0, "<e/>")]
    docs = p.select(F.col("p_partkey").alias("doc_id"), X.element("part", {}, *body).alias("xml"), X.element("part", {}, *[x for i, x in enumerate(body) if i != 1], F.lit("<br/>")).alias("page"))
    one = X.from_nodes(X.written(X.shred(docs, texts=False)), collapse=True, indent=2, comments=False).withColumnRenamed("xml", "indented")
    return one.join(X.from_nodes(X.written(X.shred(docs, xml="page", texts=False)), html=True, comments=False).withColumnRenamed("xml", "html"), "doc_id")


@query("SELECT page_id, page_id % 3 = 0 AS broken, page_id % 4 = 0 AS html5, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 4 = 0 THEN '©é' || page_id ELSE 'plain' || page_id END AS text FROM pages")
def xml_wf_verdict(spark, d):
    """Every third document is not well-formed, by a branch that its number chooses; every fourth names characters as HTML 5 does."""
    n = F.col("page_id").cast("string")
    five = F.col("page_id") % 4 == 0
    body = F.concat(F.when(five, "<!DOCTYPE html><d>&copy;&eacute;").otherwise("<d>plain"), n, F.lit("</d>"))
    ways = [F.lit("<d><a></d></a>"), F.lit('<d a="1" a="2"/>'), F.lit("<d>&nothing;</d>"), F.lit("<d>&#0;</d>"), F.lit("<p:d/>"), F.lit("<d></d><e/>"), F.lit('<d xmlns:p="u" xmlns:q="u" p:a="1" q:a="2"/>'), F.lit('<d xmlns:xml="other"/>'), F.lit("")]
    bad = F.element_at(F.array(*ways), (F.floor(F.col("page_id") / 3) % len(ways) + 1).cast("int"))
    docs = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.when(five, "<!DOCTYPE html>").otherwise(""), bad)).otherwise(body).alias("xml"))
    said = X.verdicts(docs, "page_id").select("page_id", F.col("wf_error").isNotNull().alias("broken"), F.col("is_html5").alias("html5"))
    return said.join(X.shred(docs, "page_id").filter("kind = 'root'").select("page_id", F.col("str_value").alias("text")), "page_id", "left")


@query("SELECT p_partkey AS doc_id, p_brand || 'inc' || p_size AS text, p_size % 2 = 0 AS loaded FROM part WHERE p_size % 5 <> 0")
def xml_external_entities(spark, d):
    """Document types and entities of an allow-list, with parameter entities and conditional sections; documents that ask for others are rejected."""
    p = table(spark, d, "part")
    allowed = {"known.dtd": "<!ENTITY % on 'INCLUDE'><![%on;[<!ENTITY inc 'inc'><!ATTLIST d loaded CDATA 'yes'>]]><![IGNORE[<!ENTITY inc 'no'>]]>", "plain.dtd": "<!ENTITY inc 'inc'>"}
    name = F.when(F.col("p_size") % 5 == 0, "unknown.dtd").when(F.col("p_size") % 2 == 0, "known.dtd").otherwise("plain.dtd")
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit('<!DOCTYPE d SYSTEM "'), name, F.lit('"><d>'), "p_brand", F.lit("&inc;"), "p_size", F.lit("</d>")).alias("xml"))
    nodes = X.written(X.shred(docs, external=allowed))
    on = nodes.filter("kind = 'attribute' AND qname = 'loaded'").select("doc_id", F.lit(True).alias("loaded"))
    return nodes.filter("level = 1").select("doc_id", F.col("str_value").alias("text")).join(on, "doc_id", "left").na.fill({"loaded": False})


@query("SELECT n_nationkey AS doc_id, [CASE WHEN n_nationkey % 2 = 0 THEN 'doctype' END, 'start:a', 'attribute:x=' || n_regionkey, 'text:' || n_name, 'cdata-start:', 'text:c', 'cdata-end:', 'comment:k', 'pi:p=q', 'end:a'][(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END):] AS said FROM nation".replace("'doctype'", "'doctype:a'"))
def xml_events(spark, d):
    """Every event of a push parser, a row each, put together again in order."""
    n = table(spark, d, "nation")
    xml = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "<!DOCTYPE a>").otherwise(""), F.lit('<a x="'), "n_regionkey", F.lit('">'), "n_name", F.lit("<![CDATA[c]]><!--k--><?p q?></a>"))
    said = F.concat("event", F.lit(":"), F.concat_ws("=", "name", "value"))
    rows = X.events(n.select(F.col("n_nationkey").alias("doc_id"), xml.alias("xml"))).select("doc_id", "place", said.alias("s"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("said"))


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'é' || n_name END AS text, n_nationkey % 2 = 0 AS legal, 'a' || chr(10) || 'b' || chr(10) || 'c' AS lines FROM nation")
def xml_encodings(spark, d):
    """Bytes in four encodings, one that contradicts its mark and one unknown; characters that no document may have; line ends."""
    n = table(spark, d, "nation")
    text = lambda name: F.concat(F.lit(f'<?xml version="1.0" encoding="{name}"?><a>é'), "n_name", F.lit("</a>"))
    mark = lambda raw, data: F.concat(F.unhex(F.lit(raw)), data)
    plain = F.concat(F.lit("<a>é"), "n_name", F.lit("</a>"))
    made = [F.encode(plain, "UTF-8"), mark("FFFE", F.encode(text("UTF-16"), "UTF-16LE")), mark("FEFF", F.encode(plain, "UTF-16BE")), F.encode(text("ISO-8859-1"), "ISO-8859-1"), mark("EFBBBF", F.encode(text("ISO-8859-1"), "UTF-8")), F.encode(text("KLINGON"), "UTF-8")]
    data = F.element_at(F.array(*made), (F.col("n_nationkey") % 6 + 1).cast("int"))
    rows = n.select("n_nationkey", F.regexp_extract(strings.decode_document(data), ">([^<>]*)</a>", 1).alias("text"))
    extra = n.select("n_nationkey", strings.is_xml_text(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "\t").otherwise("￾"))).alias("legal"), strings.normalize_lines(F.lit("a\r\nb\x85c"), "1.1").alias("lines"))
    return rows.join(extra, "n_nationkey")


_DTD = "<!ELEMENT d (a|b)*> <!ELEMENT a EMPTY> <!ELEMENT b (#PCDATA)> <!ATTLIST d kind (x|y) 'x' code NMTOKEN #IMPLIED ver CDATA #FIXED '1'> <!ATTLIST a id ID #REQUIRED to IDREFS #IMPLIED>"


@query("SELECT p_partkey AS doc_id, CASE p_size % 7 WHEN 0 THEN 'wrong value: kind=z' WHEN 1 THEN 'wrong value: code=a b' WHEN 2 THEN 'wrong value: ver=2' WHEN 3 THEN 'undeclared attribute: xmlfoo' WHEN 4 THEN 'undeclared element: c' WHEN 5 THEN 'wrong value: id=1' END AS problem FROM part WHERE p_size % 7 <> 6")
def dtd_violations(spark, d):
    """All checks at once; each kind of document breaks one rule but for the seventh."""
    p = table(spark, d, "part")
    attr = F.element_at(F.array(*map(F.lit, (' kind="z"', ' code="a b"', ' ver="2"', ' xmlfoo="1"', "", "", ' kind="y" code="a-1" ver="1"'))), (F.col("p_size") % 7 + 1).cast("int"))
    inner = F.when(F.col("p_size") % 7 == 5, '<a id="1"/>').otherwise('<a id="i"/><a id="j" to="i j"/>')
    xml = F.concat(F.lit("<d"), attr, F.lit(">"), inner, F.lit("<b>t</b></d>"))
    other = F.when(F.col("p_size") % 7 == 4, F.concat(F.lit("<d>"), F.lit("<a id='k'><c/></a></d>"))).otherwise(xml)
    nodes = X.written(X.shred(p.select(F.col("p_partkey").alias("doc_id"), other.alias("xml")), texts=False))
    found = dtd.validate(nodes, _DTD).filter("problem <> 'wrong content'")
    return found.select("doc_id", F.concat_ws(": ", "problem", "detail").alias("problem"))


_AS_LINE = "'<line flag=\"' || flag || '\" no=\"' || no || '\" qty=\"' || qty || '\"/>'"


@query(f"SELECT doc_id, no::INT AS no, {_AS_LINE} AS xml FROM {_LINES} UNION ALL SELECT doc_id, 0, '<order>' || string_agg({_AS_LINE}, '' ORDER BY no) || '</order>' FROM {_LINES} GROUP BY 1 UNION ALL SELECT doc_id, -no::INT, 'flag=\"' || flag || '\"' FROM {_LINES}")
def xml_subtrees(spark, d):
    """Every line, every order and every flag attribute as text, in one pass over the nodes."""
    nodes = _line_nodes(spark, d)
    no = nodes.filter("kind = 'attribute' AND qname = 'no'").select("doc_id", F.col("parent_pre").alias("owner"), F.col("value").cast("int").alias("no"))
    lines = nodes.filter("qname = 'line'").select("doc_id", "pre", F.col("pre").alias("owner"), F.lit(1).alias("sign"))
    flags = nodes.filter("kind = 'attribute' AND qname = 'flag'").select("doc_id", "pre", F.col("parent_pre").alias("owner"), F.lit(-1).alias("sign"))
    orders = nodes.filter("qname = 'order'").select("doc_id", "pre", F.lit(0).alias("no"))
    named = lines.unionByName(flags).join(no, ["doc_id", "owner"]).select("doc_id", "pre", (F.col("no") * F.col("sign")).alias("no")).unionByName(orders)
    return X.subtrees(nodes, named, collapse=True).join(named, ["doc_id", "pre"]).select("doc_id", "no", "xml")


@query(f"SELECT doc_id, '<html><title>Order ' || doc_id || '</title><div><p>lines of <b>' || doc_id || '</b></p></div><ul>' || string_agg({_AS_LINE}, '' ORDER BY no) || '</ul><i>Order ' || doc_id || '</i></html>' AS html FROM {_LINES} GROUP BY 1")
def tpl_node_sets(spark, d):
    """Subtrees of the data and fragments of a template as values: a layout takes both and puts them in their places."""
    nodes = _line_nodes(spark, d)
    lines = X.subtrees(nodes, nodes.filter("qname = 'line'"), collapse=True)
    listed = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "xml"))), lambda x: x["xml"]).alias("lines"))
    ns = 'xmlns:t="http://treeloom.example/template"'
    layout = f'<html {ns} t:fragment="page(title, body, said)"><t:block t:replace="${{title}}"/><div t:insert="${{body}}"/><ul t:insert="${{lines}}"/><i t:insert="${{said}}"/></html>'
    page = f'<t:block {ns} t:with="n=${{doc_id}}"><t:block t:replace="~{{layout :: page(~{{::title}}, ~{{::p}}, ~{{::title/text()}})}}"/><t:block t:remove="all"><title>Order [[${{n}}]]</title><p>lines of <b t:text="${{n}}">0</b></p></t:block></t:block>'
    return listed.select("doc_id", Template(page, {"layout.html": layout}).render(listed).alias("html"))


@query("SELECT p_partkey AS doc_id, 'e' || i AS name, p_size % 5 = 0 AND i >= 2 AS cyclic, CASE WHEN p_size % 5 <> 0 OR i < 2 THEN length(p_brand) * CASE i WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 2 * power(p_size % 7, i - 1) END END::DOUBLE AS size FROM part, generate_series(0, 12) g(i) WHERE p_size % 35 <> 0")
def xml_entities(spark, d):
    """What the entities of each part's document type expand to, without expanding any: each names the one before it some times; every fifth type's go round in a circle."""
    p = table(spark, d, "part")
    times = (F.col("p_size") % 7).cast("int")
    one = lambda i, value: F.concat(F.lit(f'<!ENTITY e{i} "'), value, F.lit('">'))
    own = [one(0, F.col("p_brand")), one(1, F.lit("&e0;&e0;")), *[one(i, F.repeat(F.lit(f"&e{i - 1};"), times)) for i in range(3, 13)]]
    second = one(2, F.when(F.col("p_size") % 5 == 0, F.lit("&e1;&e12;")).otherwise(F.repeat(F.lit("&e1;"), times)))
    xml = F.concat(F.lit("<!DOCTYPE d ["), *own, second, F.lit("]><d/>"))
    return entities.expanded(entities.declared(p.filter("p_size % 35 <> 0").select(F.col("p_partkey").alias("doc_id"), xml.alias("xml"))))


@query("SELECT p_partkey AS doc_id, CASE p_size % 4 WHEN 0 THEN 'recursion' WHEN 1 THEN 'undeclared entity' WHEN 2 THEN 'undeclared notation' ELSE 'too long' END AS problem, CASE p_size % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'lost' WHEN 2 THEN 'pic' ELSE 'c' END AS name FROM part")
def xml_entity_problems(spark, d):
    """An entity that names itself, one that is not declared, a picture of an unknown notation, and one that expands too far."""
    p = table(spark, d, "part")
    ways = ['<!ENTITY a "x&a;">', '<!ENTITY a "x&lost;&lt;">', '<!NOTATION png SYSTEM "p"><!ENTITY pic SYSTEM "u" NDATA gif><!ENTITY ok SYSTEM "u" NDATA png>', f'<!ENTITY a "{"x" * 100}"><!ENTITY b "{"&a;" * 100}"><!ENTITY c "{"&b;" * 100}">']
    body = F.element_at(F.array(*map(F.lit, ways)), (F.col("p_size") % 4 + 1).cast("int"))
    return entities.problems(p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<!DOCTYPE d ["), body, F.lit("]><d/>")).alias("xml")), limit=100_000)


@query("SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity::INTEGER)::BIGINT AS qty, sum(l_linenumber)::BIGINT AS numbers, 0::BIGINT AS errors FROM lineitem GROUP BY 1")
def xml_records(spark, d):
    """All lines written to files as records and read again by byte ranges, typed; records with content and without."""
    line = table(spark, d, "lineitem")
    more = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("><linen>not a record</linen><no>"), "l_linenumber", F.lit("</no></rec>"))).otherwise(F.concat(F.lit(' no="'), "l_linenumber", F.lit('"/>')))
    text = F.concat(F.lit('<rec flag="'), "l_returnflag", F.lit('" note="a > b" qty="'), F.col("l_quantity").cast("int"), F.lit('"'), more, F.when(F.rand(1) < 0.5, "\n").otherwise(""))
    out = f"{X.shared_folder(spark)}/records-{X.fresh_name()}"
    line.select(text.alias("t")).write.option("lineSep", "<!-- between -->").text(out)
    rows = R.records(spark, out, "rec", "_flag string, _qty int, _no int, no int")
    v = F.col("value")
    return rows.groupBy(v["_flag"].alias("flag")).agg(F.count("*").alias("n"), F.sum(v["_qty"]).alias("qty"), F.sum(F.coalesce(v["_no"], v["no"])).alias("numbers"), F.count("error").alias("errors"))


@query(f"SELECT doc_id, count(*) AS lines, sum(qty)::BIGINT AS qty, first(flag ORDER BY no) AS flag, bool_and(no > 0) AS fine, 'none' AS note, doc_id AS id FROM {_LINES} GROUP BY 1")
def xml_structs(spark, d):
    """Each order as a struct with its lines in order, from the node table."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("no")).agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").cast("int").alias("qty"))
    line = X.element("line", {"no": F.col("no")}, X.element("flag", {}, F.col("flag")), X.element("qty", {}, F.col("qty").cast("string")), X.element("qty", {}, F.lit("0")))
    docs = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("x")))), lambda s: s["x"]), "").alias("x"))
    nodes = X.written(X.shred(docs.select("doc_id", X.element("order", {"id": F.col("doc_id")}, F.col("x")).alias("xml"))))
    found = structs.assemble(nodes, nodes.filter("level = 1 AND kind = 'element'"), "_id bigint, note string, line array<struct<_no: int, flag: string, qty: array<int>>>", defaults={"note": "none"})
    v = F.col("value")
    total = lambda x: F.aggregate(x["qty"], F.lit(0).cast("bigint"), lambda a, q: a + q)
    return found.select(
        "doc_id", F.size(v["line"]).cast("long").alias("lines"), F.aggregate(v["line"], F.lit(0).cast("bigint"), lambda a, x: a + total(x)).alias("qty"), F.get(v["line"], F.lit(0))["flag"].alias("flag"),
        F.forall(v["line"], lambda x: (x["_no"] > 0) & (F.size(x["qty"]) == 2)).alias("fine"), v["note"].alias("note"), v["_id"].alias("id"),
    )


@query("""SELECT p_partkey AS doc_id, '<d a="' || CASE WHEN p_size % 3 = 0 THEN 'own' ELSE '1' END || '" code="x ' || p_size || '" kind="' || CASE WHEN p_size % 2 = 0 THEN 'y' ELSE 'x' END || '" raw=" b  c "><e n="5"></e></d>' AS xml FROM part""")
def dtd_typed_attributes(spark, d):
    """Missing attributes with a default are added in their places; values of tokens lose their blanks, other ones keep them."""
    p = table(spark, d, "part")
    xml = F.concat(F.lit("<d"), F.when(F.col("p_size") % 3 == 0, ' a="own"').otherwise(""), F.lit(' code="  x   '), "p_size", F.lit(' "'), F.when(F.col("p_size") % 2 == 0, ' kind=" y "').otherwise(""), F.lit(' raw=" b  c "><e/></d>'))
    declared = X.dtd_declarations("<!ELEMENT d (e)> <!ELEMENT e EMPTY> <!ATTLIST d a CDATA '1' kind (x|y) 'x' code NMTOKENS #REQUIRED raw CDATA #IMPLIED> <!ATTLIST e n NMTOKEN '5'>")["attributes"]
    table_ = spark.createDataFrame([tuple(x[k] for k in ("element", "attribute", "type", "default", "required", "fixed")) for x in declared], "element string, attribute string, type string, default string, required boolean, fixed boolean")
    nodes = X.written(X.shred(p.select(F.col("p_partkey").alias("doc_id"), xml.alias("xml")), texts=False))
    return X.from_nodes(dtd.typed_attributes(nodes, table_))


@query("SELECT p_partkey AS doc_id, CASE p_size % 6 WHEN 0 THEN 'not well-formed' WHEN 1 THEN 'invalid' WHEN 2 THEN 'invalid' WHEN 3 THEN 'invalid' ELSE 'valid' END AS verdict, CASE p_size % 6 WHEN 1 THEN 'wrong content: b at 2' WHEN 2 THEN 'wrong value: pic=other' WHEN 3 THEN 'wrong content: too short' END AS problem FROM part")
def dtd_verdicts(spark, d):
    """Documents that are not well-formed, invalid or valid, with the first violation; pictures must name an unparsed entity."""
    p = table(spark, d, "part")
    ways = ["<d><a></d>", "<d><a/><b/><a/></d>", '<d pic="other"><a/></d>', "<d/>", "<d><a/></d>", '<d pic="one"><a/><a/></d>']
    xml = F.element_at(F.array(*map(F.lit, ways)), (F.col("p_size") % 6 + 1).cast("int"))
    rules = '<!NOTATION png SYSTEM "p"> <!ENTITY one SYSTEM "u" NDATA png> <!ELEMENT d (a+)> <!ELEMENT a EMPTY> <!ELEMENT b EMPTY> <!ATTLIST d pic ENTITY #IMPLIED>'
    found = dtd.judged(p.select(F.col("p_partkey").alias("doc_id"), xml.alias("xml")), rules)
    return found.select("doc_id", "verdict", F.when(F.col("verdict") == "invalid", F.col("problem")).alias("problem"))
