"""XML text to relational rows: node table, parse verdicts and DTD declarations."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterator
from html.entities import html5
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = (
    "pre long, post long, level int, parent_pre long, parent_post long, ord int, kind string, qname string, prefix string, local string, ns_uri string, "
    "value string, str_value string, lang string, is_id boolean, is_ns boolean"
)
#: Characters that entities may expand to before a document is rejected.
MAX_EXPANSION = 10_000_000
#: Nodes of one document that are held at once; a longer document is read twice, for its ranks and then for its rows.
HELD_NODES = 100_000
#: Characters given to the parser at once; rows and characters of values in a batch of the node table.
STEP, BATCH_ROWS, BATCH_CHARS = 1 << 18, 20_000, 1 << 25


class Rejected(ValueError):
    """The document is not well-formed, or exceeds a limit."""


class Exceeds(Rejected):
    """The document exceeds a limit on what its entities expand to."""


class _Long(Exception):
    """The document has more nodes than are held at once."""


XML_NS, XMLNS_NS = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"
_HTML5 = re.compile(r"\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<!DOCTYPE\s+html\s*>", re.I | re.S)
_REFERENCE = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|&([A-Za-z][A-Za-z0-9]*;)", re.S)
_OWN = frozenset(("lt;", "gt;", "amp;", "quot;", "apos;"))
#: Places of a node's values in its row; behind the columns stand the numbers of its parent and, for elements and the root, its own.
PRE, POST, PARENT_POST, STR_VALUE, PARENT, OWN_NUMBER = 0, 1, 4, 12, 16, 17


def named_characters(xml: str) -> str:
    """The text with the names that HTML gives characters replaced by these, where its document type is that of HTML 5."""
    if "&" not in xml or not _HTML5.match(xml):
        return xml
    return _REFERENCE.sub(lambda m: html5.get(m[1], m[0]) if m[1] and m[1] not in _OWN else m[0], xml)


_DECLARED_VERSION = re.compile(r"\ufeff?<\?xml\s+version\s*=\s*['\"]([^'\"]*)['\"]")
_VERSION = re.compile(r"\ufeff?<\?xml\s+version\s*=\s*(['\"])1\.1\1")


def _plain(xml: str) -> str:
    """The text with the line ends of its version; characters that no document has reject it. A document of version 1.1 is read by the rules of 1.0 but for its line ends."""
    if "\ufffe" in xml or "\uffff" in xml:
        raise Rejected("a character that no document has")
    if (m := _DECLARED_VERSION.match(xml)) and m[1] not in ("1.0", "1.1"):
        raise Rejected(f"unknown version {m[1]}")
    if m := _VERSION.match(xml):
        xml = xml[: m.end() - 4] + "1.0" + xml[m.end() - 1 :]
        xml = re.sub("\r[\n\x85]|[\x85\u2028]", "\n", xml)
    return xml


def _bindings(pairs: list[tuple[str, str]], ns: dict) -> dict:
    """The prefixes in scope of an element with these attributes."""
    out = ns
    for k, v in pairs:
        if k != "xmlns" and not k.startswith("xmlns:"):
            continue
        prefix = k[6:]
        if prefix == "xmlns" or (prefix == "xml") != (v == XML_NS) or v == XMLNS_NS:
            raise Rejected(f"reserved namespace or prefix in {k}")
        if prefix and not v:
            raise Rejected(f"prefix {prefix} cannot be unbound")
        out = dict(ns) if out is ns else out
        out[prefix] = v or None
    return out


def _read(xml: str, posts: array | None = None, fill: bool = False, held: int | None = None, external: dict[str, str] | None = None) -> Iterator[list]:
    """A document's nodes as they end, parents after children: rows of the columns of NODES and two numbers (see PARENT). `posts` has the elements'
    post ranks in document order: with `fill` they are collected and no nodes are given; else parents' post ranks come from there."""
    done: list[list] = []
    stack: list[list] = []  # of each open element: pre, number, level, children, language, prefixes, where its text begins, row
    clock = made = elements = expanded = 0
    in_cdata = False
    text: list[str] = []
    said = io.StringIO()
    ids: dict[str, set[str]] = {}
    xml = named_characters(_plain(xml))

    def add(kind: str, qname: str | None, value: str | None) -> None:
        nonlocal clock, made
        made += 1
        if held is not None and made > held:
            raise _Long
        parent = stack[-1]
        parent[3] += 1
        if not fill:
            done.append([clock + 1, clock + 2, len(stack), parent[0], posts[parent[1]] if posts is not None else None, parent[3], kind, qname, None, qname, None, value, value, parent[4], False, False, parent[1], None])
        clock += 2

    def flush() -> None:
        data = "".join(text)
        text.clear()
        if len(stack) > 1:
            add("cdata" if in_cdata else "text", None, data)
            if not fill:
                said.write(data)

    def start(name: str, attrs: list[str]) -> None:
        nonlocal clock, made, elements
        if text:
            flush()
        parent = stack[-1]
        parent[3] += 1
        pairs = list(zip(attrs[::2], attrs[1::2], strict=True))
        made += 1 + len(pairs)
        if held is not None and made > held:
            raise _Long
        ns = _bindings(pairs, parent[5]) if pairs else parent[5]
        lang = parent[4]
        for k, v in pairs:
            if k == "xml:lang":
                lang = v
        prefix, _, local = name.rpartition(":")
        if prefix and prefix not in ns:
            raise Rejected(f"undefined prefix {prefix}")
        clock += 1
        pre, number, level = clock, elements, len(stack)
        elements += 1
        if fill:
            posts.append(0)
            row = None
        else:
            row = [pre, None, level, parent[0], posts[parent[1]] if posts is not None else None, parent[3], "element", name, prefix or None, local, ns.get(prefix), None, None, lang, False, False, parent[1], number]
        stack.append([pre, number, level, 0, lang, ns, said.tell() if row is not None else 0, row])
        if not pairs:
            return
        own, seen = ids.get(name, ()), set()
        for i, (k, v) in enumerate(sorted(pairs)):
            prefix, _, local = k.rpartition(":")
            is_ns = k == "xmlns" or prefix == "xmlns"
            uri = None
            if prefix and not is_ns:
                if prefix not in ns:
                    raise Rejected(f"undefined prefix {prefix}")
                uri = ns[prefix]
                if (uri, local) in seen:
                    raise Rejected(f"repeated attribute {k}")
                seen.add((uri, local))
            if row is not None:
                done.append([clock + 1, clock + 2, level + 1, pre, posts[number] if posts is not None else None, i + 1, "attribute", k, prefix or None, local, uri, v, v, lang, k in own or k == "xml:id", is_ns, number, None])
            clock += 2

    def end(name: str) -> None:
        if text:
            flush()
        leave()

    def leave() -> None:
        nonlocal clock
        clock += 1
        frame = stack.pop()
        row = frame[7]
        if row is None:
            posts[frame[1]] = clock
            return
        row[POST] = clock
        said.seek(frame[6])
        row[STR_VALUE] = said.read()
        done.append(row)

    def chars(data: str) -> None:
        nonlocal expanded
        expanded += len(data)
        if expanded > MAX_EXPANSION + 4 * len(xml):
            raise Exceeds("entities expand too far")
        text.append(data)

    def leaf(kind: str):
        def run(*args) -> None:
            if text:
                flush()
            add(kind, args[0] if kind == "pi" else None, args[-1])

        return run

    def cdata(on: bool):
        def run() -> None:
            nonlocal in_cdata
            if text:
                flush()
            in_cdata = on

        return run

    def attlist(element, name, kind, default, required) -> None:
        if kind == "ID":
            ids.setdefault(element, set()).add(name)

    def load(context, base, system, public) -> int:
        if system not in external:
            raise Rejected(f"external entity {system} is not allowed")
        p.ExternalEntityParserCreate(context).Parse(external[system], True)
        return 1

    clock, elements = 1, 1
    made = 1
    if fill:
        posts.append(0)
    root = None if fill else [1, None, 0, None, None, 0, "root", None, None, None, None, None, None, None, False, False, None, 0]
    stack.append([1, 0, 0, 0, None, {"xml": XML_NS}, 0, root])
    p = expat.ParserCreate()
    p.ordered_attributes = True
    p.buffer_text = False
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, chars
    p.CommentHandler, p.ProcessingInstructionHandler = leaf("comment"), leaf("pi")
    p.StartCdataSectionHandler, p.EndCdataSectionHandler = cdata(True), cdata(False)
    p.AttlistDeclHandler = attlist
    p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_UNLESS_STANDALONE if external else expat.XML_PARAM_ENTITY_PARSING_NEVER)
    if external:
        p.ExternalEntityRefHandler = load
    for at in range(0, max(len(xml), 1), STEP):
        try:
            p.Parse(xml[at : at + STEP], at + STEP >= len(xml))
        except expat.ExpatError as e:
            raise (Exceeds if e.code == _AMPLIFIED else Rejected)(str(e)) from None
        yield from done
        done.clear()
    leave()
    yield from done


_AMPLIFIED = expat.errors.codes[expat.errors.XML_ERROR_AMPLIFICATION_LIMIT_BREACH]


def check(xml: str, external: dict[str, str] | None = None) -> None:
    """Raises Rejected where shred_rows would, without making nodes."""
    for _ in _read(xml, array("q"), True, external=external):
        pass


def shred_rows(xml: str, external: dict[str, str] | None = None) -> Iterator[list]:
    """All nodes of a document as rows, with pre and post ranks, in no set order. External entities are loaded only from `external`, by system
    name. A document that is not well-formed is rejected before its first node; of a long one, only open elements, their text and 8 bytes
    an element are held."""
    try:
        rows = list(_read(xml, held=HELD_NODES, external=external))
    except _Long:
        posts = array("q")
        for _ in _read(xml, posts, True, external=external):
            pass
        yield from _read(xml, posts, external=external)
        return
    post = {r[OWN_NUMBER]: r[POST] for r in rows if r[OWN_NUMBER] is not None}
    for r in rows:
        r[PARENT_POST] = post.get(r[PARENT])
    yield from rows


def shred_nodes(xml: str, external: dict[str, str] | None = None) -> Iterator[dict]:
    return (dict(zip(_COLUMNS, r[: len(_COLUMNS)], strict=True)) for r in shred_rows(xml, external))


def shred_text(xml: str, external: dict[str, str] | None = None) -> list[dict]:
    """All nodes of a document in document order."""
    return sorted(shred_nodes(xml, external), key=lambda n: n["pre"])


_COLUMNS = [c.split()[0] for c in NODES.split(", ")]


def shred(docs: DataFrame, key: str = "doc_id", xml: str = "xml", texts: bool = True, external: dict[str, str] | None = None) -> DataFrame:
    """The node table: key and a row for each node, attributes included, of every well-formed document, however many nodes it has. Others give no row
    (see verdicts); a document whose entities expand beyond the limit may be well-formed and fails the query.

    str_value repeats a text for each element around it. With texts=False it is null for elements and the root, for expressions that
    ask for no element's text; string_values adds it later. External entities and document types are read from `external`, a small
    map of system names to texts, and from nowhere else; a document that needs another one is rejected. In documents of
    HTML 5's type, the names that HTML gives characters are known."""

    kind = dict(docs.dtypes)[key]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 8, pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(keys: list, rows: list[list], like: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))[: len(types)]
            return pa.RecordBatch.from_arrays([pa.array(keys, like), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *_COLUMNS])

        for b in batches:
            keys: list = []
            rows: list[list] = []
            chars = 0
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                try:
                    for row in shred_rows(text, external):
                        if not texts and row[OWN_NUMBER] is not None:
                            row[STR_VALUE] = None
                        elif row[STR_VALUE]:
                            chars += len(row[STR_VALUE])
                        keys.append(k)
                        rows.append(row)
                        if len(rows) > BATCH_ROWS or chars > BATCH_CHARS:
                            yield batch(keys, rows, b.schema.field(0).type)
                            keys, rows, chars = [], [], 0
                except Exceeds:
                    raise
                except Rejected:
                    continue
            if rows:
                yield batch(keys, rows, b.schema.field(0).type)

    return spread(docs.select(key, xml).mapInArrow(run, f"`{key}` {kind}, {NODES}"))


def spread(rows: DataFrame) -> DataFrame:
    """The rows, joined by sorting and merging. Files hold a node in 2 to 4 bytes, and a step reads a few of its columns, so the planner takes millions of
    nodes for small and would send them whole through the driver to every executor. The hint holds through filters, projections, windows and
    aggregates; behind a semi or anti join, whose size is taken to be its left side's, and a union it is given again."""
    return rows.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a temporary folder on a local master; elsewhere an error, as executors do not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_name() -> str:
    return uuid.uuid4().hex


def written(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table written to the folder that driver and executors share (spark.checkpoint.dir) and read back, so that documents are
    parsed once however many steps read it, each only the columns that it needs; lost executors cost no second parse."""
    spark = nodes.sparkSession
    path = f"{shared_folder(spark)}/nodes-{fresh_name()}"
    nodes.write.parquet(path)
    return spread(spark.read.schema(nodes.schema).parquet(path))


def string_values(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """nodes with every element's and root's str_value worked out from the text below it, by segments of ranks (see operators.intervals.texts)."""
    from ..operators.intervals import texts

    branch = F.col("kind").isin("element", "root")
    said = nodes.filter("kind IN ('text', 'cdata')").select(key, F.col("pre").alias("at"), "value")
    whole = texts(said, nodes.filter(branch).select(key, F.col("pre").alias("begin"), F.col("post").alias("end")), key)
    out = nodes.join(whole.select(key, F.col("begin").alias("pre"), F.col("text").alias("_said")), [key, "pre"], "left")
    return out.withColumn("str_value", F.when(branch, F.coalesce("_said", F.lit(""))).otherwise(F.col("value"))).select(*nodes.columns)


def verdicts(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """key, wf_error (null where well-formed), version, standalone, has_doctype, is_html5. One document never fails the others."""

    @F.pandas_udf("string")
    def error(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return "no document"
            try:
                check(t)
            except Rejected as e:
                return str(e)
            return None

        return texts.map(one)

    x = F.col(xml)
    declared = r"^\s*<\?xml\s+version\s*=\s*[\"']([0-9.]+)[\"'](?:\s+encoding\s*=\s*[\"'][^\"']*[\"'])?(?:\s+standalone\s*=\s*[\"'](yes|no)[\"'])?"
    return docs.select(
        key,
        error(x).alias("wf_error"),
        F.coalesce(F.nullif(F.regexp_extract(x, declared, 1), F.lit("")), F.lit("1.0")).alias("version"),
        F.nullif(F.regexp_extract(x, declared, 2), F.lit("")).alias("standalone"),
        F.contains(x, F.lit("<!DOCTYPE")).alias("has_doctype"),
        F.regexp_like(x, F.lit(r"(?i)^\s*(?:<\?xml[^>]*>\s*)?<!DOCTYPE\s+html\s*>")).alias("is_html5"),
    )


EVENTS = "array<struct<event: string, name: string, value: string>>"


def events(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """key, place, event, name, value: a row for each event of a push parser, in order; documents that are not well-formed give none."""

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("event", pa.string()), ("name", pa.string()), ("value", pa.string())]))

        def one(text: str | None) -> list:
            try:
                return [{"event": e, "name": n, "value": v} for e, n, v in sax_events(text or "")]
            except Rejected:
                return []

        return pa.array([one(x.as_py()) for x in texts], kind)

    rows = docs.select(key, F.posexplode(F.arrow_udf(run, EVENTS)(F.col(xml))).alias("place", "e"))
    return rows.select(key, "place", "e.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path) and xml of every file, each whole, decoded by its byte order mark or its declaration; null where the two contradict."""
    from ..functions.strings import decode_document

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), decode_document(F.col("content")).alias("xml"))


def sax_events(xml: str) -> list[tuple[str, str | None, str | None]]:
    """(event, name, value) in the order in which a push parser reports them."""
    out: list[tuple[str, str | None, str | None]] = []
    p = expat.ParserCreate()
    p.StartElementHandler = lambda n, a: out.extend([("start", n, None), *(("attribute", k, v) for k, v in sorted(a.items()))])
    p.EndElementHandler = lambda n: out.append(("end", n, None))
    p.CharacterDataHandler = lambda d: out.append(("text", None, d))
    p.CommentHandler = lambda d: out.append(("comment", None, d))
    p.ProcessingInstructionHandler = lambda t, d: out.append(("pi", t, d))
    p.StartCdataSectionHandler = lambda: out.append(("cdata-start", None, None))
    p.EndCdataSectionHandler = lambda: out.append(("cdata-end", None, None))
    p.StartDoctypeDeclHandler = lambda n, s, i, h: out.append(("doctype", n, s))
    p.NotationDeclHandler = lambda n, b, s, i: out.append(("notation", n, s or i))
    p.buffer_text = True
    try:
        p.Parse(xml, True)
    except expat.ExpatError as e:
        raise Rejected(str(e)) from None
    return out


_DECLARED = re.compile(r"<!(ELEMENT|ATTLIST|ENTITY|NOTATION)\s+([^>]*)>", re.S)


def dtd_declarations(dtd: str) -> dict[str, list[dict]]:
    """Element models and attribute declarations of an internal subset, read on the driver: a DTD is shared by many documents."""
    out: dict[str, list[dict]] = {"elements": [], "attributes": [], "notations": [], "unparsed": []}
    p = expat.ParserCreate()
    p.EntityDeclHandler = lambda name, parameter, value, base, system, public, notation: notation and out["unparsed"].append({"entity": name, "system": system, "notation": notation})

    p.ElementDeclHandler = lambda name, m: out["elements"].append({"element": name, "content": m, "any": m[0] == expat.model.XML_CTYPE_ANY, "mixed": m[0] == expat.model.XML_CTYPE_MIXED})
    p.AttlistDeclHandler = lambda e, a, kind, default, required: out["attributes"].append({"element": e, "attribute": a, "type": kind, "default": default, "required": bool(required) and default is None, "fixed": bool(required) and default is not None})
    p.NotationDeclHandler = lambda n, b, s, i: out["notations"].append({"notation": n, "system": s, "public": i})
    root = (re.search(r"<!ELEMENT\s+(\S+)", dtd) or [None, "root"])[1]
    p.Parse(f"<!DOCTYPE {root} [{dtd}]><{root}/>", True)
    return out


def element(name: str, attributes: dict[str, Column], *content: Column) -> Column:
    """An element's XML text from columns: attributes whose value is null are left out, and so is null content."""
    from ..functions.strings import escape_xml

    parts = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), escape_xml(v.cast("string"), True), F.lit('"'))).otherwise(F.lit("")) for k, v in attributes.items()]
    inner = [F.coalesce(c, F.lit("")) for c in content]
    if not inner:
        return F.concat(F.lit(f"<{name}"), *parts, F.lit("/>"))
    return F.concat(F.lit(f"<{name}"), *parts, F.lit(">"), *inner, F.lit(f"</{name}>"))


#: Fixed values of HTML: elements that have no end tag.
VOID = "area base br col embed hr img input link meta param source track wbr".split()


def _tokens(nodes: DataFrame, key: str, collapse: bool, indent: int, html: bool, comments: bool, cdata: bool, wrap: bool = False) -> DataFrame:
    """key, at, t: the text that each node but attributes and roots gives at its ranks."""
    from ..functions.strings import escape_xml

    shown = nodes.filter("kind NOT IN ('attribute', 'root')" + ("" if comments else " AND kind <> 'comment'"))
    blank = (F.col("kind") == "text") & (F.trim(F.translate("value", "\n\r\t", "   ")) == "")
    said = F.col("kind").isin("text", "cdata") & ~blank
    if indent:
        mixed = shown.filter(said).select(key, "parent_pre").distinct().withColumn("_mixed", F.lit(True))
        shown = spread(shown.join(mixed, [key, "parent_pre"], "left").filter(~blank | F.col("_mixed")))
    inside = shown.groupBy(key, F.col("parent_pre").alias("pre")).agg(F.count("*").alias("_n"), F.bool_or(said).alias("_says"))
    attrs = nodes.filter("kind = 'attribute'").groupBy(key, F.col("parent_pre").alias("pre")).agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit(" "), "qname", F.lit('="'), escape_xml(F.col("value"), True), F.lit('"')).alias("t")))).alias("_a"))
    body = shown.join(attrs, [key, "pre"], "left").join(spread(inside), [key, "pre"], "left")
    line_end = F.concat(F.lit("\n"), F.repeat(F.lit(" "), (indent * (F.col("level") - 1)).cast("int") + F.length("qname") + 1)) if wrap else F.lit("")
    has = F.coalesce(F.array_join(F.transform("_a", lambda x, i: F.concat(F.when(i > 0, line_end).otherwise(""), x["t"]) if wrap else x["t"]), ""), F.lit(""))
    element, empty = F.col("kind") == "element", F.col("_n").isNull()
    void = F.lower("local").isin(VOID) if html else F.lit(False)
    one = empty & ~void if collapse and not html else F.lit(False)
    first = (
        F.when(element, F.concat(F.lit("<"), "qname", has, F.when(one, "/>").otherwise(">")))
        .when((F.col("kind") == "cdata") & F.lit(cdata), F.concat(F.lit("<![CDATA["), "value", F.lit("]]>")))
        .when(F.col("kind").isin("text", "cdata"), escape_xml(F.col("value")))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), "value", F.lit("-->")))
        .otherwise(F.concat(F.lit("<?"), "qname", F.lit(" "), "value", F.lit("?>")))
    )
    last = F.when(element & ~one & ~void, F.concat(F.lit("</"), "qname", F.lit(">")))
    if indent:
        line = F.concat(F.lit("\n"), F.repeat(F.lit(" "), (indent * (F.col("level") - 1)).cast("int")))
        first = F.when(F.col("_mixed") | (F.col("level") == 1), first).otherwise(F.concat(line, first))
        last = F.when(empty | F.col("_says"), last).otherwise(F.concat(line, last))
    both = body.select(key, F.explode(F.array(F.struct(F.col("pre").alias("at"), first.alias("t")), F.struct(F.col("post").alias("at"), last.alias("t")))).alias("e")).filter("e.t IS NOT NULL")
    return both.select(key, "e.*")


def from_nodes(
    nodes: DataFrame, key: str = "doc_id", collapse: bool = False, indent: int = 0, html: bool = False, comments: bool = True, cdata: bool = True, wrap: bool = False, prolog: bool = False, doctype: str | None = None
) -> DataFrame:
    """key, xml: each document written again from its node rows, one aggregation for all: every node gives its opening and closing text at its ranks.

    collapse: an empty element is one tag. indent: blanks for each level, on lines of their own, where an element has no text of its own. html: void elements have
    no end tag, all others do. comments: whether they are written. cdata: whether CDATA sections stay such. wrap: an element's second and further attributes stand
    on lines of their own, below the first. prolog: whether an XML declaration comes first. doctype: a document type's declaration, written
    after it.
    """
    said = _tokens(nodes, key, collapse, indent, html, comments, cdata, wrap)
    first = ('<?xml version="1.0" encoding="UTF-8"?>\n' if prolog else "") + (f"{doctype}\n" if doctype else "")
    if first:
        said = said.unionByName(nodes.filter("kind = 'root'").select(key, F.lit(-1).cast("long").alias("at"), F.lit(first).alias("t")))
    return spread(said.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "").alias("xml")))


def subtrees(nodes: DataFrame, targets: DataFrame, key: str = "doc_id", collapse: bool = False, indent: int = 0, html: bool = False, comments: bool = True, cdata: bool = True) -> DataFrame:
    """key, pre, xml: each target node (key, pre) written with all below it, options as in from_nodes; an attribute as name="value", a root as its document.

    All targets are written in one pass, nested ones too: what the nodes of a segment of ranks say is put together once, and a
    target takes the segments that it is made of. Namespaces that are declared around a target are not repeated on it.
    """
    from ..functions.strings import escape_xml
    from ..operators.intervals import texts

    wanted = spread(nodes.join(targets.select(key, "pre").distinct(), [key, "pre"], "left_semi"))
    own = wanted.filter("kind = 'attribute'").select(key, "pre", F.concat("qname", F.lit('="'), escape_xml(F.col("value"), True), F.lit('"')).alias("xml"))
    spans = wanted.filter("kind <> 'attribute'").select(key, F.col("pre").alias("begin"), F.col("post").alias("end"))
    said = _tokens(nodes, key, collapse, indent, html, comments, cdata).withColumnRenamed("t", "value")
    written_ = texts(said, spans, key)
    rest = spans.join(written_, [key, "begin"], "left").select(key, F.col("begin").alias("pre"), F.coalesce("text", F.lit("")).alias("xml"))
    return spread(rest.unionByName(own))
