"""Attribute-driven templates compiled to one text Column over a row's columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import escape_xml
from .el import Compiler, ElError, NodeSet, Value, text, truth

NS, V1 = "http://treeloom.example/template", "http://treeloom.example/template-v1"
#: Attributes that are present or absent, without a value of their own.
BOOLEAN = frozenset(
    "async autofocus autoplay checked controls declare default defer disabled formnovalidate hidden ismap loop multiple novalidate nowrap open pubdate readonly required reversed scoped seamless selected".split()
)
#: The order in which a node's attributes are processed.
PRECEDENCE = ("insert", "replace", "include", "each", "if", "unless", "switch", "case", "object", "with", "attr", "text", "utext", "inline", "assert", "remove")
#: More attribute handlers: name -> (template, element, value, compiler) -> Column of the element's text.
HANDLERS: dict[str, Callable] = {}
_INLINE = re.compile(r"\[\[(.*?)\]\]|\[\((.*?)\)\]", re.S)
#: In scripts and styles a value may also stand in a comment; what follows it up to the end of the line or statement is only shown without a processor.
_SCRIPT = re.compile(r"""/\*\[\[(.*?)\]\]\*/(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^;\n"'])*|\[\[(.*?)\]\]""", re.S)
_STEP = re.compile(r"(//?)?([\w:-]*)((?:\[[^\]]*\]|[.#][\w-]+)*)")
_TEST = re.compile(r"\[\s*(?:(?P<at>[0-9]+)|@(?P<has>[\w:-]+)(?:\s*=\s*(?P<q>['\"])(?P<value>.*?)(?P=q))?)\s*\]|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)")


def select(root: ET.Element, selector: str) -> list[ET.Element]:
    """The elements that a fragment selector finds, in order.

    Steps name, /name and //name; a name without a slash also finds fragments by the start of their names, in any place; tests
    .class, #id, [@a], [@a='v'] and [n], the place among what its parent holds of this kind.
    """
    document = ET.Element("")
    document.append(root)
    found, at = [document], 0
    while at < len(selector):
        m = _STEP.match(selector, at)
        if m.end() == at or not (m[2] or m[3]):
            raise ElError(f"not a selector: {selector!r}")
        at = m.end()
        parents = {id(x): x for top in found for x in (top.iter() if m[1] != "/" else (top,))}
        found = [x for parent in parents.values() for x in _tested([y for y in parent if _named(y, m[2], m[1] is None)], m[3])]
        order = {id(x): i for i, x in enumerate(root.iter())}
        found.sort(key=lambda x: order[id(x)])
    return found


def _named(e: ET.Element, name: str, fragments: bool) -> bool:
    called = fragments and any(e.attrib.get(f"{{{NS}}}{k}", "").startswith(name) and f"{{{NS}}}{k}" in e.attrib for k in ("fragment", "ref"))
    return not name or called or name in (e.tag, e.tag.rpartition("}")[2])


def _tested(listed: list[ET.Element], tests: str) -> list[ET.Element]:
    at = 0
    while at < len(tests):
        m = _TEST.match(tests, at)
        if not m:
            raise ElError(f"not a test of a selector: {tests[at:]!r}")
        at = m.end()
        if m["at"]:
            listed = listed[int(m["at"]) - 1 : int(m["at"])] if int(m["at"]) else []
        else:
            name = m["has"] or ("class" if m["cls"] else "id")
            value = m["value"] if m["has"] else m["cls"] or m["id"]
            listed = [x for x in listed if name in x.attrib and value in (None, x.attrib[name])]
    return listed


def _literal(v: Value) -> Column:
    """A value as a script writes it."""
    listed = F.to_json(F.array(v[0]))
    return listed.substr(F.lit(2), F.length(listed) - 2)


class Nodes:
    """Nodes of a template and the names that were known where they were named."""

    def __init__(self, template: Template, nodes: list[ET.Element | str], given: str | None, c: Compiler) -> None:
        self.template, self.nodes, self.given, self.c = template, nodes, given, c

    def render(self, whole: bool) -> Column:
        return F.concat(F.lit(""), *[self.template._found(x, self.given, self.c, whole) for x in self.nodes])


class Template:
    """A template's text, compiled against a DataFrame's columns. Fragments are looked up by name among `files`."""

    def __init__(self, source: str, files: dict[str, str] | None = None, csrf: str | None = None, inline_errors: bool = False) -> None:
        """With csrf, the name of a column, every form that has no such input gets a hidden one with its value. With inline_errors, an expression
        that cannot be parsed or typed is told in the place of its element; else it raises."""
        self.root, self.files, self.v1, self.inline_errors = ET.fromstring(source), files or {}, V1 in source, inline_errors
        for form in self.root.iter() if csrf else ():
            if form.tag.rpartition("}")[2] == "form" and not any(x.attrib.get("name") == "_csrf" for x in form):
                form.insert(0, ET.Element(form.tag[: -len("form")] + "input", {"type": "hidden", "name": "_csrf", f"{{{NS}}}value": f"${{{csrf}}}"}))
                form[0].tail, form.text = form.text, None

    def render(self, df: DataFrame, **more: Value) -> Column:
        c = Compiler.over(df, **more)
        return self._node(self.root, Compiler(c.scope | {"~": (self, None)}, c.selected))

    def nodes(self, spec: str, c: Compiler) -> Nodes:
        """What ~{...} names, as a value: it may be given to another fragment and is put out there, with the names that are known here."""
        found, given = self._named(spec)
        return Nodes(self, found, given, c)

    def _children(self, e: ET.Element, c: Compiler, raw: str | None = None) -> list[Column]:
        parts = [self._text(e.text, c, raw)]
        for child in e:
            parts += [self._node(child, c), self._text(child.tail, c, raw)]
        return parts

    def _text(self, said: str | None, c: Compiler, raw: str | None = None) -> Column:
        if not said:
            return F.lit("")
        if self.v1:
            return self._v1_text(said, c)
        if raw == "none":
            return escape_xml(F.lit(said))
        parts, at, script = [], 0, raw in ("javascript", "css")
        shown = F.lit if script else lambda x: escape_xml(F.lit(x))
        for m in (_SCRIPT if script else _INLINE).finditer(said):
            parts.append(shown(said[at : m.start()]))
            value = c.evaluate((m[1] or m[2]).strip())
            parts.append(_literal(value) if script else escape_xml(text(value)) if m[1] is not None else text(value))
            at = m.end()
        parts.append(shown(said[at:]))
        return F.concat(*parts)

    def _node(self, e: ET.Element, c: Compiler) -> Column:
        if not self.inline_errors:
            return self._whole(e, c)
        try:
            return self._whole(e, c)
        except ElError as error:
            return escape_xml(F.lit(f"Error in {e.tag.rpartition('}')[2]}: {error}"))

    def _whole(self, e: ET.Element, c: Compiler) -> Column:
        if e.tag.startswith(f"{{{V1}}}"):
            return self._v1(e, c)
        own = {k[len(NS) + 2 :]: v for k, v in e.attrib.items() if k.startswith(f"{{{NS}}}")}
        plain = {k: v for k, v in e.attrib.items() if not k.startswith(f"{{{NS}}}")}
        return self._process(e, own, plain, c, 0)

    def _process(self, e, own: dict[str, str], plain: dict[str, str], c: Compiler, at: int) -> Column:
        for k, name in enumerate(PRECEDENCE[:10]):
            if k < at or name not in own:
                continue
            rest = lambda inner, k=k: self._process(e, own, plain, inner, k + 1)
            value = own[name]
            if name in ("insert", "replace", "include"):
                body = self._fragment(value, c, whole=name != "include")
                return body if name == "replace" else self._wrap(e, own, plain, c, [body])
            if name == "each":
                return self._each(value, c, rest)
            if name in ("if", "unless"):
                yes = truth(c.evaluate(value))
                return F.when(yes if name == "if" else ~yes, rest(c)).otherwise(F.lit(""))
            if name == "switch":
                return self._switch(e, own, plain, c.evaluate(value), c)
            if name == "object":
                return rest(Compiler(c.scope, c.evaluate(value)))
            if name == "with":
                return rest(c.bind(value))
        for name, handler in HANDLERS.items():
            if name in own:
                return handler(self, e, own[name], c)
        return self._wrap(e, own, plain, c, None)

    def _wrap(self, e, own: dict[str, str], plain: dict[str, str], c: Compiler, body: list[Column] | None) -> Column:
        if "assert" in own:
            ok = c.holds(own["assert"])
        if body is None:
            if "text" in own:
                body = [escape_xml(text(c.evaluate(own["text"])))]
            elif "utext" in own:
                body = [text(c.evaluate(own["utext"]))]
            else:
                removed = own.get("remove")
                if removed == "all":
                    return F.lit("")
                if removed == "all-but-first":
                    body = [self._text(e.text, c), *([self._node(e[0], c)] if len(e) else [])]
                else:
                    body = [] if removed == "body" else self._children(e, c, own.get("inline"))
        attrs: dict[str, Column | None] = {k: F.concat(F.lit(f' {k}="'), escape_xml(c.substitute(v) if self.v1 else F.lit(v), True), F.lit('"')) for k, v in plain.items()}
        listed = dict(c.attributes(own["attr"])) if "attr" in own else {}
        done = (*PRECEDENCE, "classappend", "styleappend", *HANDLERS)
        listed |= {k: c.evaluate(v) for k, v in own.items() if k not in done}
        for k, v in listed.items():
            shown = F.lit(f' {k}="{k}"') if k in BOOLEAN else F.concat(F.lit(f' {k}="'), escape_xml(text(v), True), F.lit('"'))
            attrs[k] = F.when(truth(v), shown).otherwise(F.lit("")) if k in BOOLEAN else shown
        for k, sep in (("class", " "), ("style", "; ")):
            if f"{k}append" in own:
                more = text(c.evaluate(own[f"{k}append"]))
                before = plain.get(k, "").rstrip("; ") if k == "style" else plain.get(k, "")
                whole = F.when(more == "", F.lit(before)).otherwise(F.concat(F.lit(before + sep if before else ""), more))
                attrs[k] = F.when(whole == "", F.lit("")).otherwise(F.concat(F.lit(f' {k}="'), escape_xml(whole, True), F.lit('"')))
        if e.tag == f"{{{NS}}}block" or own.get("remove") == "tag":
            out = F.concat(F.lit(""), *body)
        elif not body or len(body) == 1 and e.text is None and not len(e) and "text" not in own and "utext" not in own and not any(k in own for k in ("insert", "include")):
            out = F.concat(F.lit(f"<{e.tag}"), *attrs.values(), F.lit("/>"))
        else:
            out = F.concat(F.lit(f"<{e.tag}"), *attrs.values(), F.lit(">"), *body, F.lit(f"</{e.tag}>"))
        return F.when(ok, out).otherwise(escape_xml(F.lit(f"Error: assertion failed: {own['assert']}"))) if "assert" in own else out

    def _each(self, value: str, c: Compiler, rest) -> Column:
        m = re.fullmatch(r"\s*(\w+)\s*(?:,\s*(\w+)\s*)?:\s*(.*)", value, re.S)
        if not m:
            raise ElError(f"not a loop: {value!r}")
        listed, kind = c.evaluate(m[3])
        if not isinstance(kind, T.ArrayType):
            raise ElError("a loop needs an array")
        size = F.size(listed)
        status = T.StructType([T.StructField(n, T.LongType()) for n in ("index", "count", "size")] + [T.StructField("current", kind.elementType)] + [T.StructField(n, T.BooleanType()) for n in ("even", "odd", "first", "last")])

        def one(x: Column, i: Column) -> Column:
            state = F.struct(
                i.cast("bigint").alias("index"), (i + 1).cast("bigint").alias("count"), size.cast("bigint").alias("size"), x.alias("current"),
                ((i + 1) % 2 == 0).alias("even"), ((i + 1) % 2 == 1).alias("odd"), (i == 0).alias("first"), (i == size - 1).alias("last"),
            )
            return rest(Compiler(c.scope | {m[1]: (x, kind.elementType), m[2] or f"{m[1]}Stat": (state, status)}, c.selected))

        return F.coalesce(F.array_join(F.transform(listed, one), ""), F.lit(""))

    def _switch(self, e, own, plain, value: Value, c: Compiler) -> Column:
        chosen, fallback = None, F.lit("")
        for child in e.iter():
            case = child.attrib.get(f"{{{NS}}}case")
            if child is e or case is None:
                continue
            body = self._process(child, {k[len(NS) + 2 :]: v for k, v in child.attrib.items() if k.startswith(f"{{{NS}}}") and not k.endswith("}case")}, {k: v for k, v in child.attrib.items() if not k.startswith(f"{{{NS}}}")}, c, 0)
            if case == "*":
                fallback = body
                break
            same = text(c.evaluate(case)) == text(value)
            chosen = F.when(same, body) if chosen is None else chosen.when(same, body)
        body = fallback if chosen is None else chosen.otherwise(fallback)
        return self._wrap(e, {k: v for k, v in own.items() if k != "switch"}, plain, c, [body])

    def _fragment(self, spec: str, c: Compiler, whole: bool) -> Column:
        """All that ~{file :: selector(arguments)} finds, or the whole file; without a file (or with 'this') in this template; ~{} is empty.

        A selector may end in /text(). Instead, an expression may give nodes that were named before, or XML texts of the data (one or an
        array), which are put out as they are.
        """
        if spec.strip().startswith("~{"):
            return self.nodes(spec, c).render(whole)
        value, kind = c.evaluate(spec)
        if isinstance(kind, NodeSet):
            return value.render(whole)
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.array_join(value, ""), F.lit(""))
        return text((value, kind))

    def _named(self, spec: str) -> tuple[list[ET.Element | str], str | None]:
        m = re.fullmatch(r"\s*~\{\s*([\w./-]*)\s*(?:::\s*([^()]*?(?:/text\(\))?)\s*(?:\((.*)\))?)?\s*\}\s*", spec, re.S)
        if not m:
            raise ElError(f"not a fragment: {spec!r}")
        if not m[1] and not m[2]:
            return [], None
        name = next((n for n in (m[1] + s for s in ("", ".xhtml", ".html", ".xml")) if n in self.files), None)
        root = ET.fromstring(self.files[name]) if name else self.root
        if not m[2]:
            return [root], m[3]
        found = select(root, m[2].removesuffix("/text()"))
        if not found:
            raise ElError(f"no fragment {m[2]!r}")
        if m[2].endswith("/text()"):
            return [said for x in found for said in (x.text, *(y.tail for y in x)) if said], None
        return found, m[3]

    def _found(self, found: ET.Element | str, given: str | None, c: Compiler, whole: bool) -> Column:
        if isinstance(found, str):
            return self._text(found, c)
        own = f"{{{NS}}}fragment"
        if given:
            declared = re.search(r"\((.*)\)", found.attrib.get(own, ""))
            values = c.listed(given)
            names = [n.strip() for n in declared[1].split(",")] if declared else []
            c = c.bind(",".join(g if re.match(r"\w+=", g) else f"{n}={g}" for n, g in zip(names or values, values, strict=False)))
        if not whole:
            return F.concat(*self._children(found, c))
        copy = ET.Element(found.tag, {k: v for k, v in found.attrib.items() if k not in (own, f"{{{NS}}}ref")})
        copy.text, copy[:] = found.text, list(found)
        return self._node(copy, c)

    def _v1(self, e: ET.Element, c: Compiler) -> Column:
        tag, a = e.tag[len(V1) + 2 :], e.attrib
        body = lambda inner: F.concat(*[c0 for c0 in [self._v1_text(e.text, inner)] + [x for child in e for x in (self._node(child, inner), self._v1_text(child.tail, inner))]])
        if tag == "if":
            test = truth(c.evaluate(a["test"]))
            return F.when(~test if a.get("not") == "true" else test, body(c)).otherwise(F.lit(""))
        if tag == "iterate":
            listed, kind = c.evaluate(a["collection"])
            return F.coalesce(F.array_join(F.transform(listed, lambda x: body(Compiler(c.scope | {a["var"]: (x, kind.elementType)}, c.selected))), ""), F.lit(""))
        if tag == "for":
            low, high = (c.evaluate(a[k])[0].cast("bigint") for k in ("begin", "end"))
            rows = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
            return F.array_join(F.transform(rows, lambda x: body(Compiler(c.scope | {a["var"]: (x, T.LongType())}, c.selected))), "")
        if tag == "number":
            return self._v1_number(a["n"], a.get("f", ""), c)
        if tag == "options":
            listed, kind = c.evaluate(a["collection"])
            chosen = text(c.evaluate(a["selected"])) if "selected" in a else F.lit("")

            def option(x: Column) -> Column:
                pick = lambda k: text((x[a[k]] if a.get(k) and isinstance(kind.elementType, T.StructType) else x, T.StringType()))
                return F.concat(F.lit('<option value="'), escape_xml(pick("value"), True), F.when(pick("value") == chosen, '" selected="selected">').otherwise('">'), escape_xml(pick("label")), F.lit("</option>"))

            return F.array_join(F.transform(listed, option), "")
        if tag == "option":
            own, chosen = c.substitute(a.get("value", "")), c.substitute(a.get("selected", ""))
            return F.concat(F.lit('<option value="'), escape_xml(own, True), F.when(own == chosen, '" selected="selected">').otherwise('">'), body(c), F.lit("</option>"))
        if tag == "checkbox":
            on = truth(c.evaluate(a["checked"]))
            return F.concat(F.lit(f'<input type="checkbox" name="{a.get("name", "")}" value="true"'), F.when(on, ' checked="checked"').otherwise(""), F.lit("/>"), body(c))
        if tag in ("include", "embed"):
            return self._fragment(f"~{{{a.get('file', '')}}}", c, whole=True)
        raise ElError(f"unsupported element {tag}")

    @staticmethod
    def _v1_number(said: str, picture: str, c: Compiler) -> Column:
        """A whole number grouped by thousands; with the picture '#,##0B' in whole units of 1,024; with a picture of another kind, the attribute as it stands."""
        if picture and not picture.startswith("#,##0"):
            return escape_xml(F.lit(said))
        n = c.evaluate(said)[0].try_cast("bigint")
        if picture != "#,##0B":
            return F.coalesce(F.format_number(n, 0), F.lit(""))
        out = None
        for i, unit in reversed(list(enumerate("BKMGTPE"))):
            part = F.shiftright(n, 10 * i) if i else n
            shown = F.concat(F.format_number(part, 0), F.lit(f" {unit}"))
            out = shown if out is None else F.when(part <= 1024, shown).otherwise(out)
        return F.coalesce(out, F.lit(""))

    def _v1_text(self, said: str | None, c: Compiler) -> Column:
        return escape_xml(c.substitute(said)) if said else F.lit("")


def template(df: DataFrame, source: str, files: dict[str, str] | None = None) -> Column:
    return Template(source, files).render(df)
