"""The expression language: parsed once on the driver, compiled to Columns typed by the scope's columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.uri import query_parameters, url_encode

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*')|(?P<sub>\|[^|]*\|)|(?P<util>#[A-Za-z]+)|(?P<op>\?:|==|!=|<=|>=|[-+*/<>?:.,(){}\[\]])|(?P<name>[A-Za-z_]\w*))")
_VARIABLE = re.compile(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}")
Value = tuple[Column, T.DataType]


class ElError(ValueError):
    """The expression cannot be parsed or typed."""


class NodeSet(T.DataType):
    """The type of a value that is nodes of a template; the value has render(whole) and says whether it is empty."""


#: Utility objects: name -> method -> builder of (column, type) from argument values.
UTILITIES: dict[str, dict[str, Callable[..., Value]]] = {}


def utility(name: str, method: str):
    """Registers a builder as #name.method(...)."""

    def add(f):
        UTILITIES.setdefault(name, {})[method] = f
        return f

    return add


def truth(v: Value) -> Column:
    """False: null, false, 0, '' and empty collections."""
    c, t = v
    if isinstance(t, NodeSet):
        return F.lit(bool(c.nodes))
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(t, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return F.lit(False) if isinstance(t, T.NullType) else c.isNotNull()


def text(v: Value) -> Column:
    c, t = v
    if isinstance(t, NodeSet):
        return c.render(True)
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


class Compiler:
    """Compiles against a scope: names to (Column, type), with an optional selected object for *{...}."""

    def __init__(self, scope: dict[str, Value], selected: Value | None = None) -> None:
        self.scope, self.selected = scope, selected
        self.literals: dict[int, tuple[Column, str]] = {}  # text literals of the expression, for builders that need them on the driver

    def literal(self, v: Value) -> str:
        """The text of a value that is a literal."""
        if id(v[0]) not in self.literals:
            raise ElError("a literal is needed here")
        return self.literals[id(v[0])][1]

    @staticmethod
    def over(df: DataFrame, **more: Value) -> Compiler:
        return Compiler({f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields} | more)

    def evaluate(self, expression: str) -> Value:
        """The value of '${...}', '*{...}', '@{...}', '|...|' or a bare expression."""
        e = expression.strip()
        if e.startswith("~{"):
            if "~" not in self.scope:
                raise ElError("nodes are named in templates only")
            return self.scope["~"][0].nodes(e, self), NodeSet()
        if e.startswith("@{") and e.endswith("}"):
            return self.link(e[2:-1])
        if e.startswith("*{") and e.endswith("}"):
            if self.selected is None:
                raise ElError("nothing is selected")
            c, t = self.selected
            return Compiler(self.scope | {f.name: (c[f.name], f.dataType) for f in t.fields}).evaluate(e[2:-1])
        if e.startswith("${") and _VARIABLE.fullmatch(e):
            e = e[2:-1]
        self.tokens, self.at = self._lex(e), 0
        out = self._expr()
        if self.at < len(self.tokens):
            raise ElError(f"unexpected {self.tokens[self.at][1]!r} in {expression!r}")
        return out

    def substitute(self, template: str) -> Column:
        """Text with every ${...} replaced by its value."""
        parts, at = [], 0
        for m in _VARIABLE.finditer(template):
            if m.start() > at:
                parts.append(F.lit(template[at : m.start()]))
            parts.append(text(Compiler(self.scope, self.selected).evaluate(m[1])))
            at = m.end()
        parts.append(F.lit(template[at:]))
        return F.concat(*parts)

    def link(self, spec: str) -> Value:
        """path(name=value,...): {name} in the path is replaced, the others become a query sorted by name; values are percent-coded."""
        m = re.fullmatch(r"([^()]*)(?:\((.*)\))?", spec.strip(), re.S)
        if not m:
            raise ElError(f"not a link: {spec!r}")
        path, rest = F.lit(m[1]), {}
        for name, expr in self.pairs(m[2] or ""):
            value = url_encode(text(Compiler(self.scope, self.selected).evaluate(expr)))
            if f"{{{name}}}" in m[1]:
                path = F.replace(path, F.lit(f"{{{name}}}"), value)
            else:
                rest[name] = value
        query = [F.concat(F.lit(f"{n}="), rest[n]) for n in sorted(rest)]
        return (F.concat(path, F.lit("?"), F.concat_ws("&", *query)) if query else path), T.StringType()

    @staticmethod
    def pairs(listed: str) -> list[tuple[str, str]]:
        """name=expression pairs divided by commas outside of quotes and brackets."""
        found = [part.partition("=") for part in Compiler.listed(listed)]
        return [(name.strip(), value.strip()) for name, _, value in found]

    @staticmethod
    def listed(said: str) -> list[str]:
        """What stands between commas outside of quotes and brackets."""
        out, depth, quote, start = [], 0, False, 0
        for i, c in enumerate(said + ","):
            quote ^= c == "'"
            depth += (c in "({[") - (c in ")}]") if not quote else 0
            if c == "," and depth == 0 and not quote:
                if part := said[start:i].strip():
                    out.append(part)
                start = i + 1
        return out

    def attributes(self, listed: str) -> dict[str, Value]:
        return {n: Compiler(self.scope, self.selected).evaluate(v) for n, v in self.pairs(listed)}

    def bind(self, listed: str) -> Compiler:
        """A compiler with local names; each may use those before it."""
        inner = Compiler(dict(self.scope), self.selected)
        for n, v in self.pairs(listed):
            inner.scope[n] = Compiler(inner.scope, self.selected).evaluate(v)
        return inner

    def holds(self, listed: str) -> Column:
        """Whether all listed expressions are true."""
        return reduce(lambda a, b: a & b, [truth(Compiler(self.scope, self.selected).evaluate(x[0] if not x[1] else f"{x[0]}={x[1]}")) for x in self.pairs(listed)], F.lit(True))

    @staticmethod
    def _lex(e: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while e[at:].strip():
            m = _TOKEN.match(e, at)
            if not m:
                raise ElError(f"unexpected character at {at} in {e!r}")
            out.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        return out

    def _peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") else None

    def _take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want is not None and self.tokens[self.at][1] != want:
            raise ElError(f"expected {want or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def _expr(self) -> Value:
        cond = self._chain(0)
        if self._peek() == "?:":
            self._take()
            other = self._expr()
            return F.when(truth(cond), self._as(cond, other)).otherwise(self._as(other, cond)), self._common(cond, other)
        if self._peek() == "?":
            self._take()
            yes = self._expr()
            no = (F.lit(None), yes[1])
            if self._peek() == ":":
                self._take()
                no = self._expr()
            return F.when(truth(cond), self._as(yes, no)).otherwise(self._as(no, yes)), self._common(yes, no)
        return cond

    @staticmethod
    def _common(a: Value, b: Value) -> T.DataType:
        return a[1] if a[1] == b[1] else T.DoubleType() if isinstance(a[1], T.NumericType) and isinstance(b[1], T.NumericType) else T.StringType()

    def _as(self, v: Value, other: Value) -> Column:
        t = self._common(v, other)
        return v[0] if v[1] == t else v[0].cast(t)

    _LEVELS = (("or",), ("and",), ("==", "!=", "eq", "ne"), ("<", "<=", ">", ">=", "lt", "le", "gt", "ge", "in", "not"), ("+", "-"), ("*", "/", "div", "mod"))

    def _chain(self, level: int) -> Value:
        if level == len(self._LEVELS):
            return self._unary()
        left = self._chain(level + 1)
        while (op := self._peek()) in self._LEVELS[level]:
            if op == "not" and (self.at + 1 >= len(self.tokens) or self.tokens[self.at + 1][1] != "in"):
                break
            self._take()
            if op == "not":
                self._take("in")
                left = (~self._member(left, self._chain(level + 1)), T.BooleanType())
            else:
                left = self._apply(op, left, self._chain(level + 1))
        return left

    @staticmethod
    def _member(x: Value, listed: Value) -> Column:
        return F.coalesce(F.array_contains(listed[0].cast(T.ArrayType(x[1])), x[0]), F.lit(False))

    def _apply(self, op: str, a: Value, b: Value) -> Value:
        boolean, numeric = T.BooleanType(), isinstance(a[1], T.NumericType) and isinstance(b[1], T.NumericType)
        if op in ("or", "and"):
            return (truth(a) | truth(b)) if op == "or" else (truth(a) & truth(b)), boolean
        if op in ("==", "!=", "eq", "ne"):
            same = F.coalesce(a[0].eqNullSafe(b[0]), F.lit(False)) if a[1] == b[1] or numeric else F.lit(False)
            return (same if op in ("==", "eq") else ~same), boolean
        if op == "in":
            return self._member(a, b), boolean
        if op in ("<", "<=", ">", ">=", "lt", "le", "gt", "ge"):
            word = {"lt": "<", "le": "<=", "gt": ">", "ge": ">="}.get(op, op)
            if not numeric and a[1] != b[1]:
                raise ElError("values of different kinds have no order here")
            return F.coalesce({"<": a[0] < b[0], "<=": a[0] <= b[0], ">": a[0] > b[0], ">=": a[0] >= b[0]}[word], F.lit(False)), boolean
        if op == "+" and isinstance(a[1], T.StringType) and isinstance(b[1], T.StringType):
            return F.concat(text(a), text(b)), T.StringType()
        if not numeric:
            raise ElError(f"{op} needs numbers")
        whole = isinstance(a[1], T.IntegralType)  # the left operand's kind decides
        x, y = (a[0].cast("bigint"), b[0].cast("bigint")) if whole else (a[0].cast("double"), b[0].cast("double"))
        kind = T.LongType() if whole else T.DoubleType()
        if op in ("+", "-", "*"):
            return {"+": x + y, "-": x - y, "*": x * y}[op], kind
        if op == "mod":
            return F.try_mod(x, y), kind
        return (F.try_divide(x - F.try_mod(x, y), y).cast("bigint") if whole else F.try_divide(x, y)), kind

    def _unary(self) -> Value:
        if self._peek() == "-":
            self._take()
            c, t = self._unary()
            return -c, t
        if self._peek() == "not":
            self._take()
            return ~truth(self._unary()), T.BooleanType()
        return self._postfix(self._primary())

    def _primary(self) -> Value:
        kind, value = self._take()
        if kind == "num":
            return (F.lit(float(value)), T.DoubleType()) if "." in value else (F.lit(int(value)).cast("bigint"), T.LongType())
        if kind == "str":
            said = re.sub(r"\\(.)", r"\1", value[1:-1])
            column = F.lit(said)
            self.literals[id(column)] = column, said
            return column, T.StringType()
        if kind == "sub":
            return self.substitute(value[1:-1]), T.StringType()
        if kind == "util":
            self._take(".")
            method = self._take()[1]
            args = []
            if self._peek() == "(":
                self._take()
                while self._peek() != ")":
                    args.append(self._expr())
                    if self._peek() == ",":
                        self._take()
                self._take(")")
            try:
                return UTILITIES[value[1:]][method](self, *args)
            except KeyError:
                raise ElError(f"unknown {value}.{method}") from None
        if value == "(":
            out = self._expr()
            self._take(")")
            return out
        if value == "{":
            items = []
            while self._peek() != "}":
                items.append(self._expr())
                if self._peek() == ",":
                    self._take()
            self._take("}")
            t = reduce(lambda a, v: self._common((F.lit(None), a), v), items[1:], items[0][1]) if items else T.StringType()
            return F.array(*[c.cast(t) for c, _ in items]), T.ArrayType(t)
        if kind == "name":
            if value in ("true", "false"):
                return F.lit(value == "true"), T.BooleanType()
            return self.scope.get(value, (F.lit(None), T.NullType()))
        raise ElError(f"unexpected {value!r}")

    def _postfix(self, v: Value) -> Value:
        while self._peek() in (".", "["):
            if self._take()[1] == "[":
                i = self._expr()
                self._take("]")
                c, t = v
                if isinstance(t, T.ArrayType):
                    v = F.get(c, i[0].cast("int")), t.elementType
                elif isinstance(t, T.MapType):
                    v = F.try_element_at(c, i[0]), t.valueType
                else:
                    v = F.lit(None), T.NullType()
                continue
            name, (c, t) = self._take()[1], v
            if isinstance(t, T.StructType) and name in t.fieldNames():
                v = c[name], t[name].dataType
            elif isinstance(t, T.MapType):
                v = F.try_element_at(c, F.lit(name)), t.valueType
            elif name in ("count", "length") and isinstance(t, (T.ArrayType, T.StringType)):
                v = (F.size(c) if isinstance(t, T.ArrayType) else F.length(c)).cast("bigint"), T.LongType()
            elif name == "empty":
                v = ~truth(v), T.BooleanType()
            else:
                v = F.lit(None), T.NullType()
        return v


def _fixed(number: Column, decimals: Column) -> Column:
    """A decimal grouped by thousands with so many places, half up."""
    return F.call_function("format_number", F.call_function("round", number, decimals), decimals)


@utility("numbers", "formatDecimal")
def format_decimal(_, number: Value, digits: Value | None = None, decimals: Value | None = None) -> Value:
    """Grouped by thousands, half up, with at least `digits` digits before the point (foldable) and `decimals` after it."""
    n = decimals[0].cast("int") if decimals else F.lit(0)
    least = digits[0].cast("int") if digits else F.lit(1)
    shown = _fixed(number[0].cast("decimal(38,12)"), n)
    sign = F.regexp_extract(shown, "^(-?)", 1)
    whole = F.regexp_extract(shown, r"^-?([0-9,]+)", 1)
    return F.concat(sign, F.when(F.length(whole) < least, F.lpad(whole, least, F.lit("0"))).otherwise(whole), F.regexp_extract(shown, r"(\.[0-9]*)$", 1)), T.StringType()


@utility("numbers", "formatDiskSize")
def format_disk_size(_, number: Value, decimals: Value | None = None) -> Value:
    """Divided by 1024 while larger than that, with the suffix B, K, M, G, T, P or E."""
    c, n = number[0].cast("double"), decimals[0].cast("int") if decimals else F.lit(0)
    out = F.lit(None).cast("string")
    for i, s in reversed(list(enumerate("BKMGTPE"))):
        shown = F.concat(_fixed((c / float(1024**i)).cast("decimal(38,12)"), n), F.lit(f" {s}"))
        out = shown if s == "E" else F.when(c <= float(1024 ** (i + 1)), shown).otherwise(out)
    return out, T.StringType()


#: strftime codes and the date patterns that print the same in English.
_DATE = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "y": "yy", "p": "a", "I": "hh", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm"}


@utility("dates", "format")
def format_date(compiler: Compiler, when: Value, form: Value, locale: Value | None = None) -> Value:
    """An ISO time printed by a strftime form, with names in a locale's language; both are literals."""
    pattern, parts = compiler.literal(form), []
    at = F.to_timestamp(when[0]) if isinstance(when[1], T.StringType) else when[0]
    if locale is not None:
        options = {"locale": compiler.literal(locale).replace("_", "-"), "sep": "\u0001", "quote": "\u0002", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        printed = lambda form: F.to_csv(F.struct(at.cast("timestamp")), {**options, "timestampFormat": form, "timestampNTZFormat": form})
    else:
        printed = lambda form: F.date_format(at, form)
    for m in re.finditer(r"%(.)|([^%]+)", pattern, re.S):
        if m[2]:
            parts.append(F.lit(m[2]))
        elif m[1] == "e":
            parts.append(F.lpad(printed("d"), 2, " "))
        elif m[1] == "%":
            parts.append(F.lit("%"))
        elif m[1] in _DATE:
            parts.append(printed(_DATE[m[1]]))
        else:
            raise ElError(f"unknown date code %{m[1]}")
    return F.concat(*parts), T.StringType()


@utility("security", "hasRole")
def has_role(compiler: Compiler, role: Value) -> Value:
    roles = compiler.scope.get("roles", (F.array().cast("array<string>"), None))[0]
    return F.coalesce(F.array_contains(roles, role[0]), F.lit(False)), T.BooleanType()


@utility("security", "authorized")
def authorized(compiler: Compiler) -> Value:
    return compiler.scope.get("username", (F.lit(None),))[0].isNotNull(), T.BooleanType()


@utility("security", "username")
def username(compiler: Compiler) -> Value:
    return compiler.scope.get("username", (F.lit(None).cast("string"),))[0], T.StringType()


@utility("request", "getRequestURI")
def request_uri(compiler: Compiler) -> Value:
    return compiler.scope["uri"][0], T.StringType()


@utility("request", "getRequestURL")
def request_url(compiler: Compiler) -> Value:
    scheme, host = (compiler.scope.get(k, (F.lit(v), None))[0] for k, v in (("scheme", "http"), ("host", "localhost")))
    return F.concat(scheme, F.lit("://"), host, compiler.scope["uri"][0]), T.StringType()


@utility("request", "getParameter")
def request_parameter(compiler: Compiler, name: Value) -> Value:
    """The first value of a parameter of the request's query; null without one."""
    query = F.regexp_extract(compiler.scope["uri"][0], r"\?([^#]*)", 1)
    return F.get(F.filter(query_parameters(query), lambda p: p["name"] == name[0]), F.lit(0))["value"], T.StringType()


def el_or_text(df: DataFrame, expression: str) -> Column:
    """Like el, but an expression that cannot be parsed gives a text that says so."""
    try:
        return el(df, expression)
    except ElError as e:
        return F.lit(f"Error parsing expression: {e}")


def el(df: DataFrame, expression: str) -> Column:
    """An expression over a DataFrame's columns."""
    return Compiler.over(df).evaluate(expression)[0]
