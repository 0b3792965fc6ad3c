"""XPath over the node table: parsed on the driver, evaluated as joins, windows and aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.xml import spread

AXES = ("ancestor-or-self", "ancestor", "attribute", "child", "descendant-or-self", "descendant", "following-sibling", "following", "namespace", "parent", "preceding-sibling", "preceding", "self")
REVERSE = frozenset(("ancestor", "ancestor-or-self", "preceding", "preceding-sibling"))
#: Least and most arguments of the core functions; None: any number.
FUNCTIONS = {
    "last": (0, 0), "position": (0, 0), "count": (1, 1), "id": (0, 0), "local-name": (0, 1), "namespace-uri": (0, 1), "name": (0, 1), "string": (0, 1), "concat": (2, None),
    "starts-with": (2, 2), "contains": (2, 2), "substring-before": (2, 2), "substring-after": (2, 2), "substring": (2, 3), "string-length": (0, 1), "normalize-space": (0, 1), "translate": (3, 3),
    "boolean": (1, 1), "not": (1, 1), "true": (0, 0), "false": (0, 0), "lang": (1, 1), "number": (0, 1), "sum": (1, 1), "floor": (1, 1), "ceiling": (1, 1), "round": (1, 1),
}
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>\.\.|//|::|!=|<=|>=|[/|+\-=<>()\[\],@.*$])|(?P<name>[^\W\d][\w.-]*(?::(?!:)[^\W\d][\w.-]*)?))")


class XPathError(ValueError):
    """The expression cannot be parsed, or uses what is not supported."""


@dataclass
class Step:
    axis: str
    test: str  # name, '*', or a node type with ()
    predicates: list = field(default_factory=list)
    target: str | None = None  # of processing-instruction('target')


@dataclass
class Path:
    absolute: bool
    steps: list[Step]


@dataclass
class Filter:
    """A node-set filtered as a whole, and steps from what is left."""

    base: object
    predicates: list
    steps: list[Step]


@dataclass
class Op:
    name: str
    args: list


@dataclass
class Lit:
    value: object


@dataclass
class Var:
    name: str


def parse(text: str):
    """The tree of an expression: Path, Filter, Op, Lit or Var."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise XPathError(f"unexpected character at {at} in {text!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    pos = 0

    def peek(k: int = 0) -> str:
        return tokens[min(pos + k, len(tokens) - 1)][1] if tokens[min(pos + k, len(tokens) - 1)][0] != "str" else "\0"

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal pos
        token = tokens[pos]
        if want is not None and (token[1] != want or token[0] == "str"):
            raise XPathError(f"expected {want!r}, found {token[1]!r}")
        pos += 1
        return token

    def binary(levels: list[tuple[str, ...]]):
        if not levels:
            return unary()
        left = binary(levels[1:])
        while peek() in levels[0] and tokens[pos][0] in ("op", "name"):
            left = Op(take()[1], [left, binary(levels[1:])])
        return left

    def expr():
        return binary([("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod")])

    def unary():
        if peek() == "-":
            take()
            return Op("neg", [unary()])
        left = primary()
        while peek() == "|":
            take()
            left = Op("|", [left, primary()])
        return left

    def primary():
        kind, value = tokens[pos]
        if kind == "num":
            take()
            return Lit(float(value))
        if kind == "str":
            take()
            return Lit(value[1:-1])
        if value == "$":
            take()
            return filtered(Var(take()[1]))
        if value == "(":
            take()
            inner = expr()
            take(")")
            return filtered(inner)
        if kind == "name" and peek(1) == "(" and value not in ("text", "comment", "node", "processing-instruction"):
            name = take()[1]
            take("(")
            args = []
            while peek() != ")":
                args.append(expr())
                if peek() == ",":
                    take()
            take(")")
            if name not in FUNCTIONS:
                raise XPathError(f"unsupported function {name}")
            low, high = FUNCTIONS[name]
            if len(args) < low or high is not None and len(args) > high:
                raise XPathError(f"wrong number of arguments of {name}")
            return filtered(Op(name, args))
        return path()

    def filtered(base):
        """base, or what predicates and steps behind it leave of it."""
        if peek() not in ("[", "/", "//"):
            return base
        if not isinstance(base, (Path, Filter, Var)) and not (isinstance(base, Op) and base.name == "|"):
            raise XPathError("only a node-set has predicates or steps")
        tests = predicates()
        return Filter(base, tests, steps_from()) if peek() in ("/", "//") else Filter(base, tests, [])

    def path() -> Path:
        steps, absolute = [], False
        if peek() == "/":
            take()
            absolute = True
            if tokens[pos][0] not in ("name",) and peek() not in (".", "..", "@", "*"):
                return Path(True, [])
        elif peek() == "//":
            take()
            absolute = True
            steps.append(Step("descendant-or-self", "node()"))
        steps.append(step())
        return Path(absolute, simplify(steps + steps_from()))

    def steps_from() -> list[Step]:
        steps = []
        while peek() in ("/", "//"):
            if take()[1] == "//":
                steps.append(Step("descendant-or-self", "node()"))
            steps.append(step())
        return simplify(steps)

    def step() -> Step:
        if peek() in (".", ".."):
            return Step("self" if take()[1] == "." else "parent", "node()", predicates())
        axis = "child"
        if peek() == "@":
            take()
            axis = "attribute"
        elif peek(1) == "::":
            axis = take()[1]
            take("::")
            if axis not in AXES:
                raise XPathError(f"unknown axis {axis}")
        kind, test = take()
        if test != "*" and kind != "name":
            raise XPathError(f"unexpected {test!r}")
        if peek() == "(" and test in ("text", "comment", "node", "processing-instruction"):
            take()
            target = take()[1][1:-1] if tokens[pos][0] == "str" else None
            take(")")
            return Step(axis, test + "()", predicates(), target)
        return Step(axis, test, predicates())

    def predicates() -> list:
        out = []
        while peek() == "[":
            take()
            out.append(expr())
            take("]")
        return out

    tree = expr()
    if tokens[pos][0] != "end":
        raise XPathError(f"unexpected {tokens[pos][1]!r}")
    return tree


def positional(e) -> bool:
    """Whether a predicate may depend on positions."""
    if isinstance(e, Op):
        return e.name in ("position", "last", "+", "-", "*", "div", "mod", "neg", "number", "floor", "ceiling", "round", "sum", "string-length", "count") or any(positional(a) for a in e.args)
    return isinstance(e, Var) or isinstance(e, Lit) and isinstance(e.value, float)


def simplify(steps: list[Step]) -> list[Step]:
    """descendant-or-self::node()/child::x is descendant::x where no predicate of x can depend on positions."""
    out: list[Step] = []
    for s in steps:
        if out and s.axis == "child" and out[-1] == Step("descendant-or-self", "node()") and not any(map(positional, s.predicates)):
            out[-1] = Step("descendant", s.test, s.predicates, s.target)
        else:
            out.append(s)
    return out


_NODE = ["pre", "post", "level", "parent_pre", "parent_post", "ord", "kind", "qname", "prefix", "local", "ns_uri", "value", "str_value", "lang", "is_id", "is_ns"]
#: Ranks of one bucket: axes that are intervals of ranks join by document and bucket.
BUCKET = 4096
NAN = float("nan")


def _bucket(rank: Column) -> Column:
    return F.floor(rank / BUCKET)


class Evaluator:
    """Evaluates expressions over one node table.

    A set of context rows has the columns doc, ctx (the row of a predicate that it belongs to), rid (an array that is unique in
    the document and sorts as the result does) and a node's columns. A step joins it with the node table by document and
    parent, or by document and bucket of ranks, so every join is an equi-join and no document is one key. Positions are
    worked out only where a predicate may ask for them. Paths inside predicates become one aggregate that is joined back.
    """

    def __init__(self, nodes: DataFrame, key: str = "doc_id", variables: dict | None = None) -> None:
        self.nodes, self.key, self.variables = nodes, key, variables or {}
        self.fresh = 0

    def roots(self) -> DataFrame:
        start = F.array(F.lit(0).cast("long"))
        return self.nodes.filter("kind = 'root'").select(F.col(self.key).alias("doc"), start.alias("ctx"), start.alias("rid"), *_NODE)

    def step(self, context: DataFrame, step: Step) -> DataFrame:
        given = ["ctx", F.col("rid").alias("_from")]
        ranks = {x: F.col(x).alias(f"c_{x}") for x in ("pre", "post", "parent_pre", "ord")}
        c = context.filter("kind IN ('element', 'root')")
        m = self.nodes.filter(self._test(step)).select(F.col(self.key).alias("doc"), *_NODE)
        no_attribute, pre, post, cp, cq = F.col("kind") != "attribute", F.col("pre"), F.col("post"), F.col("c_pre"), F.col("c_post")
        element = F.col("kind") == "element"
        both = ["doc", "_at"]
        spread = lambda low, high: F.explode(F.sequence(_bucket(low), _bucket(high)))

        def ranged(here: DataFrame, there: DataFrame, at: Column, other: Column, condition: Column) -> DataFrame:
            """here and there meet in buckets; `at` and `other` give one side's bucket and the other side's buckets."""
            c = here.select("doc", *given, ranks["pre"], ranks["post"], at.alias("_at"))
            return c.join(there.withColumn("_at", other), both).filter(condition).drop("_at")

        own_pre, own_post = F.col("pre"), F.col("post")
        if step.axis in ("child", "attribute", "namespace"):
            kind = no_attribute if step.axis == "child" else (F.col("kind") == "attribute") & (F.lit(True) if step.axis == "attribute" else F.col("is_ns"))
            rows = c.select("doc", *given, F.col("pre").alias("parent_pre")).join(m.filter(kind), ["doc", "parent_pre"])
        elif step.axis == "self":
            rows = c.select("doc", *given, "pre").join(m, ["doc", "pre"])
        elif step.axis == "parent":
            rows = c.select("doc", *given, F.col("parent_pre").alias("pre")).join(m, ["doc", "pre"])
        elif step.axis in ("following-sibling", "preceding-sibling"):
            later = F.col("ord") > F.col("c_ord") if step.axis[0] == "f" else F.col("ord") < F.col("c_ord")
            rows = c.select("doc", *given, "parent_pre", ranks["ord"]).join(m.filter(element), ["doc", "parent_pre"]).filter(later).drop("c_ord")
        elif step.axis in ("descendant", "descendant-or-self"):
            inside = (pre > cp) & (post < cq) if step.axis == "descendant" else (pre >= cp) & (post <= cq)
            rows = ranged(c, m.filter(no_attribute), spread(own_pre, own_post), _bucket(own_pre), inside)
        elif step.axis in ("ancestor", "ancestor-or-self"):
            around = (pre < cp) & (post > cq) if step.axis == "ancestor" else (pre <= cp) & (post >= cq)
            rows = ranged(c, m.filter(element), _bucket(own_pre), spread(own_pre, own_post), around)
        elif step.axis == "following":
            after = (pre > cq) & (element | (F.col("parent_pre") > cp))
            rows = ranged(c, m.filter(no_attribute), _bucket(own_post), spread(F.lit(0), own_pre), after)
        else:  # preceding
            before = (post < cp) & (element | (F.col("parent_post") < cq))
            rows = ranged(c, m.filter(no_attribute), spread(F.lit(0), own_pre), _bucket(own_post), before)
        rows = rows.drop("c_pre", "c_post")
        order = -F.col("pre") if step.axis in REVERSE else F.col("pre")
        rows = rows.withColumn("rid", F.concat("_from", F.array(order)))
        return self._filtered(rows, step.predicates, "_from", order).select("doc", "ctx", "rid", *_NODE)

    def _filtered(self, rows: DataFrame, predicates: list, of: str, order: Column) -> DataFrame:
        """The rows for which the predicates hold, one after the other; positions are those among the rows of one document and `of`."""
        for p in predicates:
            if positional(p):
                own = Window.partitionBy("doc", of)
                rows = rows.withColumn("_pos", F.row_number().over(own.orderBy(order))).withColumn("_last", F.count(F.lit(1)).over(own))
            rows, value, kind = self.expr(rows, p) if positional(p) else (*self.test(rows, p), "bool")
            rows = rows.filter(F.col("_pos") == value if kind == "num" else self._bool(value, kind))
        return rows

    def _test(self, step: Step) -> Column:
        kinds = {"text()": ["text", "cdata"], "comment()": ["comment"], "processing-instruction()": ["pi"]}
        if step.test == "node()":
            return F.lit(True)
        if step.test in kinds:
            found = F.col("kind").isin(kinds[step.test])
            return found if step.target is None else found & (F.col("qname") == step.target)
        kind = F.col("kind") == ("attribute" if step.axis in ("attribute", "namespace") else "element")
        return kind if step.test == "*" else kind & (F.col("local") == step.test)

    def path(self, context: DataFrame, path: Path, top: bool = False) -> DataFrame:
        steps = path.steps
        if top and path.absolute and steps and steps[0].axis in ("child", "descendant") and not any(map(positional, steps[0].predicates)):
            # from the roots: a filter by level, without a join
            first, start = steps[0], F.array(F.lit(0).cast("long"))
            found = self.nodes.filter(self._test(first) & (F.col("kind") != "attribute") & (F.col("level") == 1 if first.axis == "child" else F.col("level") > 0))
            rows = found.select(F.col(self.key).alias("doc"), start.alias("ctx"), F.concat(start, F.array("pre")).alias("rid"), *_NODE)
            for p in first.predicates:
                rows, value = self.test(rows, p)
                rows = rows.filter(value)
            context, steps = rows.select("doc", "ctx", "rid", *_NODE), steps[1:]
        elif path.absolute and not top:
            roots = self.nodes.filter("kind = 'root'").select(F.col(self.key).alias("doc"), *_NODE)
            context = context.select("doc", "ctx", "rid").join(roots, "doc")
        for s in steps:
            context = self.step(context, s)
        return context

    def select(self, tree) -> DataFrame:
        """The node rows of a location path or a union of some, with rid as their order in each document. Other node-sets stand inside predicates only."""
        for part in tree.args if isinstance(tree, Op) and tree.name == "|" else [tree]:
            if isinstance(part, (Filter, Var)):
                raise XPathError("a location path or a union of some is expected")
        return self._set(self.roots(), tree, True)

    def _is_set(self, e) -> bool:
        return isinstance(e, (Path, Filter)) or isinstance(e, Op) and e.name == "|" or isinstance(e, Var) and isinstance(self.variables.get(e.name), DataFrame)

    def _set(self, context: DataFrame, tree, top: bool = False) -> DataFrame:
        if isinstance(tree, Op) and tree.name == "|":
            parts = [self._set(context, a, top) for a in tree.args]
            behind = F.slice("rid", F.size("ctx") + 1, F.size("rid"))
            return reduce(DataFrame.unionByName, [p.withColumn("rid", F.concat("ctx", F.array(F.lit(i).cast("long")), behind)) for i, p in enumerate(parts)])
        if isinstance(tree, Filter):
            rows = self._filtered(self._set(context, tree.base), tree.predicates, "ctx", F.col("rid")).select("doc", "ctx", "rid", *_NODE)
            for s in tree.steps:
                rows = self.step(rows, s)
            return rows
        if isinstance(tree, Var) and self._is_set(tree):
            chosen = self.variables[tree.name].select(F.col(self.key).alias("doc"), "pre").distinct()
            found = spread(self.nodes.select(F.col(self.key).alias("doc"), *_NODE).join(chosen, ["doc", "pre"], "left_semi"))
            return context.select("doc", "ctx", "rid").join(found, "doc").withColumn("rid", F.concat("rid", F.array("pre"))).select("doc", "ctx", "rid", *_NODE)
        if not isinstance(tree, Path):
            raise XPathError("a node-set is expected")
        return self.path(context, tree, top)

    def expr(self, rows: DataFrame, e) -> tuple[DataFrame, Column, str]:
        """rows with the columns that e needs, e's value for each row, and its type: num, str, bool or set (text, texts, any)."""
        if isinstance(e, Lit):
            return rows, F.lit(e.value), "num" if isinstance(e.value, float) else "str"
        if isinstance(e, Var) and not self._is_set(e):
            if e.name not in self.variables:
                raise XPathError(f"unknown variable {e.name}")
            v = self.variables[e.name]
            return rows, F.lit(v if isinstance(v, str) else float(v)), "str" if isinstance(v, str) else "num"
        if e == Path(False, [Step("self", "node()")]):  # the context node itself
            inside = F.col("kind").isin("element", "root")
            own = F.when(inside, F.coalesce("str_value", F.lit(""))).otherwise("")
            return rows, F.struct(own.alias("s"), F.when(inside, F.array(own)).otherwise(F.array().cast("array<string>")).alias("all"), inside.alias("any")), "set"
        if self._is_set(e):
            return self._aggregate(rows, e, "set")
        return self._call(rows, e)

    def test(self, rows: DataFrame, e) -> tuple[DataFrame, Column]:
        """e as a condition. Whether a path finds a node, or one that compares with a constant, is an aggregate that holds no values."""
        if self._is_set(e):
            if e == Path(False, [Step("self", "node()")]):
                return rows, F.col("kind").isin("element", "root")
            return self._aggregate(rows, e, "any")[:2]
        if isinstance(e, Op) and e.name in ("and", "or"):
            rows, a = self.test(rows, e.args[0])
            rows, b = self.test(rows, e.args[1])
            return rows, (a & b) if e.name == "and" else (a | b)
        if isinstance(e, Op) and e.name in ("not", "boolean"):
            rows, a = self.test(rows, e.args[0])
            return rows, ~a if e.name == "not" else a
        if isinstance(e, Op) and e.name in _COMPARE:
            for path, other, turned in ((e.args[0], e.args[1], False), (e.args[1], e.args[0], True)):
                fixed = isinstance(other, Lit) or isinstance(other, Var) and not self._is_set(other) or isinstance(other, Op) and other.name == "neg" and isinstance(other.args[0], Lit)
                if fixed and self._is_set(path) and path != Path(False, [Step("self", "node()")]):
                    _, value, kind = self.expr(rows, other)
                    sides = [(F.coalesce("str_value", F.lit("")), "str"), (value, kind)]
                    return self._aggregate(rows, path, "where", self._compare(e.name, *(sides[::-1] if turned else sides)))[:2]
        rows, value, kind = self.expr(rows, e)
        return rows, self._bool(value, kind)

    def _aggregate(self, rows: DataFrame, tree, what: str, condition: Column | None = None) -> tuple[DataFrame, Column, str]:
        """A value of a node-set for each row: its texts in order, whether there is a node (or one for which the condition holds), size, sum, first name or text."""
        self.fresh += 1
        name = f"_v{self.fresh}"
        context = rows.select("doc", F.col("rid").alias("ctx"), "rid", *_NODE)
        found = self._set(context, tree)
        if what == "where":
            found = found.filter(condition)
        value = {
            "set": F.transform(F.array_sort(F.collect_list(F.struct("rid", F.coalesce("str_value", F.lit("")).alias("s")))), lambda x: x["s"]),
            "any": F.lit(True),
            "where": F.lit(True),
            "count": F.count(F.lit(1)),
            "sum": F.sum(self._num(F.coalesce("str_value", F.lit("")), "str")),
            "local-name": F.min_by("local", "rid"), "namespace-uri": F.min_by("ns_uri", "rid"), "name": F.min_by("qname", "rid"), "string": F.min_by("str_value", "rid"),
        }[what]
        keys = [F.col("doc").alias("doc"), F.col("ctx").alias("rid")]
        sums = found.select(*keys).distinct().withColumn(name, F.lit(True)) if what in ("any", "where") else found.groupBy(*keys).agg(value.alias(name))
        rows = rows.join(sums, ["doc", "rid"], "left")
        if what == "set":
            texts = F.coalesce(F.col(name), F.array().cast("array<string>"))
            return rows, F.struct(F.array_join(texts, "").alias("s"), texts.alias("all"), (F.size(texts) > 0).alias("any")), "set"
        if what in ("any", "where"):
            return rows, F.coalesce(F.col(name), F.lit(False)), "bool"
        if what in ("count", "sum"):
            return rows, F.coalesce(F.col(name), F.lit(0)).cast("double"), "num"
        return rows, F.coalesce(F.col(name), F.lit("")), "str"

    @staticmethod
    def _bool(v: Column, kind: str) -> Column:
        return {"bool": lambda: v, "num": lambda: (v != 0) & ~F.isnan(v), "str": lambda: v != "", "set": lambda: v["any"]}[kind]()

    @staticmethod
    def _num(v: Column, kind: str) -> Column:
        if kind == "num":
            return v
        if kind == "bool":
            return v.cast("double")
        text = v["s"] if kind == "set" else v
        return F.coalesce(F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*$", 1).try_cast("double"), F.lit(NAN))

    @staticmethod
    def _str(v: Column, kind: str) -> Column:
        if kind == "set":
            return v["s"]
        if kind == "bool":
            return F.when(v, "true").otherwise("false")
        return F.when(F.isnan(v), "NaN").otherwise(F.coalesce(F.when(v % 1 == 0, v.try_cast("decimal(38,0)").cast("string")), v.cast("string"))) if kind == "num" else v

    def _compare(self, f: str, a: tuple[Column, str], b: tuple[Column, str]) -> Column:
        """A comparison of two values. A node-set compares if one of its nodes does."""
        for one, other, turned in ((a, b, False), (b, a, True)):
            if one[1] == "set" and other[1] != "bool":
                if other[1] == "set" and f in _COMPARE[2:]:  # the best pair decides
                    x, y = (F.filter(F.transform(v[0]["all"], lambda s: self._num(s, "str")), lambda n: ~F.isnan(n)) for v in (a, b))
                    low, high = (F.array_min(x), F.array_max(y)) if f[0] == "<" else (F.array_max(x), F.array_min(y))
                    return F.coalesce(self._compare(f, (low, "num"), (high, "num")), F.lit(False))
                pair = lambda s: self._compare(f, *([other, (s, "str")] if turned else [(s, "str"), other]))  # noqa: B023, E731
                return F.exists(one[0]["all"], pair)
        kinds = {a[1], b[1]}
        if f in ("=", "!="):
            same = self._bool(*a) == self._bool(*b) if "bool" in kinds else self._num(*a) == self._num(*b) if "num" in kinds else self._str(*a) == self._str(*b)
            if "num" in kinds and "bool" not in kinds:
                same = same & ~F.isnan(self._num(*a)) & ~F.isnan(self._num(*b))
            return same if f == "=" else ~same
        x, y = ((self._bool(*v).cast("double") if v[1] == "set" else self._num(*v)) for v in (a, b))
        return ~F.isnan(x) & ~F.isnan(y) & {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[f]

    def _call(self, rows: DataFrame, e: Op) -> tuple[DataFrame, Column, str]:
        f = e.name
        if f in ("count", "sum"):
            return self._aggregate(rows, e.args[0], f)
        if f in ("local-name", "namespace-uri", "name") and e.args:
            return self._aggregate(rows, e.args[0], f)
        if f in ("and", "or", "not", "boolean"):
            return (*self.test(rows, e), "bool")
        args = []
        for a in e.args:
            rows, v, kind = self.expr(rows, a)
            args.append((v, kind))
        s = lambda i: self._str(*args[i]) if i < len(args) else F.coalesce("str_value", F.lit(""))
        n = lambda i: self._num(*args[i]) if i < len(args) else self._num(F.coalesce("str_value", F.lit("")), "str")
        if f in _COMPARE:
            return rows, self._compare(f, *args), "bool"
        if f in ("+", "-", "*"):
            return rows, {"+": n(0) + n(1), "-": n(0) - n(1), "*": n(0) * n(1)}[f], "num"
        if f == "div":
            zero = F.when((n(0) == 0) | F.isnan(n(0)), NAN).otherwise(F.signum(n(0)) * float("inf"))
            return rows, F.when(n(1) == 0, zero).otherwise(n(0) / F.when(n(1) == 0, 1.0).otherwise(n(1))), "num"
        if f == "mod":
            whole = [F.round(n(i)).try_cast("long") for i in (0, 1)]  # null for NaN and infinities
            return rows, F.coalesce(F.try_mod(*whole).cast("double"), F.lit(NAN)), "num"
        if f == "neg":
            return rows, -n(0), "num"
        still = lambda c: F.isnan(c) | (F.abs(c) >= 2.0**52)  # noqa: E731  # whole already, or no number
        zero = F.lit("")
        at = F.instr(s(0), s(1)) if f in ("substring-before", "substring-after") else None
        own = lambda c: F.coalesce(F.col(c), zero)
        out = {
            "last": lambda: (F.col("_last").cast("double"), "num"),
            "position": lambda: (F.col("_pos").cast("double"), "num"),
            "true": lambda: (F.lit(True), "bool"),
            "false": lambda: (F.lit(False), "bool"),
            "local-name": lambda: (own("local"), "str"),
            "namespace-uri": lambda: (own("ns_uri"), "str"),
            "name": lambda: (own("qname"), "str"),
            "string": lambda: (s(0), "str"),
            "concat": lambda: (F.concat(*[s(i) for i in range(len(args))]), "str"),
            "starts-with": lambda: (F.startswith(s(0), s(1)), "bool"),
            "contains": lambda: (F.contains(s(0), s(1)), "bool"),
            "substring-before": lambda: (F.when(at > 0, F.substring(s(0), F.lit(1), at - 1)).otherwise(zero), "str"),
            "substring-after": lambda: (F.when(at > 0, F.substring(s(0), at + F.length(s(1)), F.length(s(0)))).otherwise(zero), "str"),
            "substring": lambda: (self._substring(s(0), n(1), n(2) if len(args) > 2 else None), "str"),
            "string-length": lambda: (F.length(s(0)).cast("double"), "num"),
            "normalize-space": lambda: (F.trim(F.regexp_replace(s(0), r"[ \t\r\n]+", " ")), "str"),
            "translate": lambda: (F.call_function("translate", s(0), s(1), s(2)), "str"),
            "lang": lambda: (F.coalesce((F.lower("lang") == F.lower(s(0))) | F.startswith(F.lower("lang"), F.concat(F.lower(s(0)), F.lit("-"))), F.lit(False)), "bool"),
            "number": lambda: (n(0), "num"),
            "floor": lambda: (F.when(still(n(0)), n(0)).otherwise(F.floor(n(0)).cast("double")), "num"),
            "ceiling": lambda: (F.when(still(n(0)), n(0)).otherwise(F.ceil(n(0)).cast("double")), "num"),
            "round": lambda: (F.when(still(n(0)), n(0)).otherwise(F.round(n(0))), "num"),
            "id": lambda: (None, "str"),
        }
        if f == "id":
            return self._aggregate(rows, Path(False, [Step("attribute", "*", [Op("#is-id", [])])]), "string")
        if f == "#is-id":
            return rows, F.col("is_id"), "bool"
        value, kind = out[f]()
        return rows, value, kind

    @staticmethod
    def _substring(text: Column, start: Column, size: Column | None) -> Column:
        """Characters at places from round(start) to before round(start) + round(size); none where one of these is no number."""
        end = F.length(text) + 1.0
        low = F.round(start)
        high = end if size is None else F.least(low + F.round(size), end)
        low = F.greatest(low, F.lit(1.0))
        some = ~F.isnan(start) & ~F.isnan(high) & (high > low)
        first = F.when(some, low).otherwise(1.0).cast("int")
        return F.when(some, F.substring(text, first, F.when(some, high - low).otherwise(0.0).cast("int"))).otherwise("")


_COMPARE = ("=", "!=", "<", "<=", ">", ">=")


def xpath(nodes: DataFrame, expression: str, key: str = "doc_id", variables: dict | None = None, dedupe: bool = False) -> DataFrame:
    """The nodes that a location path selects in every document: key, position (from 1, in the path's order), and the node's columns.

    A node reached twice appears twice; with dedupe, once, in document order. Variables are texts, numbers, or node-sets as tables of key and pre.
    """
    found = Evaluator(nodes, key, variables).select(parse(expression)).withColumnRenamed("doc", key)
    if dedupe:
        found = found.dropDuplicates([key, "pre"]).withColumn("rid", F.array("pre"))
    order = Window.partitionBy(key).orderBy("rid")
    return found.withColumn("position", F.row_number().over(order)).select(key, "position", *_NODE)


def matches(nodes: DataFrame, rows: DataFrame, expression: str, key: str = "doc_id") -> DataFrame:
    """Those of the node rows that the expression selects."""
    return spread(rows.join(xpath(nodes, expression, key).select(key, "pre").distinct(), [key, "pre"], "left_semi"))


def first(nodes: DataFrame, expression: str, key: str = "doc_id") -> DataFrame:
    """Each document's first match."""
    return xpath(nodes, expression, key).filter("position = 1").drop("position")
