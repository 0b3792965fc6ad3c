"""Content models of elements: an automaton for each, run over blocks of children whose state changes are composed."""

from __future__ import annotations

from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Children of one block, and states that a model's automaton may have.
BLOCK, MOST_STATES = 1024, 4096
#: The symbol of text that is not blank.
TEXT = "#text"


class _Positions:
    """The places of names in a model, which of them may come first, last and after each other."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.follow: list[set[int]] = []

    def of(self, model: tuple) -> tuple[bool, set[int], set[int]]:
        """Whether the model may be empty, and its first and last places. model: (kind, quantifier, name, parts), as the parser gives it."""
        kind, times, name, parts = model
        if kind == expat.model.XML_CTYPE_EMPTY:
            return True, set(), set()
        if kind == expat.model.XML_CTYPE_NAME:
            empty, first = False, {self._place(name)}
            last = set(first)
        elif kind == expat.model.XML_CTYPE_SEQ:
            empty, first, last = True, set(), set()
            for part in parts:
                none, heads, tails = self.of(part)
                for p in last:
                    self.follow[p] |= heads
                first |= heads if empty else set()
                last = last | tails if none else tails
                empty = empty and none
        else:  # choice; mixed content is one of text and names, as often as wanted
            found = [self.of(part) for part in parts]
            if kind == expat.model.XML_CTYPE_MIXED:
                own = {self._place(TEXT)}
                found.append((True, own, own))
                times = expat.model.XML_CQUANT_REP
            empty = any(f[0] for f in found)
            first, last = set().union(*(f[1] for f in found)), set().union(*(f[2] for f in found))
        if times in (expat.model.XML_CQUANT_REP, expat.model.XML_CQUANT_PLUS):
            for p in last:
                self.follow[p] |= first
        return empty or times in (expat.model.XML_CQUANT_OPT, expat.model.XML_CQUANT_REP), first, last

    def _place(self, name: str) -> int:
        self.names.append(name)
        self.follow.append(set())
        return len(self.names) - 1


def automaton(model: tuple) -> dict:
    """symbols, table (rows of next states: the last column is for any other symbol), accepting. State 0 is the start, the last one is never left.

    States are sets of places, so a model in which one name may stand for two places is run exactly as well; one that needs
    more than MOST_STATES of them is refused.
    """
    places = _Positions()
    empty, first, last = places.of(model)
    symbols = sorted(set(places.names))
    states: dict[frozenset, int] = {}
    todo, table, accepting = [(first, empty)], [], [empty]
    while todo:
        reach, _ = todo.pop(0)
        row = []
        for name in symbols:
            now = frozenset(p for p in reach if places.names[p] == name)
            if now and now not in states:
                states[now] = len(states) + 1
                accepting.append(bool(now & last))
                todo.append((set().union(*(places.follow[p] for p in now)), False))
                if len(states) > MOST_STATES:
                    raise ValueError("a content model is too ambiguous")
            row.append(states[now] if now else -1)
        table.append([*row, -1])
    dead = len(table)
    table = [[dead if x < 0 else x for x in row] for row in table] + [[dead] * (len(symbols) + 1)]
    return {"symbols": symbols, "table": table, "accepting": [*accepting, False]}


def violations(nodes: DataFrame, declared: list[dict], key: str = "doc_id") -> DataFrame:
    """key, parent_pre, at, name: elements whose children do not match the declared model. `at` and `name` are the place among its siblings (ord) and the
    name of the first child after which nothing fits; null where the children only end too early.

    declared: element, any and content (see sources.xml.dtd_declarations). Comments, instructions and blank texts do not count.
    Children meet in blocks of BLOCK places among siblings, whatever their number; a block becomes the map from each state before it to the state
    after it, and an element's maps are followed in order, one number for each state and block. Elements that are not declared, and those that
    may hold anything, give no row.
    """
    spark = nodes.sparkSession
    made = [(d["element"], automaton(d["content"])) for d in declared if not d["any"]]
    names = sorted({s for _, m in made for s in m["symbols"]} - {TEXT})
    number = {s: i for i, s in enumerate([TEXT, *names])}
    rows = []
    for element, m in made:
        width = len(m["symbols"]) + 1
        local = [width - 1] * (len(number) + 1)
        for i, s in enumerate(m["symbols"]):
            local[number[s]] = i
        rows.append((element, width, [x for r in m["table"] for x in r], local, m["accepting"]))
    models = F.broadcast(spark.createDataFrame(rows, "element string, width int, table array<int>, local array<int>, accepting array<boolean>"))
    symbols = F.broadcast(spark.createDataFrame([(s, number[s]) for s in names], "qname string, symbol int"))
    own = [key, "parent_pre"]
    child = nodes.filter("kind IN ('element', 'text', 'cdata') AND parent_pre IS NOT NULL").filter("kind = 'element' OR trim(translate(value, '\\n\\r\\t', '   ')) <> ''")
    child = child.select(*own, "ord", F.when(F.col("kind") == "element", F.col("qname")).otherwise(TEXT).alias("qname"))
    symbol = F.when(F.col("qname") == TEXT, 0).otherwise(F.coalesce("symbol", F.lit(len(number))))
    block = F.floor(F.col("ord") / BLOCK).alias("block")
    blocks = child.join(symbols, "qname", "left").groupBy(*own, block).agg(F.array_sort(F.collect_list(F.struct("ord", symbol.alias("symbol"), "qname"))).alias("said"))
    owner = nodes.filter("kind = 'element'").select(key, F.col("pre").alias("parent_pre"), F.col("qname").alias("element")).join(models, "element")
    step = lambda state, x: F.get("table", state * F.col("width") + F.get("local", x["symbol"]))
    passed = F.transform(F.sequence(F.lit(0), F.size("accepting") - 1), lambda s: F.aggregate("said", s, step))
    maps = blocks.join(owner, own).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("block", passed.alias("to")))).alias("maps"))
    dead = F.size("accepting") - 1
    start = F.struct(F.lit(0).alias("state"), F.lit(None).cast("long").alias("block"), F.lit(0).alias("before"))
    follow = lambda a, x: F.when(a["state"] == dead, a).otherwise(F.struct(F.get(x["to"], a["state"]).alias("state"), x["block"].alias("block"), a["state"].alias("before")))
    ended = owner.join(maps, own, "left").withColumn("end", F.when(F.col("maps").isNull(), start).otherwise(F.aggregate("maps", start, follow)))
    bad = ended.filter(~F.get("accepting", F.col("end")["state"])).select(*own, "width", "table", "local", dead.alias("dead"), F.when(F.col("end")["state"] == dead, F.col("end")["block"]).alias("block"), F.col("end")["before"].alias("before"))
    none = F.struct(F.col("before").alias("state"), F.lit(None).cast(child.schema["ord"].dataType).alias("at"), F.lit(None).cast("string").alias("name"))
    seek = lambda a, x: F.when(a["state"] == F.col("dead"), a).otherwise(F.struct(step(a["state"], x).alias("state"), x["ord"].alias("at"), x["qname"].alias("name")))
    found = bad.join(blocks, [*own, "block"], "left").withColumn("stop", F.when(F.col("said").isNotNull(), F.aggregate("said", none, seek)))
    return found.select(*own, F.col("stop")["at"].alias("at"), F.col("stop")["name"].alias("name"))
