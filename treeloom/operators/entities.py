"""Entities and notations of document types as rows, and what entities expand to, found before any is expanded."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.xml import written

DECLARED = "kind string, name string, value string, system string, public string, notation string"
_REFERENCE = r"&([^\s&;#][^\s&;]*);"
#: Those that every document knows.
PREDEFINED = ("lt", "gt", "amp", "quot", "apos")


class _Enough(Exception):
    """The document type has been read."""


def declarations(xml: str) -> list[tuple]:
    """(kind, name, value, system, public, notation) of the general and parameter entities and the notations that an internal subset declares, the first
    of one name; of a subset that is not well-formed, those before the error."""
    out: dict[tuple[str, str], tuple] = {}

    def add(kind: str, name: str, *rest) -> None:
        out.setdefault((kind, name), (kind, name, *rest))

    def entity(name, parameter, value, base, system, public, notation) -> None:
        add("parameter" if parameter else "unparsed" if notation else "general", name, value, system, public, notation)

    def enough(*_) -> None:
        raise _Enough

    p = expat.ParserCreate()
    p.EntityDeclHandler = entity
    p.NotationDeclHandler = lambda name, base, system, public: add("notation", name, None, system, public, None)
    p.StartElementHandler = enough
    try:
        p.Parse(xml, True)
    except (_Enough, expat.ExpatError):
        pass
    return list(out.values())


def declared(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """key, kind (general, parameter, unparsed, notation), name, value, system, public, notation: a row for each declaration of a document's type. Documents without one give none."""
    kind = dict(docs.dtypes)[key]
    names = [c.split()[0] for c in DECLARED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *d) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for d in declarations(text)]
            columns = [pa.array([r[0] for r in rows], b.schema.field(0).type), *(pa.array([r[i + 1] for r in rows], pa.string()) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays(columns, [key, *names])

    return docs.filter(F.contains(xml, F.lit("<!DOCTYPE"))).select(key, xml).mapInArrow(run, f"`{key}` {kind}, {DECLARED}")


def expanded(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, cyclic, size: for each general entity with a value, whether it reaches itself or one that does, and the characters that it expands to (double; null where cyclic).

    The references among entities are a graph with a number of times on each edge. Its paths are counted by doubling: after k rounds all paths of up
    to 2^k edges are known, so a chain of n entities takes log n rounds of joins. What still has longer paths than there are entities lies
    on or before a cycle. References to entities that are not declared, to external and to predefined ones count as they stand.
    """
    own = written(entities.filter("kind = 'general' AND value IS NOT NULL").select(key, "name", "value"), key)
    names = own.select(key, F.col("name").alias("to"))
    refs = own.select(key, F.col("name").alias("from"), F.explode(F.regexp_extract_all("value", F.lit(_REFERENCE), 1)).alias("to"))
    edges = refs.join(names, [key, "to"]).groupBy(key, "from", "to").agg(F.count("*").cast("double").alias("times"), F.sum(F.length("to") + 2).alias("chars"))
    edges = written(edges, key)
    spelt = edges.groupBy(key, F.col("from").alias("name")).agg(F.sum("chars").alias("_spelt"))
    plain = written(own.join(spelt, [key, "name"], "left").select(key, "name", (F.length("value") - F.coalesce("_spelt", F.lit(0))).cast("double").alias("chars")), key)
    paths = edges.select(key, "from", "to", "times")  # of 1 to 2^k edges
    ahead, reach = paths, 1  # of exactly 2^k edges
    most = own.groupBy(key).count().agg(F.max("count")).first()[0] or 0

    def through(a: DataFrame, b: DataFrame) -> DataFrame:
        joined = a.select(key, "from", F.col("to").alias("_mid"), F.col("times").alias("_t")).join(b.select(key, F.col("from").alias("_mid"), "to", "times"), [key, "_mid"])
        return joined.groupBy(key, "from", "to").agg(F.sum(F.col("_t") * F.col("times")).alias("times"))

    while reach <= most and not ahead.isEmpty():
        more = through(ahead, paths)
        paths = written(paths.unionByName(more).groupBy(key, "from", "to").agg(F.sum("times").alias("times")), key)
        ahead = written(through(ahead, ahead), key)
        reach *= 2
    cyclic = ahead.select(key, F.col("from").alias("name")).distinct().withColumn("cyclic", F.lit(True))
    inside = paths.join(plain.select(key, F.col("name").alias("to"), "chars"), [key, "to"]).groupBy(key, F.col("from").alias("name")).agg(F.sum(F.col("times") * F.col("chars")).alias("_inside"))
    out = plain.join(cyclic, [key, "name"], "left").join(inside, [key, "name"], "left")
    size = F.when(F.col("cyclic").isNull(), F.col("chars") + F.coalesce("_inside", F.lit(0.0)))
    return out.select(key, "name", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), size.alias("size"))


def problems(docs: DataFrame, key: str = "doc_id", xml: str = "xml", limit: float = 10_000_000) -> DataFrame:
    """key, problem, name: entities that reach themselves or expand beyond `limit` characters, references in values to entities that are not declared, and unparsed entities of undeclared notations."""
    rows = written(declared(docs, key, xml), key)
    sizes = expanded(rows, key)
    what = F.when(F.col("cyclic"), "recursion").when(F.col("size") > limit, "too long")
    found = sizes.select(key, what.alias("problem"), "name").filter("problem IS NOT NULL")
    known = rows.filter("kind IN ('general', 'unparsed')").select(key, "name")
    refs = rows.filter("kind = 'general' AND value IS NOT NULL").select(key, F.explode(F.regexp_extract_all("value", F.lit(_REFERENCE), 1)).alias("name")).filter(~F.col("name").isin(*PREDEFINED)).distinct()
    lost = refs.join(known, [key, "name"], "left_anti").select(key, F.lit("undeclared entity").alias("problem"), "name")
    notes = rows.filter("kind = 'notation'").select(key, F.col("name").alias("notation"))
    bare = rows.filter("kind = 'unparsed'").join(notes, [key, "notation"], "left_anti").select(key, F.lit("undeclared notation").alias("problem"), "name")
    return found.unionByName(lost).unionByName(bare)
