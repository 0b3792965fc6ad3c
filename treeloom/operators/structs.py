"""Typed structs put together from the node table, level by level of a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import from_text
from ..sources.xml import spread

_NAMES = {T.BooleanType: "xsd:boolean", T.TimestampType: "xsd:dateTime", T.DateType: "xsd:date"}


def _scalar(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    return from_text(text, _NAMES[type(kind)]) if type(kind) in _NAMES else F.trim(text).try_cast(kind)


def assemble(nodes: DataFrame, targets: DataFrame, schema: str | T.StructType, key: str = "doc_id", defaults: dict[str, object] | None = None) -> DataFrame:
    """key, pre, value: a struct of the schema for each target element (key, pre), from its attributes (fields whose names begin with '_') and child elements by local name.

    Arrays take all children of the name in order (none: an empty array), other fields the first; scalars are read by their XML Schema
    forms, null where a text is none. defaults: values of missing fields, by dotted name. The node table needs elements' texts
    (str_value). The plan follows the schema: one join of children with parents for each struct in it, whatever the data; a parent's
    children of one name meet in one row, as the result does.
    """
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _structs(nodes, targets.select(key, "pre").distinct(), shape, key, defaults or {}, "")


def _structs(nodes: DataFrame, targets: DataFrame, shape: T.StructType, key: str, defaults: dict[str, object], at: str) -> DataFrame:
    own = [key, "parent_pre"]
    below = spread(nodes.filter("kind IN ('element', 'attribute')").join(targets.select(key, F.col("pre").alias("parent_pre")), own, "left_semi"))
    below = below.withColumn("_name", F.when(F.col("kind") == "attribute", F.concat(F.lit("_"), "local")).otherwise(F.col("local")))
    out, fields, flat = targets, [], []
    for i, f in enumerate(shape.fields):
        several = isinstance(f.dataType, T.ArrayType)
        kind = f.dataType.elementType if several else f.dataType
        if isinstance(kind, T.StructType):
            mine = below.filter(F.col("_name") == f.name).select(key, "pre", "parent_pre")
            values = _structs(nodes, mine.select(key, "pre"), kind, key, defaults, f"{at}{f.name}.").join(mine, [key, "pre"])
            made = F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]) if several else F.min_by("value", "pre")
            out = out.join(values.groupBy(key, F.col("parent_pre").alias("pre")).agg(made.alias(f"_f{i}")), [key, "pre"], "left")
        else:
            flat.append((i, f.name, several, kind))
        fields.append((f, several))
    if flat:
        mine = below.filter(F.col("_name").isin(*[n for _, n, _, _ in flat]))
        found = []
        for i, name, several, kind in flat:
            here = F.col("_name") == name
            if several:
                said = F.array_sort(F.collect_list(F.when(here, F.struct("pre", F.coalesce("str_value", F.lit("")).alias("s")))))
                found.append(_each(said, kind).alias(f"_f{i}"))
            else:
                found.append(_scalar(F.min_by(F.coalesce("str_value", F.lit("")), F.when(here, F.col("pre"))), kind).alias(f"_f{i}"))
        out = out.join(mine.groupBy(key, F.col("parent_pre").alias("pre")).agg(*found), [key, "pre"], "left")
    values = []
    for i, (f, several) in enumerate(fields):
        c = F.col(f"_f{i}")
        if several:
            c = F.coalesce(c, F.array().cast(f.dataType))
        if (name := f"{at}{f.name}") in defaults:
            c = F.coalesce(c, F.lit(defaults[name]).cast(f.dataType))
        values.append(c.alias(f.name))
    return out.select(key, "pre", F.struct(*values).alias("value"))


def _each(said: Column, kind: T.DataType) -> Column:
    return F.transform(said, lambda x: _scalar(x["s"], kind))
