"""Mount tables as data: requests find the first mount that takes them by the literal beginnings of paths, an equi-join, and not by trying every pattern."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import from_text
from ..functions.uri import glob_pattern, url_decode

_WILD = re.compile(r"[*?{};]")
_COMPILED = "array<struct<depth: int, prefix: string, pattern: string, names: array<string>, glob: boolean>>"


def _ways(kind: str, path: str) -> list[dict]:
    """What a mount's path is searched by: the segments before its first wildcard, and a pattern. A glob's alternatives are ways of their own."""
    out = []
    for one in path.split(";") if kind == "glob" else [path]:
        segments = one.lstrip("/").split("/")
        wild = next((i for i, s in enumerate(segments) if _WILD.search(s)), len(segments))
        if kind == "glob" and one.endswith("/") and wild == len(segments):
            wild -= 1  # all below
        names = re.findall(r"\{(\w+)\}", one) if kind != "glob" else []
        pattern = glob_pattern(one) if kind == "glob" else "^/?" + re.sub(r"\\\{\w+\\\}", "([^/]+)", re.escape(one.lstrip("/"))) + "$"
        out.append({"depth": wild, "prefix": "/".join(segments[:wild]).lower(), "pattern": pattern, "names": names, "glob": kind == "glob"})
    return out


def _compiled(kind: str, path: str) -> Column:
    shape = pa.list_(pa.struct([("depth", pa.int32()), ("prefix", pa.string()), ("pattern", pa.string()), ("names", pa.list_(pa.string())), ("glob", pa.bool_())]))

    @F.arrow_udf(_COMPILED)
    def run(kinds: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([[] if p is None else _ways(k or "path", p) for k, p in zip(kinds.to_pylist(), paths.to_pylist(), strict=True)], shape)

    return run(kind, path)


def dispatch(requests: DataFrame, mounts: DataFrame, path: str = "path", method: str = "method") -> DataFrame:
    """Each request with its mount: mount_no (null where none takes it) and parameters (map of decoded texts), besides its own columns.

    mounts: mount_no, method (null for any), kind ('path' or 'glob') and path. A path may hold {names}, each for one segment; it takes requests of its method, and OPTIONS. Paths
    come first, in order of mount_no, then globs, which also take HEAD. Repeated requests are rows of their own; null paths find nothing.

    Each different path and method is looked up once. It meets the mounts whose literal beginning is one of its own beginnings, of the lengths that occur among the mounts, so
    work grows with the mounts that may match and not with all. Neither side is broadcast by force.
    """
    ways = mounts.select("mount_no", F.col("method").alias("_takes"), F.explode(_compiled("kind", "path")).alias("_w")).select("mount_no", "_takes", "_w.*")
    depths = sorted(r[0] for r in ways.select("depth").distinct().collect())
    each = requests.select(F.col(path).alias("_path"), F.col(method).alias("_method")).filter("_path IS NOT NULL").distinct()
    own = F.split(F.lower(F.regexp_replace("_path", "^/", "")), "/")
    begins = F.transform(F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda d: d <= F.size(own)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(own, F.lit(1), d), "/").alias("prefix")))
    met = each.select("_path", "_method", F.explode(begins).alias("_b")).select("_path", "_method", "_b.*").join(ways, ["depth", "prefix"])
    takes = F.col("_takes").isNull() | (F.col("_method") == F.col("_takes")) | (F.col("_method") == "OPTIONS") | (F.col("glob") & (F.col("_method") == "HEAD"))
    hit = met.filter(takes).filter(F.regexp_like("_path", F.col("pattern")))
    best = hit.groupBy("_path", "_method").agg(F.min_by(F.struct("mount_no", "pattern", "names"), F.struct("glob", "mount_no")).alias("_m"))
    value = F.transform(F.col("_m.names"), lambda n, i: F.struct(n.alias("key"), url_decode(F.call_function("regexp_extract", F.col("_path"), F.col("_m.pattern"), i + 1)).alias("value")))
    found = best.select("_path", F.col("_method").alias("_by"), F.col("_m.mount_no").alias("mount_no"), F.map_from_entries(value).alias("parameters"))
    return requests.join(found, (F.col(path) == F.col("_path")) & F.col(method).eqNullSafe(F.col("_by")), "left").drop("_path", "_by")


def bind(values: Column, schema: str | T.StructType, enums: dict[str, dict[int, str]] | None = None) -> Column:
    """A struct of typed arguments from a map of texts: scalars by their XML Schema forms, structs, arrays and maps from JSON, enums by name; null where a text is none or missing.

    enums: for a field of whole numbers, the names of its numbers.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    names = {T.BooleanType: "xsd:boolean", T.TimestampType: "xsd:dateTime", T.DateType: "xsd:date"}

    def one(f: T.StructField) -> Column:
        text = F.try_element_at(values, F.lit(f.name))
        if f.name in (enums or {}):
            known = F.create_map(*[F.lit(x) for k, v in enums[f.name].items() for x in (v, k)])
            return F.try_element_at(known, text).cast(f.dataType)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.from_json(text, f.dataType if not isinstance(f.dataType, T.StructType) else f.dataType.simpleString())
        if isinstance(f.dataType, T.StringType):
            return text
        return from_text(text, names[type(f.dataType)]) if type(f.dataType) in names else F.trim(text).try_cast(f.dataType)

    return F.struct(*[one(f).alias(f.name) for f in fields])
