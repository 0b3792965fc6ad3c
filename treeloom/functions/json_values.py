"""A dynamic JSON value algebra over VARIANT columns: truth, order, arithmetic, access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """A VARIANT, null where the text is not JSON (leading zeros, trailing text)."""
    return F.try_parse_json(text)


def to_text(v: Column) -> Column:
    """JSON text with sorted keys."""
    return F.to_json(v)


def to_safe_text(v: Column) -> Column:
    """JSON text as it may stand in a script: keys sorted, each slash escaped."""
    return F.replace(F.to_json(v), F.lit("/"), F.lit("\\/"))


def number(value: Column) -> Column:
    """A VARIANT of a number, null where it is none that JSON has: not a number, infinite, or too small for its full precision."""
    v = value.cast("double")
    plain = ~F.isnan(v) & (F.abs(v) < float("inf")) & ((v == 0) | (F.abs(v) >= 2.2250738585072014e-308))
    return F.when(plain, F.try_variant_get(F.to_variant_object(F.array(value)), "$[0]", "variant"))


def of(value: Column) -> Column:
    """A VARIANT of a column of any type; structs and maps become objects."""
    return F.to_variant_object(value)


def type_name(v: Column) -> Column:
    """null, object, array, string, boolean, integer or float."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "null")
        .when(F.startswith(kind, F.lit("OBJECT")), "object")
        .when(F.startswith(kind, F.lit("ARRAY")), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .otherwise("float")
    )


def get(v: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path ($.key, $[i]); null where there is none or it is of another kind."""
    return F.try_variant_get(v, path, kind)


def is_number(v: Column) -> Column:
    return type_name(v).isin("integer", "float")


def _long(v: Column) -> Column:
    return F.try_variant_get(v, "$", "bigint")


def _double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def truth(v: Column) -> Column:
    """null, false, 0, '' and empty arrays and objects are false."""
    t = type_name(v)
    return (
        F.when(t == "null", False)
        .when(t == "boolean", F.try_variant_get(v, "$", "boolean"))
        .when(t.isin("integer", "float"), _double(v) != 0)
        .when(t == "string", _string(v) != "")
        .otherwise(size(v) > 0)
    )


def size(v: Column) -> Column:
    """Members of an array or object; 0 for null, 1 for other scalars."""
    t = type_name(v)
    return F.when(t == "null", 0).when(t == "array", F.size(F.try_variant_get(v, "$", "array<variant>"))).when(t == "object", F.size(F.try_variant_get(v, "$", "map<string,variant>"))).otherwise(1)


def sort_key(v: Column) -> Column:
    """A struct that orders values: null, boolean, number, object, array, string; then by value."""
    t = type_name(v)
    rank = F.when(t == "null", 0).when(t == "boolean", 1).when(t.isin("integer", "float"), 2).when(t == "object", 3).when(t == "array", 4).otherwise(5)
    number = F.when(t.isin("integer", "float"), _double(v)).when(t == "boolean", F.try_variant_get(v, "$", "boolean").cast("double"))
    return F.struct(rank.alias("rank"), number.alias("number"), F.when(t == "string", _string(v)).when(t.isin("object", "array"), F.to_json(v)).alias("text"))


def equals(a: Column, b: Column) -> Column:
    return sort_key(a) == sort_key(b)


def less(a: Column, b: Column) -> Column:
    return sort_key(a) < sort_key(b)


def _both(a: Column, b: Column, on_long, on_double, on_string=None) -> Column:
    """Arithmetic by types: the left operand's type decides; null is neutral for on_string's operator."""
    ta, tb = type_name(a), type_name(b)
    left_long = (ta == "integer") & tb.isin("integer", "float")
    truncated = F.when(tb == "integer", _long(b)).otherwise(F.try_variant_get(b, "$", "double").try_cast("bigint"))
    out = F.when(left_long, F.to_json(F.struct(on_long(_long(a), truncated).alias("x"))))
    out = out.when((ta == "float") & tb.isin("integer", "float"), F.to_json(F.struct(on_double(_double(a), _double(b)).alias("x"))))
    if on_string is not None:
        out = out.when((ta == "string") & (tb == "string"), F.to_json(F.struct(on_string(_string(a), _string(b)).alias("x"))))
    found = F.try_variant_get(F.try_parse_json(out), "$.x", "variant")
    return F.when(tb == "null", a).when(ta == "null", b).otherwise(found) if on_string is not None else found


def add(a: Column, b: Column) -> Column:
    """Numbers added, strings joined, null neutral; integer + float stays integer. What leaves 64 bits gives null, here and below."""
    return _both(a, b, F.try_add, lambda x, y: x + y, lambda x, y: F.concat(x, y))


def subtract(a: Column, b: Column) -> Column:
    return _both(a, b, F.try_subtract, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _both(a, b, F.try_multiply, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Integers divide towards zero; division by zero gives null."""
    whole = lambda x, y: F.try_divide((x - F.try_mod(x, y)).cast("decimal(20,0)"), y.cast("decimal(19,0)")).try_cast("bigint")
    return _both(a, b, whole, lambda x, y: F.try_divide(x, y))


def modulo(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: F.try_mod(x, y), lambda x, y: F.lit(None).cast("double"))


def contains(v: Column, key: Column) -> Column:
    """Whether an object has the key, or an array the string."""
    t = type_name(v)
    return F.when(t == "object", F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), key)).when(t == "array", F.array_contains(F.try_variant_get(v, "$", "array<string>"), key)).otherwise(False)


_LIST, _MAP = "array<variant>", "map<string,variant>"


def _value(c: Column) -> Column:
    """A VARIANT of a scalar column."""
    return F.try_variant_get(F.to_variant_object(F.struct(c.alias("x"))), "$.x", "variant")


def of_list(v: Column) -> Column:
    """The members of an array; of null, none."""
    return F.coalesce(F.try_variant_get(v, "$", _LIST), F.array().cast(_LIST))


def of_map(v: Column) -> Column:
    """The members of an object; of null, none."""
    return F.coalesce(F.try_variant_get(v, "$", _MAP), F.create_map().cast(_MAP))


def at(v: Column, index: Column) -> Column:
    """The array's member at a place from 0; null beyond."""
    return F.get(of_list(v), index)


def clear(v: Column) -> Column:
    """The empty value of the same kind: [], {}, '', 0, 0.0, false; null stays."""
    out = F.when(type_name(v) == "null", v)
    for kind, text in (("array", "[]"), ("object", "{}"), ("string", '""'), ("integer", "0"), ("boolean", "false")):
        out = out.when(type_name(v) == kind, F.parse_json(F.lit(text)))
    return out.otherwise(_value(F.lit(0.0)))


def push_back(v: Column, x: Column) -> Column:
    """The array (or null, an empty one) with a member more; null for other values."""
    return F.when(type_name(v).isin("array", "null"), F.to_variant_object(F.concat(of_list(v), F.array(x))))


def insert_at(v: Column, index: Column, x: Column) -> Column:
    """The array with a member put in before a place from 0, or behind the last."""
    listed = of_list(v)
    i = F.least(index, F.size(listed))
    return F.when(type_name(v).isin("array", "null"), F.to_variant_object(F.concat(F.slice(listed, F.lit(1), i), F.array(x), F.slice(listed, i + 1, F.size(listed)))))


def put_at(v: Column, index: Column, x: Column) -> Column:
    """The array (or null, an empty one) with that member at a place from 0; an array that is too short grows by nulls. Null for other values and places below 0."""
    listed = of_list(v)
    none = F.parse_json(F.lit("null"))
    grown = F.concat(listed, F.when(index >= F.size(listed), F.array_repeat(none, index - F.size(listed) + 1)).otherwise(F.array().cast(_LIST)))
    return F.when(type_name(v).isin("array", "null") & (index >= 0), F.to_variant_object(F.transform(grown, lambda y, i: F.when(i == index, x).otherwise(y))))


def erase_range(v: Column, begin: Column, end: Column) -> Column:
    """The array without the members from a place up to before another one."""
    return F.when(type_name(v) == "array", F.to_variant_object(F.filter(of_list(v), lambda x, i: (i < begin) | (i >= end))))


def has_member(v: Column, x: Column) -> Column:
    """Whether an array has a member that equals a value of any kind."""
    keys = F.transform(F.array(x), sort_key)  # worked out once, not for each member
    return (type_name(v) == "array") & F.exists(keys, lambda k: F.exists(of_list(v), lambda y: sort_key(y) == k))


def erase_at(v: Column, index: Column) -> Column:
    """The array without the member at a place from 0."""
    return F.when(type_name(v) == "array", F.to_variant_object(F.filter(of_list(v), lambda x, i: i != index)))


def emplace(v: Column, key: Column, x: Column) -> Column:
    """The object (or null, an empty one) with a member more, unless it has that key."""
    own = of_map(v)
    more = F.when(F.map_contains_key(own, key), own).otherwise(F.map_concat(own, F.create_map(key, x)))
    return F.when(type_name(v).isin("object", "null"), F.to_variant_object(more))


def put(v: Column, key: Column, x: Column) -> Column:
    """The object with that member set."""
    return F.when(type_name(v).isin("object", "null"), F.to_variant_object(F.map_concat(F.map_filter(of_map(v), lambda k, _: k != key), F.create_map(key, x))))


def erase_key(v: Column, key: Column) -> Column:
    return F.when(type_name(v) == "object", F.to_variant_object(F.map_filter(of_map(v), lambda k, _: k != key)))


def items(v: Column) -> Column:
    """array<struct<key, value>> of an object in order of keys, or of an array with places as keys."""
    entries = F.array_sort(F.transform(F.map_keys(of_map(v)), lambda k: k))
    of_object = F.transform(entries, lambda k: F.struct(k.alias("key"), F.element_at(of_map(v), k).alias("value")))
    return F.when(type_name(v) == "object", of_object).otherwise(F.transform(of_list(v), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))))


def negate(v: Column) -> Column:
    """The number with its sign turned; null for other values."""
    return F.when(type_name(v) == "integer", _value(F.try_subtract(F.lit(0).cast("bigint"), _long(v)))).when(type_name(v) == "float", _value(-_double(v)))


def extract(v: Column, kind: str, default: Column) -> Column:
    """A typed value, the default for null or missing; null where the value is of another kind."""
    return F.when(type_name(v) == "null", default).otherwise(F.try_variant_get(v, "$", kind))
