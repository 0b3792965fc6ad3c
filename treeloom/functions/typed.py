"""Typed conversion of text and schemas: scalar types, enums, dates, XML and JSON, XML Schema text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: XML Schema names of scalar types, and the types they are read as.
XSD = {"xsd:boolean": "boolean", "xsd:string": "string", "xsd:byte": "tinyint", "xsd:unsignedByte": "smallint", "xsd:short": "smallint", "xsd:unsignedShort": "int", "xsd:int": "int", "xsd:unsignedInt": "bigint", "xsd:long": "bigint", "xsd:unsignedLong": "decimal(20,0)", "xsd:float": "float", "xsd:double": "double", "xsd:date": "date", "xsd:dateTime": "timestamp"}
_NAMES = {T.BooleanType: "xsd:boolean", T.StringType: "xsd:string", T.ByteType: "xsd:byte", T.ShortType: "xsd:short", T.IntegerType: "xsd:int", T.LongType: "xsd:long", T.FloatType: "xsd:float", T.DoubleType: "xsd:double", T.DateType: "xsd:date", T.TimestampType: "xsd:dateTime", T.DecimalType: "xsd:decimal"}


def from_text(text: Column, name: str) -> Column:
    """A value of an XML Schema type, null where the text is none."""
    kind = XSD[name]
    if kind == "timestamp":
        return F.try_to_timestamp(F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(?=$|Z|[+-])", "$1:00"))
    if kind == "boolean":
        return text.isin("true", "1", "yes")
    return F.trim(text).try_cast(kind)


def to_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(value, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z"))
    return value.cast("string")


def enum_name(value: Column, names: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value)


def enum_value(name: Column, names: dict[int, str], default: int = 0) -> Column:
    """The number of a name; unknown names give the default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (v, k)]), name), F.lit(default))


def to_xml(struct: Column, root: str) -> Column:
    """One line of XML; fields whose name begins with '_' are attributes, arrays are repeated elements, nulls are left out."""
    return F.regexp_replace(F.to_xml(struct, {"rowTag": root, "attributePrefix": "_"}), r">\s*\n\s*<", "><")


def from_xml(xml: Column, schema: str | T.StructType, root: str | None = None) -> Column:
    """A struct of an XML text; with root, null where the document's element has another name."""
    out = F.from_xml(xml, schema if isinstance(schema, str) else schema.simpleString(), {"attributePrefix": "_"})
    return out if root is None else F.when(F.regexp_like(xml, F.lit(rf"^\s*(?:<\?[^>]*>\s*)*<{root}[\s/>]")), out)


def to_json(struct: Column) -> Column:
    return F.to_json(struct)


def from_json(text: Column, schema: str, defaults: dict[str, Column] | None = None) -> Column:
    """A struct of a JSON text; members that are missing or null take their default."""
    out = F.from_json(text, schema)
    for name, value in (defaults or {}).items():
        out = out.withField(name, F.coalesce(out[name], value))
    return out


def xml_schema(kind: T.StructType, root: str) -> str:
    """XML Schema text of a struct type."""
    types: list[str] = []

    def named(t: T.DataType, name: str) -> str:
        if isinstance(t, T.StructType):
            define(t, name)
            return name
        return _NAMES[type(t)]

    def define(t: T.StructType, name: str) -> None:
        lines, attrs = [], []
        for f in t.fields:
            many = isinstance(f.dataType, T.ArrayType)
            inner = f.dataType.elementType if many else f.dataType
            if f.name.startswith("_"):
                attrs.append(f'    <xsd:attribute name="{f.name[1:]}" type="{named(inner, f.name[1:])}"/>')
            else:
                least = ' minOccurs="0"' if many or f.nullable else ""
                lines.append(f'      <xsd:element name="{f.name}" type="{named(inner, f.name)}"{least}{" maxOccurs=" + chr(34) + "unbounded" + chr(34) if many else ""}/>')
        types.append(f'  <xsd:complexType name="{name}">\n    <xsd:sequence>\n' + "\n".join(lines) + "\n    </xsd:sequence>\n" + "".join(a + "\n" for a in attrs) + "  </xsd:complexType>")

    define(kind, root)
    return '<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema">\n' + "\n".join(reversed(types)) + f'\n  <xsd:element name="{root}" type="{root}"/>\n</xsd:schema>'


def schema_of(df: DataFrame, root: str) -> str:
    return xml_schema(df.schema, root)
