"""SOAP messages as rows: the action of an envelope, its typed parameters, envelopes of results and faults, and service descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import escape_xml
from ..functions.typed import to_xml, xml_schema

ENVELOPE = "http://schemas.xmlsoap.org/soap/envelope/"
_BODY = r"(?s)^\s*(?:<\?xml[^>]*>\s*)?<(?:[\w.-]+:)?Envelope[^>]*>.*?<(?:[\w.-]+:)?Body[^>]*>\s*(.*?)\s*</(?:[\w.-]+:)?Body>\s*</(?:[\w.-]+:)?Envelope>\s*$"


def action(message: Column) -> Column:
    """struct(name, xml) of the first element in an envelope's body: its name without a prefix, and its text as it stands; null where there is no envelope."""
    body = F.regexp_extract(message, _BODY, 1)
    name = F.regexp_extract(F.regexp_replace(body, r"^(?s:\s|<!--.*?-->|<\?.*?\?>)+", ""), r"^<(?:[\w.-]+:)?([\w.-]+)", 1)
    return F.when(name != "", F.struct(name.alias("name"), body.alias("xml")))


def parameters(message: Column, name: str, schema: str | T.StructType) -> Column:
    """The typed parameters of an action of that name; null for messages of other actions.

    The whole envelope is read as a tree whose names count without their prefixes, so texts and sections are what they are.
    """
    fields = schema if isinstance(schema, str) else schema.simpleString()
    shape = T.StructType.fromDDL(f"Body struct<`{name}`: {fields if fields.startswith('struct<') else T.StructType.fromDDL(fields).simpleString()}>")
    read = F.from_xml(message, shape.simpleString(), {"attributePrefix": "_", "ignoreNamespace": "true"})
    return F.when(action(message)["name"] == name, read["Body"][name])


def envelope(content: Column) -> Column:
    return F.concat(F.lit(f'<env:Envelope xmlns:env="{ENVELOPE}"><env:Body>'), content, F.lit("</env:Body></env:Envelope>"))


def response(name: str, result: Column, namespace: str) -> Column:
    """An envelope of the action's response with the fields of a struct."""
    inner = F.regexp_replace(to_xml(result, f"{name}Response"), f"^<{name}Response", f'<m:{name}Response xmlns:m="{namespace}"')
    return envelope(F.regexp_replace(inner, f"</{name}Response>$", f"</m:{name}Response>"))


def fault(message: Column, code: str = "env:Server") -> Column:
    """An envelope of a fault with a text."""
    return envelope(F.concat(F.lit(f"<env:Fault><faultcode>{code}</faultcode><faultstring>"), escape_xml(message), F.lit("</faultstring></env:Fault>")))


def describe(service: str, namespace: str, location: str, actions: dict[str, tuple[T.StructType, T.StructType]]) -> str:
    """A service description (WSDL text): types, messages, port and binding of each action's parameters and result."""
    types, messages, port, binding = [], [], [], []
    for name, (given, result) in actions.items():
        for suffix, kind in (("", given), ("Response", result)):
            types.append(xml_schema(kind, name + suffix).split("\n", 1)[1].rsplit("\n", 1)[0])
            messages.append(f'  <wsdl:message name="{name}{suffix}Message"><wsdl:part name="parameters" element="ns:{name}{suffix}"/></wsdl:message>')
        port.append(f'    <wsdl:operation name="{name}"><wsdl:input message="ns:{name}Message"/><wsdl:output message="ns:{name}ResponseMessage"/></wsdl:operation>')
        binding.append(f'    <wsdl:operation name="{name}"><soap:operation soapAction="" style="document"/><wsdl:input><soap:body use="literal"/></wsdl:input><wsdl:output><soap:body use="literal"/></wsdl:output></wsdl:operation>')
    lines = [
        f'<wsdl:definitions xmlns:wsdl="http://schemas.xmlsoap.org/wsdl/" xmlns:soap="http://schemas.xmlsoap.org/wsdl/soap/" xmlns:ns="{namespace}" targetNamespace="{namespace}">',
        f'<wsdl:types><xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" targetNamespace="{namespace}" elementFormDefault="qualified">', *types, "</xsd:schema></wsdl:types>", *messages,
        f'  <wsdl:portType name="{service}PortType">', *port, "  </wsdl:portType>", f'  <wsdl:binding name="{service}" type="ns:{service}PortType">', '    <soap:binding style="document" transport="http://schemas.xmlsoap.org/soap/http"/>', *binding, "  </wsdl:binding>",
        f'  <wsdl:service name="{service}"><wsdl:port name="{service}" binding="ns:{service}"><soap:address location="{location}"/></wsdl:port></wsdl:service>', "</wsdl:definitions>",
    ]
    return "\n".join(lines)
