"""Requests as rows: parsing, parameters, routing, access rules, tokens, negotiation, replies and log lines."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import base64url, hmac, unbase64url
from ..functions.strings import as_text
from ..functions.uri import glob_pattern, query_parameters
from .messages import METHODS, multipart, parse_reply, parse_request, unchunk  # noqa: F401
from .mounts import dispatch

#: Standard reason phrases.
REASONS = {200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 300: "Multiple Choices", 301: "Moved Permanently", 302: "Moved Temporarily", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method not allowed", 415: "Unsupported Media Type", 422: "Unprocessable Entity", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable"}


def chunk(body: Column, size: int = 10240) -> Column:
    """A body (text or bytes) as the bytes of chunks of at most `size` bytes, wherever that divides characters; sizes are in hex, the last chunk is empty."""
    n = F.ceil(F.octet_length(body) / size).cast("int")
    raw = F.decode(body.cast("binary"), "ISO-8859-1")  # a character for each byte
    one = lambda i: F.substring(raw, i * size + 1, F.lit(size))
    parts = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lower(F.hex(F.length(one(i)))), F.lit("\r\n"), one(i), F.lit("\r\n")))
    return F.encode(F.concat(F.array_join(parts, ""), F.lit("0\r\n\r\n")), "ISO-8859-1")


def result_reply(value: Column, error: Column) -> Column:
    """struct(status, body) of a call: its value as JSON, or 500 and its error."""
    return F.when(error.isNull(), F.struct(F.lit(200).alias("status"), F.to_json(value).alias("body"))).otherwise(F.struct(F.lit(500).alias("status"), F.to_json(F.struct(error.alias("error"))).alias("body")))


def error_page(status: Column, message: Column, uri: Column, username: Column) -> Column:
    """The model of an error page: nr, head, message, uri, username."""
    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.struct(status.alias("nr"), F.coalesce(F.try_element_at(reasons, status), F.lit("Error")).alias("head"), message.alias("message"), uri.alias("uri"), username.alias("username"))


def first_accepting(*handlers: tuple[Column, Column]) -> Column:
    """The reply of the first (accepts, reply) whose condition holds; null if none does."""
    out = F.when(F.lit(False), handlers[0][1])
    for accepts, said in handlers:
        out = out.when(F.coalesce(accepts, F.lit(False)), said)
    return out


def safe_redirect(target: Column) -> Column:
    """Where a login may lead to: the target without scheme and authority; '/' where nothing else is left."""
    local = F.regexp_replace(target, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?:[/\\\\]{2,}[^/?#]*)?", "")
    return F.when(F.startswith(local, F.lit("/")), local).otherwise(F.concat(F.lit("/"), local))


#: Types of files by the end of their name.
MIME = {"html": "text/html", "xhtml": "application/xhtml+xml", "css": "text/css", "js": "text/javascript", "json": "application/json", "xml": "text/xml", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "txt": "text/plain"}


def mime_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))), F.lit("text/plain"))


def header(headers: Column, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())), F.lit(0))


def cookie(line: Column, name: str) -> Column:
    """The first cookie of that name in a Cookie header."""
    parts = F.transform(F.split(line, ";"), lambda x: F.trim(x))
    found = F.filter(parts, lambda x: F.startswith(x, F.lit(f"{name}=")))
    first = F.get(found, F.lit(0))
    return F.substring(first, F.lit(len(name) + 2), F.length(first))


def set_cookie(line: Column, name: str, value: Column) -> Column:
    """A Cookie header with that cookie's value, put in place of an old one or behind the others."""
    parts = F.filter(F.transform(F.split(F.coalesce(line, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    new, own = F.concat(F.lit(f"{name}="), value), lambda x: F.startswith(x, F.lit(f"{name}="))
    kept = F.transform(parts, lambda x: F.when(own(x), new).otherwise(x))
    return F.array_join(F.when(F.exists(parts, own), kept).otherwise(F.concat(parts, F.array(new))), "; ")


def set_header(headers: Column, name: str, value: Column) -> Column:
    """Headers with that one set, whatever the case of its name."""
    return F.map_concat(remove_header(headers, name), F.create_map(F.lit(name), value))


def remove_header(headers: Column, name: str) -> Column:
    return F.map_filter(headers, lambda k, v: F.lower(k) != name.lower())


def parameter(query: Column, form: Column, json_body: Column, name: str, parts: Column | None = None) -> Column:
    """A parameter's value: the form's first, then the query's, then the JSON body's member, then the multipart form's part (see multipart) as text.

    A name may hold any characters; a body that is no JSON object has no members, a part that is not UTF-8 no text.
    """
    pick = lambda q: F.get(F.filter(query_parameters(q), lambda p: p["name"] == name), F.lit(0))["value"]
    found = [pick(form), pick(query), F.try_element_at(F.from_json(json_body, "map<string,string>"), F.lit(name))]
    if parts is not None:
        found.append(as_text(F.get(F.filter(parts, lambda p: p["name"] == name), F.lit(0))["data"]))
    return F.coalesce(*found)


def route(path: Column, routes: list[tuple[str, str]]) -> Column:
    """struct(route, parameters map) of the first (template, name) whose template matches; {x} stands for one path segment."""
    out = None
    for template, name in routes:
        names = re.findall(r"\{(\w+)\}", template)
        pattern = "^/?" + re.sub(r"\\\{\w+\\\}", "([^/]+)", re.escape(template.lstrip("/"))) + "$"
        args = [x for i, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(path, pattern, i + 1))]
        hit = F.struct(F.lit(name).alias("route"), (F.create_map(*args) if args else F.create_map().cast("map<string,string>")).alias("parameters"))
        out = F.when(F.regexp_like(path, F.lit(pattern)), hit) if out is None else out.when(F.regexp_like(path, F.lit(pattern)), hit)
    return out


def first_glob(path: Column, globs: list[tuple[str, str]]) -> Column:
    """The name of the first (glob, name) that matches; null if none does."""
    out = F.when(F.lit(False), F.lit(""))
    for g, name in globs:
        out = out.when(F.regexp_like(path, F.lit(glob_pattern(g))), F.lit(name))
    return out


def access(path: Column, roles: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Whether the first rule whose glob matches names one of the roles, or no role at all; without a rule, false."""
    out = F.when(F.lit(False), F.lit(False))
    for g, allowed in rules:
        ok = F.arrays_overlap(roles, F.array(*map(F.lit, allowed))) if allowed else F.lit(True)
        out = out.when(F.regexp_like(path, F.lit(glob_pattern(g))), F.coalesce(ok, F.lit(False)))
    return out.otherwise(F.lit(False))


def rule_join(requests: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Each request with the columns of its first matching rule, null where none matches. rules: rule_no, glob, and any other columns; see mounts.dispatch."""
    globs = rules.select(F.col("rule_no").alias("mount_no"), F.lit(None).cast("string").alias("method"), F.lit("glob").alias("kind"), F.col("glob").alias("path"))
    found = dispatch(requests.withColumn("_any", F.lit("GET")), globs, path, "_any").drop("_any", "parameters").withColumnRenamed("mount_no", "rule_no")
    return found.join(rules, "rule_no", "left")


def issue_token(claims: Column, secret: Column) -> Column:
    """A signed token (HS256) of a JSON text of claims."""
    head = F.lit(json.dumps({"alg": "HS256", "typ": "JWT"}, separators=(",", ":")))
    signed = F.concat(base64url(F.encode(head, "UTF-8")), F.lit("."), base64url(F.encode(claims, "UTF-8")))
    return F.concat(signed, F.lit("."), base64url(hmac(signed, secret)))


def verify_token(token: Column, secret: Column, now: Column, roles: Column | None = None) -> Column:
    """The claims as text where the signature and the time are good, else null; whatever else a token holds makes it null as well.

    The signature is compared as text before anything is decoded. With roles (the roles of the user that the claims name, null where there is no such user),
    the claims' array `role` must name roles of the user only.
    """
    part = F.split(token, r"\.")
    signed = F.concat_ws(".", F.get(part, F.lit(0)), F.get(part, F.lit(1)))
    good = (F.size(part) == 3) & (base64url(hmac(signed, secret)) == F.get(part, F.lit(2)))
    claims = as_text(unbase64url(F.when(good, F.get(part, F.lit(1)))))
    until = F.get_json_object(claims, "$.exp").try_cast("bigint")
    alg = F.get_json_object(as_text(unbase64url(F.when(good, F.get(part, F.lit(0))))), "$.alg")
    ok = good & (alg == "HS256") & (F.from_json(claims, "map<string,string>").isNotNull()) & (until.isNull() | (until > now))
    if roles is not None:
        named = F.coalesce(F.from_json(F.get_json_object(claims, "$.role"), "array<string>"), F.array().cast("array<string>"))
        ok = ok & roles.isNotNull() & (F.size(F.array_except(named, roles)) == 0)
    return F.when(ok, claims)


def accept_quality(line: Column, mime: str) -> Column:
    """The quality that an Accept header gives a type: its own, its family's, or that of */*."""
    kind = mime.split("/")[0]
    items = F.transform(F.split(line, ","), lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^;]*)", 1))).alias("t"), F.coalesce(F.regexp_extract(x, r"q=([0-9.]+)", 1).try_cast("double"), F.lit(1.0)).alias("q")))
    pick = lambda name: F.array_max(F.transform(F.filter(items, lambda i: i["t"] == name), lambda i: i["q"]))
    return F.coalesce(pick(mime), pick(f"{kind}/*"), pick("*/*"), F.lit(0.0))


def accept_languages(line: Column) -> Column:
    """Languages by falling quality; equal ones in the given order."""
    items = F.transform(F.split(line, ","), lambda x, i: F.struct((-F.coalesce(F.regexp_extract(x, r"q=([0-9.]+)", 1).try_cast("double"), F.lit(1.0))).alias("q"), i.alias("i"), F.trim(F.regexp_extract(x, "^([^;]*)", 1)).alias("l")))
    return F.transform(F.array_sort(items), lambda x: x["l"])


def client_address(forwarded: Column, remote: Column) -> Column:
    """The last X-Forwarded-For entry, else the connection's address."""
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(forwarded, ","), -1)), F.lit("")), remote)


def log_line(address: Column, user: Column, when: Column, request: Column, status: Column, size: Column, referer: Column, agent: Column) -> Column:
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.concat(dash(address), F.lit(" - "), dash(user), F.lit(" ["), F.date_format(when, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), request, F.lit('" '), dash(status), F.lit(" "), dash(size), F.lit(' "'), dash(referer), F.lit('" "'), dash(agent), F.lit('"'))


def reply(status: Column, body: Column, content_type: str) -> Column:
    """struct(status, reason, headers, body)."""
    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.struct(status.alias("status"), F.try_element_at(reasons, status).alias("reason"), F.create_map(F.lit("Content-Type"), F.lit(content_type), F.lit("Content-Length"), F.octet_length(body).cast("string")).alias("headers"), body.alias("body"))


def redirect(location: Column, status: int = 302) -> Column:
    page = F.concat(F.lit('<html><head><title>Moved</title></head><body><a href="'), location, F.lit('">here</a></body></html>'))
    return F.struct(F.lit(status).alias("status"), F.lit(REASONS[status]).alias("reason"), location.alias("location"), page.alias("body"))


def not_modified(modified: Column, since: Column) -> Column:
    """304 where a file is not newer than If-Modified-Since, else 200."""
    return F.when(modified <= since, 304).otherwise(200)


def has_prefix(path: Column, prefix: str) -> Column:
    """Whether a path lies below a prefix, by whole segments."""
    want = [s for s in prefix.split("/") if s]
    got = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.slice(got, 1, max(1, len(want))) == F.array(*map(F.lit, want)) if want else F.lit(True)


def csrf_ok(method: Column, sent: Column, own: Column) -> Column:
    return ~method.isin("POST", "PUT", "DELETE") | F.coalesce(sent == own, F.lit(False))


def method_allowed(method: Column, allowed: tuple[str, ...] = METHODS) -> Column:
    return method.isin(*allowed)


def allow_origin(origin: Column, allowed: list[str]) -> Column:
    """CORS headers of a reply: the origin where it is among the allowed ones, or '*'."""
    ok = F.lit("*" in allowed) | origin.isin(allowed)
    return F.when(ok, F.create_map(F.lit("Access-Control-Allow-Origin"), F.lit("*") if "*" in allowed else origin, F.lit("Access-Control-Allow-Credentials"), F.lit("true")))
