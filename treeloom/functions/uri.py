"""URI algebra, percent coding and glob patterns as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generic form of a URI reference: scheme, authority, path, query, fragment.
_FORM = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_VALID = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://(?:[A-Za-z0-9._~!$&'()*+,;=:-]|%[0-9A-Fa-f]{2})*@?(?:\[[0-9A-Fa-f:.]+\]|(?:[A-Za-z0-9._~!$&'()*+,;=-]|%[0-9A-Fa-f]{2})*)(?::[0-9]*)?)?(?:[A-Za-z0-9._~!$&'()*+,;=:@/-]|%[0-9A-Fa-f]{2})*(?:\?(?:[A-Za-z0-9._~!$&'()*+,;=:@/?-]|%[0-9A-Fa-f]{2})*)?(?:#(?:[A-Za-z0-9._~!$&'()*+,;=:@/?-]|%[0-9A-Fa-f]{2})*)?$"


def _part(uri: Column, n: int) -> Column:
    return F.regexp_extract(uri, _FORM, n)


def _has(uri: Column, pattern: str) -> Column:
    return F.regexp_like(uri, F.lit(pattern))


def is_valid(uri: Column) -> Column:
    return _has(uri, _VALID)


def is_fully_qualified(uri: Column) -> Column:
    return is_valid(uri) & _has(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")


def parse(uri: Column) -> Column:
    """struct(scheme, userinfo, host, port, path, query, fragment); missing parts are null, scheme and host in lower case. Null where not valid or the port is above 65535."""
    authority = _part(uri, 2)
    host = F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)(?::[0-9]*)?$", 1)
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    none = F.lit(None).cast("string")
    return F.when(
        is_valid(uri) & ((port == "") | F.coalesce(port.try_cast("int") <= 65535, F.lit(False))),
        F.struct(
            F.nullif(F.lower(_part(uri, 1)), F.lit("")).alias("scheme"),
            F.when(F.contains(authority, F.lit("@")), F.regexp_extract(authority, "^([^@]*)@", 1)).alias("userinfo"),
            F.when(_has(uri, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), F.lower(host)).alias("host"),
            F.when(port != "", port.try_cast("int")).alias("port"),
            _part(uri, 3).alias("path"),
            segments(_part(uri, 3)).alias("segments"),
            F.when(_has(uri, r"^[^?#]*\?"), _part(uri, 4)).otherwise(none).alias("query"),
            F.when(_has(uri, r"#"), _part(uri, 5)).otherwise(none).alias("fragment"),
        ),
    )


def segments(path: Column) -> Column:
    """The parts of a path between slashes, percent-decoded; the first is empty where the path is absolute."""
    return F.transform(F.split(path, "/"), _decode)


def _decode(text: Column) -> Column:
    return F.try_url_decode(F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def _encode(text: Column, plain: str) -> Column:
    """Percent coding of all but unreserved characters, those of `plain`, and triples that are coded already."""
    out = F.replace(url_encode(text), F.lit("%25"), F.lit("%"))
    out = F.regexp_replace(out, "%(?![0-9A-F]{2})", "%25")
    return reduce(lambda c, x: F.replace(c, F.lit(f"%{ord(x):02X}"), F.lit(x)), plain, out)


def set_path(uri: Column, path: Column) -> Column:
    s, a, _, q, f = _pieces(uri)
    return compose(s, a, _encode(path, "/:@!$&'()*+,;="), q, f)


def set_query(uri: Column, query: Column) -> Column:
    s, a, p, _, f = _pieces(uri)
    return compose(s, a, p, _encode(query, "/:@!$&'()*+,;=?"), f)


def set_fragment(uri: Column, fragment: Column) -> Column:
    s, a, p, q, _ = _pieces(uri)
    return compose(s, a, p, q, _encode(fragment, "/:@!$&'()*+,;=?"))


def raw(uri: Column) -> Column:
    """The text with its path percent-decoded."""
    s, a, p, q, f = _pieces(uri)
    return compose(s, a, _decode(p), q, f)


def equal(a: Column, b: Column) -> Column:
    """Whether two URIs are the same after case and coding of their parts are evened out."""
    even = lambda u: F.struct(*[F.coalesce(c, F.lit("\u0000")).alias(n) for n, c in zip("sapqf", (*_pieces(u)[:2], F.array_join(segments(_pieces(u)[2]), "\u0001"), *_pieces(u)[3:]), strict=True)])
    return even(a) == even(b)


def remove_dot_segments(path: Column) -> Column:
    """A path with '.' and '..' segments resolved by a fold over its segments."""
    absolute = F.startswith(path, F.lit("/"))
    segments = F.split(path, "/")

    def step(acc: Column, s: Column) -> Column:
        up = F.when((F.size(acc) > 1) | ((F.size(acc) == 1) & ~absolute), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_open = _has(path, r"(?:^|/)\.\.?$")
    text = F.array_join(F.when(ends_open, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")
    return F.when(absolute & ~F.startswith(text, F.lit("/")), F.concat(F.lit("/"), text)).otherwise(text)


def compose(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    def opt(prefix: str, c: Column, suffix: str = "") -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(prefix), c, F.lit(suffix))).otherwise(F.lit(""))

    return F.concat(opt("", scheme, ":"), opt("//", authority), path, opt("?", query), opt("#", fragment))


def normalize(uri: Column) -> Column:
    """Scheme and host in lower case, dot segments removed."""
    return resolve(uri, uri)


def _pieces(uri: Column) -> tuple[Column, Column, Column, Column, Column]:
    scheme = F.nullif(F.lower(_part(uri, 1)), F.lit(""))
    raw = _part(uri, 2)
    authority = F.when(_has(uri, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), F.concat(F.regexp_extract(raw, "^([^@]*@)", 1), F.lower(F.regexp_replace(raw, "^[^@]*@", ""))))
    query = F.when(_has(uri, r"^[^?#]*\?"), _part(uri, 4))
    fragment = F.when(_has(uri, "#"), _part(uri, 5))
    return scheme, authority, _part(uri, 3), query, fragment


def resolve(ref: Column, base: Column) -> Column:
    """A reference against a base, by the rules for reference resolution."""
    rs, ra, rp, rq, rf = _pieces(ref)
    bs, ba, bp, bq, _ = _pieces(base)
    merged = F.when(ba.isNotNull() & (bp == ""), F.concat(F.lit("/"), rp)).otherwise(F.concat(F.regexp_extract(bp, "^(.*/)", 1), rp))
    path = F.when(rs.isNotNull() | ra.isNotNull(), remove_dot_segments(rp)).when(rp == "", bp).when(F.startswith(rp, F.lit("/")), remove_dot_segments(rp)).otherwise(remove_dot_segments(merged))
    query = F.when(rs.isNotNull() | ra.isNotNull() | (rp != ""), rq).otherwise(F.coalesce(rq, bq))
    return compose(F.coalesce(rs, bs), F.when(rs.isNotNull(), ra).otherwise(F.coalesce(ra, ba)), path, query, rf)


def relative(uri: Column, base: Column) -> Column:
    """The shortest path reference that leads from base to uri; uri itself where scheme or authority differ."""
    us, ua, up, uq, uf = _pieces(uri)
    bs, ba, bp, _, _ = _pieces(base)
    a, b = F.split(up, "/"), F.split(F.regexp_replace(bp, "[^/]*$", ""), "/")
    dirs_a, dirs_b = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0)))
    same = F.aggregate(
        F.zip_with(dirs_a, dirs_b, lambda x, y: F.coalesce(x == y, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, eq: F.struct((acc["n"] + F.when(acc["on"] & eq, 1).otherwise(0)).alias("n"), (acc["on"] & eq).alias("on")),
        lambda acc: acc["n"],
    )
    ups = F.array_repeat(F.lit(".."), (F.size(dirs_b) - same).cast("int"))
    rest = F.slice(a, same + 1, F.size(a))
    text = F.array_join(F.concat(ups, rest), "/")
    text = F.when(text == "", F.lit("./")).when(F.contains(F.element_at(F.split(text, "/"), 1), F.lit(":")), F.concat(F.lit("./"), text)).otherwise(text)
    one = us.eqNullSafe(bs) & ua.eqNullSafe(ba)
    return F.when(one, compose(F.lit(None), F.lit(None), text, uq, uf)).otherwise(uri)


def append_path(uri: Column, more: Column) -> Column:
    s, a, p, q, f = _pieces(uri)
    joined = F.concat(F.regexp_replace(p, "/$", ""), F.lit("/"), F.regexp_replace(more, "^/", ""))
    return compose(s, a, remove_dot_segments(joined), q, f)


def url_encode(text: Column) -> Column:
    """Percent coding of all but -._~A-Za-z0-9."""
    return reduce(lambda c, ab: F.replace(c, F.lit(ab[0]), F.lit(ab[1])), (("+", "%20"), ("*", "%2A"), ("%7E", "~")), F.url_encode(text))


def url_decode(text: Column) -> Column:
    """Percent decoding, '+' as a blank; a '%' without two hex digits is dropped."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", ""))


def query_parameters(query: Column) -> Column:
    """array<struct<name, value>> in order; '&' and ';' separate."""
    parts = F.filter(F.split(query, "[&;]"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(url_decode(F.regexp_extract(x, "^([^=]*)", 1)).alias("name"), url_decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value")))


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: ';' alternatives, {a,b}, *, ?, **/, and a trailing '/' for all below. Case is ignored."""

    def one(g: str) -> str:
        if g.endswith("/"):
            g += "**"
        out, i, depth = "", 0, 0
        while i < len(g):
            c = g[i]
            if g.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
                continue
            if g.startswith("**", i):
                out, i = out + ".*", i + 2
                continue
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "{":
                out, depth = out + "(?:", depth + 1
            elif c == "}" and depth:
                out, depth = out + ")", depth - 1
            elif c == "," and depth:
                out += "|"
            else:
                out += "\\" + c if not c.isalnum() and c not in "/_" else c
            i += 1
        return out + ")" * depth

    return "(?i)^(?:" + "|".join(one(g) for g in glob.split(";")) + ")$"


def glob_match(path: Column, glob: str) -> Column:
    return F.regexp_like(path, F.lit(glob_pattern(glob)))
