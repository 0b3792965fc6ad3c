"""HTTP messages in bytes: whole ones in a column, and fragments of connections in batches and streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "OPTIONS", "TRACE", "CONNECT", "PATCH")
REQUEST = "struct<method: string, uri: string, version: string, headers: map<string, string>, body: binary>"
REPLY = "struct<status: int, reason: string, version: string, headers: map<string, string>, body: binary>"
_REQUEST_LINE = re.compile(rb"([A-Z]+) (\S+) HTTP/([0-9]\.[0-9])")
_REPLY_LINE = re.compile(rb"HTTP/([0-9]\.[0-9]) ([0-9]{3}) ?([^\r\n]*)")
_HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):(.*)", re.S)
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_FOLDED = re.compile(rb"\r?\n[ \t]+")
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})(?:;[^\r\n]*)?\r\n")
#: Bytes of a line with a chunk's size.
LONGEST_SIZE_LINE = 4096


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def start_line(line: bytes, replies: bool) -> tuple | None:
    """(method, uri, version) or (status, reason, version); null where the line is none."""
    if replies:
        m = _REPLY_LINE.fullmatch(line)
        return m and (int(m[2]), _text(m[3]), m[1].decode())
    m = _REQUEST_LINE.fullmatch(line)
    return m and m[1].decode() in METHODS and (m[1].decode(), _text(m[2]), m[3].decode()) or None


def head_of(head: bytes, replies: bool, strict: bool) -> tuple | None:
    """What start_line gives and the headers, names in lower case, the last of one name; with strict, null where a line is no header."""
    first, *lines = re.split(rb"\r?\n", _FOLDED.sub(b" ", head))
    start = start_line(first, replies)
    if not start:
        return None
    headers = {}
    for line in lines:
        m = _HEADER.fullmatch(line)
        if m:
            headers[_text(m[1]).lower()] = _text(m[2].strip())
        elif strict:
            return None
        elif b":" in line:
            name, value = line.split(b":", 1)
            headers[_text(name.strip()).lower()] = _text(value.strip())
    return start, headers


def chunks(raw: bytes, at: int = 0) -> Iterator[tuple[int, int]]:
    """Where each chunk's content begins and ends, until the last chunk or what is none."""
    while (m := re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r?\n").match(raw, at)) and (n := int(m[1], 16)):
        yield m.end(), m.end() + n
        at = m.end() + n
        at += 2 if raw[at : at + 2] == b"\r\n" else raw[at : at + 1] == b"\n"


def unchunked(raw: bytes, at: int = 0) -> bytes:
    """The content of a chunked body; what breaks off or has no size ends it."""
    return b"".join(raw[a:b] for a, b in chunks(raw, at))


def whole(raw: bytes | None, replies: bool = False) -> tuple | None:
    """A whole message: what start_line gives, headers, body (as long as Content-Length says, else all that follows); null where its first line is none."""
    if raw is None:
        return None
    m = _HEAD_END.search(raw)
    head, at = (raw[: m.start()], m.end()) if m else (re.sub(rb"\r?\n\Z", b"", raw), len(raw))
    found = head_of(head, replies, False)
    if not found:
        return None
    start, headers = found
    if headers.get("transfer-encoding", "").lower().endswith("chunked"):
        body = unchunked(raw, at)
    else:
        length = headers.get("content-length", "")
        body = raw[at : at + int(length)] if re.fullmatch("[0-9]{1,18}", length) else raw[at:]
    return *start, headers, body


def _parser(replies: bool, shape: str):
    names = ("status", "reason") if replies else ("method", "uri")
    kind = pa.struct([(names[0], pa.int32() if replies else pa.string()), (names[1], pa.string()), ("version", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])

    @F.arrow_udf(shape)
    def run(raw: pa.Array) -> pa.Array:
        found = [whole(x, replies) for x in raw.to_pylist()]
        empty = (None, None, None, {}, None)
        columns = list(zip(*(f or empty for f in found), strict=True)) or [()] * 5
        columns[3] = [list(h.items()) for h in columns[3]]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)]
        return pa.StructArray.from_arrays(arrays, fields=list(kind), mask=pa.array([f is None for f in found], pa.bool_()))

    return run


def parse_request(raw: Column) -> Column:
    """struct(method, uri, version, headers map with lower-case names, body in bytes) of a whole message (text or bytes); null where the first line is no request.

    A chunked body is put together, another one cut at its Content-Length; header texts that are not UTF-8 get replacement characters.
    """
    return _parser(False, REQUEST)(raw.cast("binary"))


def parse_reply(raw: Column) -> Column:
    """struct(status, reason, version, headers, body in bytes) of a whole reply; null where its first line is none."""
    return _parser(True, REPLY)(raw.cast("binary"))


def _values(kind: pa.DataType, shape: str, one):
    """A column function of bytes by a function of one value; null stays null."""

    @F.arrow_udf(shape)
    def run(raw: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x) for x in raw.to_pylist()], kind)

    return run


def unchunk(body: Column) -> Column:
    """The content (bytes) of a chunked body (text or bytes), whose sizes count bytes; what breaks off or has no size ends it."""
    return _values(pa.binary(), "binary", unchunked)(body.cast("binary"))


_NAME = re.compile(rb"[; \t]name=(?:\"([^\"]*)\"|([^;\s]+))", re.I)
_FILE = re.compile(rb"[; \t]filename=(?:\"([^\"]*)\"|([^;\s]+))", re.I)
_DISPOSITION, _TYPE = (re.compile(rb"^%s:[ \t]*([^\r\n]*)" % n, re.I | re.M) for n in (rb"content-disposition", rb"content-type"))
PARTS = "array<struct<name: string, filename: string, mimetype: string, data: binary>>"


def parts_of(content_type: str, body: bytes) -> list[dict]:
    """The parts of a multipart body between lines of its boundary; parts without a disposition are left out, and so is what follows the last boundary."""
    m = re.search(r"boundary=(?:\"([^\"]+)\"|([^\";,\s]+))", content_type, re.I)
    if not m:
        return []
    line = re.compile(rb"(?:\A|\r?\n)--" + re.escape((m[1] or m[2]).encode()) + rb"(--)?[ \t]*(?:\r?\n|\Z)")
    out, begin = [], None
    at = 0
    while found := line.search(body, at):
        if begin is not None:
            part = body[begin : found.start()]
            end = _HEAD_END.search(b"\n" + part)  # a part may have no headers at all
            head, data = (part[: max(0, end.start() - 1)], part[end.end() - 1 :]) if end else (part, b"")
            said = _DISPOSITION.search(_FOLDED.sub(b" ", head))
            if said:
                first = lambda r, t: (m := r.search(t)) and _text(next(g for g in m.groups() if g is not None))
                kind = _TYPE.search(head)
                out.append({"name": first(_NAME, said[1]) or "", "filename": first(_FILE, said[1]), "mimetype": _text(kind[1]) if kind else None, "data": data})
        if found[1]:
            break
        begin, at = found.end(), found.end() - (2 if body[found.end() - 2 : found.end()] == b"\r\n" else 1)
        at = max(at, found.start() + 1)
    return out


def multipart(content_type: Column, body: Column) -> Column:
    """array<struct<name, filename, mimetype, data (bytes)>> of a multipart form (text or bytes); of a body without a boundary, none."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("filename", pa.string()), ("mimetype", pa.string()), ("data", pa.binary())]))

    @F.arrow_udf(PARTS)
    def run(types: pa.Array, bodies: pa.Array) -> pa.Array:
        return pa.array([None if b is None else parts_of(t or "", b) for t, b in zip(types.to_pylist(), bodies.to_pylist(), strict=True)], kind)

    return run(content_type, body.cast("binary"))


class Connection:
    """What a connection has sent and is not yet told: bytes of one unfinished message, how far they are understood, and how many are needed to go on."""

    HEAD, SIZED, CHUNKED, DEAD = range(4)

    def __init__(self, replies: bool = False, raw: bytes = b"", stage: int = 0, at: int = 0, want: int = 1, number: int = 0) -> None:
        self.replies, self.raw, self.stage, self.at, self.want, self.number = replies, bytearray(raw), stage, at, want, number

    def feed(self, data: bytes) -> Iterator[tuple]:
        """(number, complete, *start line, headers, body) of each message that these bytes end; one that is malformed is told with complete = false and ends the connection."""
        if self.stage == self.DEAD:
            return
        self.raw += data
        while len(self.raw) >= self.want:
            end = self._advance()
            if end is None:
                continue
            self.number += 1
            if end < 0:
                self.stage = self.DEAD
                self.raw.clear()
                yield (self.number, False, None, None, None, None, None)
                return
            found = whole(bytes(self.raw[:end]), self.replies)
            del self.raw[:end]
            self.stage, self.at, self.want = self.HEAD, 0, 1
            yield (self.number, True, *found)

    def rest(self) -> tuple | None:
        """The row of a message that has begun and not ended."""
        return (self.number + 1, None, None, None, None, None, None) if self.raw else None

    def _advance(self) -> int | None:
        """Where the message ends, -1 where it is malformed, null where more bytes are needed (or, after a head, the next stage is to be tried)."""
        raw = self.raw
        if self.stage == self.HEAD:
            end = raw.find(b"\r\n\r\n", max(0, self.at - 3))
            if end < 0:
                line = raw.find(b"\r\n")
                if line >= 0 and not start_line(bytes(raw[:line]), self.replies):
                    return -1
                self.at, self.want = len(raw), len(raw) + 1
                return None
            found = head_of(bytes(raw[:end]), self.replies, True)
            if not found:
                return -1
            headers, self.at = found[1], end + 4
            if "transfer-encoding" in headers:
                if not re.search(r"(?:^|[ ,])chunked\Z", headers["transfer-encoding"], re.I):
                    return -1
                self.stage, self.want = self.CHUNKED, self.at
                return None
            length = headers.get("content-length", "0")
            if not re.fullmatch("[0-9]{1,18}", length):
                return -1
            self.stage, self.want = self.SIZED, self.at + int(length)
            return None
        if self.stage == self.SIZED:
            return self.want
        end = raw.find(b"\n", self.at)
        if end < 0:
            self.want = len(raw) + 1
            return -1 if len(raw) - self.at > LONGEST_SIZE_LINE else None
        m = _CHUNK.fullmatch(raw, self.at, end + 1)
        if not m:
            return -1
        after = end + 1 + int(m[1], 16) + 2  # content and line end; the last chunk has none, but a line end behind it
        if len(raw) < after:
            self.want = after
            return None
        if raw[after - 2 : after] != b"\r\n":
            return -1
        if int(m[1], 16) == 0:
            return after
        self.at = self.want = after
        return None


def _shape(kind: str, key: str, replies: bool) -> str:
    return f"`{key}` {kind}, message long, complete boolean, " + ("status int, reason string, " if replies else "method string, uri string, ") + "version string, headers map<string, string>, body binary"


def scan(fragments: DataFrame, key: str = "connection", order: str = "seq", data: str = "data", replies: bool = False) -> DataFrame:
    """The messages of connections that arrive in fragments, cut anywhere: key, message (from 1), complete, method, uri (or status, reason), version, headers, body.

    complete is true for a whole message, false for one that is malformed, after which its connection is not read any more, and null for one that
    has not ended. Bodies have the length that Content-Length says, or are chunked; without either there is none. Fragments of a
    connection are taken in order, null data as none; they stream past, so only the bytes of an unfinished message are held.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = _shape(dict(fragments.dtypes)[key], key, replies)
    schema = to_arrow_schema(fragments.sparkSession.createDataFrame([], shape).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, connection = None, None
        for b in batches:
            rows = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if connection is None or k != now:
                    if connection is not None and (rest := connection.rest()):
                        rows.append((now, *rest))
                    now, connection = k, Connection(replies)
                rows += [(k, *m) for m in connection.feed(raw or b"")]
            yield _rows(rows, schema)
        if connection is not None and (rest := connection.rest()):
            yield _rows([(now, *rest)], schema)

    there = fragments.select(key, F.col(data).cast("binary").alias(data), F.col(order).alias("_order"))
    return there.repartition(key).sortWithinPartitions(key, "_order").select(key, data).mapInArrow(run, shape)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[r[i] for r in rows] for i in range(len(schema))]
    at = schema.get_field_index("headers")
    columns[at] = [None if h is None else list(h.items()) for h in columns[at]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def scan_stream(fragments: DataFrame, key: str = "connection", order: str = "seq", data: str = "data", replies: bool = False) -> DataFrame:
    """scan for a stream: messages come out as they end, and a connection's unfinished bytes are its state between micro-batches.

    Fragments of one micro-batch are taken in order; those of a later one follow. Messages that have not ended give no row. The session's
    state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    shape = _shape(dict(fragments.dtypes)[key], key, replies)
    names = [c.split()[0].strip("`") for c in re.split(r", (?![^<]*>)", shape)]

    class Keep(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("connection", "raw binary, stage int, at long, want long, number long")

        def handleInputRows(self, k, rows, timer) -> Iterator[pd.DataFrame]:  # noqa: N802
            held = self.state.get()
            connection = Connection(replies, *((bytes(held[0]), *held[1:]) if held else ()))
            out = []
            given = pd.concat(list(rows))
            for raw in given.sort_values(given.columns[2], kind="stable").iloc[:, 1]:
                out += [(k[0], *m) for m in connection.feed(bytes(raw) if raw is not None else b"")]
            self.state.update((bytes(connection.raw), connection.stage, connection.at, connection.want, connection.number))
            yield pd.DataFrame(out, columns=names)

        def close(self) -> None:
            pass

    there = fragments.select(key, F.col(data).cast("binary").alias(data), F.col(order).alias("_order"))
    return there.groupBy(key).transformWithStateInPandas(Keep(), shape, "Append", "None")
