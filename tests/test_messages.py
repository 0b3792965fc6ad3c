"""Messages whole, cut at every byte, in batches and streams; multipart bytes."""

import random

from pyspark.sql import functions as F

from treeloom.operators import messages, web

BODY = bytes(range(256)) + "é日".encode()
WHOLE = [
    b"GET /a HTTP/1.1\r\nHost: h\r\nX: 1\r\n 2\r\n\r\n",
    b"POST /b HTTP/1.0\r\nContent-Length: %d\r\n\r\n" % len(BODY) + BODY,
    b"PUT /c HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n3;q=1\r\n\x00\xff\n\r\nA\r\n0123456789\r\n0\r\n\r\n",
    b"DELETE /d HTTP/1.1\r\nContent-Length: 0\r\n\r\n",
]
WANT = [("GET", "/a", b""), ("POST", "/b", BODY), ("PUT", "/c", b"\x00\xff\n0123456789"), ("DELETE", "/d", b"")]
BAD = [b"GET /a HTTP/1.1\r\nno header\r\n\r\n", b"what\r\n", b"POST / HTTP/1.1\r\nContent-Length: x\r\n\r\n", b"POST / HTTP/1.1\r\nTransfer-Encoding: gzip\r\n\r\n", b"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n", b"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nabcd\r\n", b"POST / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n" + b"1" * 5000]


def fed(pieces, **given):
    c = messages.Connection(**given)
    return [m for p in pieces for m in c.feed(p)], c.rest()


def test_every_cut_gives_the_same():
    raw = b"".join(WHOLE)
    want, rest = fed([raw])
    assert [(m[2], m[3], m[6]) for m in want] == WANT and rest is None and want[0][5] == {"host": "h", "x": "1 2"}
    for at in range(len(raw)):
        assert fed([raw[:at], raw[at:]])[0] == want
    assert fed([raw[i : i + 1] for i in range(len(raw))])[0] == want
    for m, (method, uri, body) in zip(WHOLE, WANT):
        assert messages.whole(m)[:2] + messages.whole(m)[4:] == (method, uri, body)
        found, rest = fed([m[:-1]])
        assert found == [] and rest[1] is None


def test_malformed_messages_end_their_connection():
    for bad in BAD:
        for pieces in ([WHOLE[0] + bad + WHOLE[0]], [bytes([x]) for x in WHOLE[0] + bad + WHOLE[0]]):
            found, rest = fed(pieces)
            assert [m[1] for m in found] == [True, False] and rest is None, bad


def test_replies():
    found, _ = fed([b"HTTP/1.1 404 Not Found\r\nContent-Length: 2\r\n\r\nab"], replies=True)
    assert found == [(1, True, 404, "Not Found", "1.1", {"content-length": "2"}, b"ab")]


def cut_rows(seed, connections=5):
    rng, rows, want = random.Random(seed), [], []
    for c in range(connections):
        picked = [rng.randrange(4) for _ in range(6)]
        raw, at, seq = b"".join(WHOLE[i] for i in picked), 0, 0
        want += [(c, k + 1, *WANT[i]) for k, i in enumerate(picked)]
        while at < len(raw):
            n = rng.randint(1, 90)
            rows.append((c, seq, raw[at : at + n], "extra"))
            at, seq = at + n, seq + 1
    return rows, want


def test_scan_of_batches(spark):
    rows, want = cut_rows(3)
    rows += [(None, 0, WHOLE[0], "x"), (None, 1, None, "x"), (9, 0, WHOLE[1][:-1], "x"), (10, 0, BAD[1], "x"), (10, 1, WHOLE[0], "x")]
    df = spark.createDataFrame(rows, "connection long, seq int, data binary, message string").repartition(3)
    found = {(r.connection, r.message, r.method, r.uri, bytes(r.body)) for r in messages.scan(df).filter("complete").collect()}
    assert found == {*want, (None, 1, "GET", "/a", b"")}
    assert {(r.connection, r.complete) for r in messages.scan(df).filter("complete IS NULL OR NOT complete").collect()} == {(9, None), (10, False)}
    assert messages.scan(df.limit(0)).count() == 0


def test_scan_of_a_stream(spark, tmp_path):
    rows, want = cut_rows(4)
    parts = 4
    for i in range(parts):  # one file and micro-batch after the other, each connection's fragments in order
        mine = [r[:3] for r in rows if r[1] * parts // (1 + max(x[1] for x in rows if x[0] == r[0])) == i]
        spark.createDataFrame(mine, "connection long, seq int, data binary").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("connection long, seq int, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = messages.scan_stream(stream).writeStream.format("memory").queryName("told").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
        q.awaitTermination(300)
        assert q.exception() is None
        assert len(q.recentProgress) >= parts
    finally:
        spark.conf.unset(provider)
    assert {(r.connection, r.message, r.method, r.uri, bytes(r.body)) for r in spark.table("told").collect()} == set(want)


def test_multipart_bytes(spark):
    data = bytes(range(256)) + b"\r\n--bx"
    body = b'--b\r\nContent-Disposition: form-data; name="a"; filename="f x.bin"\r\nContent-Type: image/png\r\n\r\n' + data + b'\r\n--b\r\nContent-Disposition: form-data; name=c\r\n\r\n\r\n--b--\r\n--b\r\nContent-Disposition: form-data; name=z\r\n\r\nafter'
    parts = messages.parts_of("multipart/form-data; boundary=b", body)
    assert parts == [{"name": "a", "filename": "f x.bin", "mimetype": "image/png", "data": data}, {"name": "c", "filename": None, "mimetype": None, "data": b""}]
    assert messages.parts_of("text/plain", body) == [] and messages.parts_of("multipart/form-data; boundary=b", b"") == []
    df = spark.createDataFrame([("multipart/form-data; boundary=b", body), (None, b"x"), ("x", None)], "t string, b binary")
    assert [None if r[0] is None else len(r[0]) for r in df.select(web.multipart(F.col("t"), F.col("b"))).collect()] == [2, 0, None]
