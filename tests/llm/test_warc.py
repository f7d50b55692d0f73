import random
import zlib
from hashlib import sha256

import pytest

from ledgerline.llm import warc

SCHEMA = "page_id long, url string, html string"


def check(rows, got):
    first, want = {}, []
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            first[data] = min(first.get(data, i), i)
    for i, _, html in rows:
        data = (html or "").encode()
        again = first.get(data, i) != i
        want.append((i, len(data), sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_query(spark, tmp_path):
    rng = random.Random(3)
    body = lambda n: "".join(rng.choice("abé <>\n\r\t\U0001f600") for _ in range(n))
    shared, small = body(300), "x" * 99
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 5
    rows = [(i, f"https://h{i}.example/p", html) for i, html in enumerate([body(500), shared, small, None, "", shared, small, tricky, "\r\n\r\n" * 40, tricky, "y" * 100, "y" * 100, body(200_000)] + [shared] * 30)]
    rows[3] = (3, None, None)
    rows[4] = (4, "http://x/\r\nWARC-Type: bad", "")
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    check(rows, warc.op6_warc(spark, str(tmp_path)).collect())


def test_null_and_repeated_keys_and_clashing_names(spark, tmp_path):
    same, lone = "n" * 150, "l" * 150
    rows = [(None, None, same), (4, "u", same), (4, "u", same), (None, "u", lone), (None, "u", lone), (None, None, None), (9, "v", "")]
    extra = ["__page", "__digest", "first", "copy", "kind", "main", "source", "digest", "uri", "value", "bytes"]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + "".join(f", {c} string" for c in extra))
    docs.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.op6_warc(spark, str(tmp_path)).collect())
    assert got == [("4", 150, "response", "None"), ("4", 150, "revisit", "4"), ("9", 0, "response", "None"), ("None", 0, "response", "None"), ("None", 150, "response", "None"), ("None", 150, "revisit", "4"), ("None", 150, "revisit", "None")]


def test_archives_are_plain_and_captures_nest(spark, tmp_path):
    rows = [(1, "https://a.example/x", "z" * 120), (2, "https://b.example/y", "z" * 120), (2, "https://b.example/y", "z" * 120)]
    path = str(tmp_path / "archive")
    warc.archive(spark.createDataFrame(rows, SCHEMA), path)
    data = b"".join(zlib.decompress(p.read_bytes(), 31) for p in sorted((tmp_path / "archive").glob("part-*.gz")))
    assert data.count(b"WARC/1.1\r\n") == 9 and data.endswith(b"\r\n\r\n")
    got = warc.captures(spark, path).collect()
    assert len(got) == 3
    for r in got:
        assert r.request.uri == r.response.uri and r.metadata.fields["payload-length"] == "120" and "GET / HTTP/1.1" in r.request.request
    kinds = sorted((r.response.type, r.metadata.fields["page"], bytes(r.response.payload or b"")) for r in got)
    assert kinds == [("response", "1", b"z" * 120), ("revisit", "2", b""), ("revisit", "2", b"")]
    main = next(r.capture_id for r in got if r.response.type == "response")
    assert {r.response.refers_to for r in got if r.response.type == "revisit"} == {main}


def test_parser_takes_members_and_refuses_torn_files():
    one = lambda block: b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)

    def pack(x):
        c = zlib.compressobj(wbits=31)
        return c.compress(x) + c.flush()

    blocks = [b"", b"a", b"\r\n\r\n", b"q" * 5000]
    for data in (pack(b"".join(map(one, blocks))), b"".join(pack(one(b)) for b in blocks)):
        for window in (7, 1 << 20):
            assert [b for _, b in warc.parse(data, window)] == blocks
    assert list(warc.parse(b"")) == []
    for torn in (one(b"abc")[:-6], b"WARC/1.1\r\nWARC"):
        with pytest.raises(ValueError):
            list(warc.parse(pack(torn)))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op6_warc(spark, str(tmp_path)).count() == 0
