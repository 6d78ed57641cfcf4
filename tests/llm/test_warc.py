import base64
import gzip
import hashlib

import pytest

from listingloom.llm import warc as w

SCHEMA = "page_id long, url string, html string, headers string, block string"
ROWS = [
    (1, "http://a.example/x y", "<a href='/b?c=1'>é</a><p>text</p><script>no</script><img src=i.png>", "h", "b"),
    (2, None, None, None, None),
    (None, "http://a.example/", "", None, None),
    (4, "::", "<p>" + "long " * 50000, None, None),
    (4, "::", "<p>" + "long " * 50000, None, None),
]


def test_derivatives_refer_to_their_response(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    source = {r.headers["WARC-Record-ID"]: r for r in w.responses(pages, ["page_id"]).collect()}
    made = w.derivatives(w.responses(pages, ["page_id"]), ["page_id"]).collect()
    assert len(made) == 2 * len(ROWS)
    for r in made:
        h = r.headers
        its = source[h["WARC-Refers-To"]].headers
        assert its["WARC-Payload-Digest"] == h["WARC-Source-Payload-Digest"]
        assert (h.get("WARC-Target-URI"), h["WARC-Date"]) == (its.get("WARC-Target-URI"), its["WARC-Date"])
        assert h["WARC-Block-Digest"] == w.digest(r.block) and int(h["Content-Length"]) == len(r.block)
        assert h["WARC-Type"] in ("metadata", "conversion")
    first = {r.headers["WARC-Type"]: r for r in made if r.page_id == 1}
    assert first["conversion"].block.decode() == "é\ntext"
    fields = first["metadata"].block.decode().split("\r\n")
    assert "outlink: http://a.example/b?c=1 a/@href" in fields and "source-content-type: text/html; charset=utf-8" in fields
    assert first["metadata"].headers["WARC-Concurrent-To"] == first["conversion"].headers["WARC-Record-ID"]
    assert w.derivatives(w.responses(spark.createDataFrame([], SCHEMA), []), []).count() == 0


def test_one_pass_over_pages_makes_the_same_records(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    made = w.as_bytes(w.derivatives(w.responses(pages, ["page_id"]), ["page_id"]), ["page_id", "headers"]).collect()
    key = lambda r, sha: (str(r.page_id), sorted(r.headers.items()), sha)
    expected = sorted(key(r, hashlib.sha256(r.record).hexdigest()) for r in made)
    assert sorted(key(r, r.record_sha256) for r in w.page_derivatives(pages).collect()) == expected


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    records = w.responses(pages, [])
    w.write_warc(records, str(tmp_path / "w"), per_file=2)
    key = lambda r: (sorted(r.headers.items()), bytes(r.block))
    read = w.read_warc(spark, str(tmp_path / "w"))
    assert sorted(map(key, read.collect())) == sorted(map(key, records.collect()))
    assert w.derivatives(read, []).count() == 2 * len(ROWS)


def test_reading_gzip_members_folded_lines_and_damage():
    one = w.written({"WARC-Type": "response", "A": "b"}, b"x\r\n\r\ny")
    two = b"WARC/1.0\r\nWARC-Type: info\r\n  more\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    found = list(w.parsed(gzip.compress(one) + gzip.compress(two)))
    assert [b for _, b in found] == [b"x\r\n\r\ny", b""] and found[1][0]["WARC-Type"] == "info more"
    with pytest.raises(ValueError):
        list(w.parsed(one[:-8]))
    with pytest.raises(ValueError):
        list(w.parsed(b"nothing"))


def test_http_codings_and_other_types(spark):
    html = "<p>ünï</p>"
    body = gzip.compress(html.encode("latin-1"))
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    head = b"HTTP/1.1 404 No\r\nContent-Type: text/html; charset=latin-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    made = dict((h["WARC-Type"], b) for h, b in w.derived({"WARC-Record-ID": "<r>"}, head + chunked))
    assert made["conversion"].decode() == "ünï" and b"source-status: HTTP/1.1 404 No" in made["metadata"]
    table = spark.createDataFrame(
        [({"WARC-Type": "request"}, b"x"), ({"WARC-Type": "response"}, None)], "headers map<string,string>, block binary"
    )
    rows = w.derivatives(table, []).collect()
    assert len(rows) == 2 and {r.headers["WARC-Refers-To"] for r in rows} == {""}


def test_bytes_of_a_record(spark):
    row = w.as_bytes(w.derivatives(w.responses(spark.createDataFrame(ROWS[:1], SCHEMA), []), []), ["headers"]).first()
    headers, block = next(w.parsed(bytes(row.record)))
    assert headers == row.headers and hashlib.sha1(block).digest()


def test_names_of_any_case_and_repeated_fields(spark, tmp_path):
    raw = (
        b"WARC/1.0\r\nWarc-Type: response\r\nwarc-record-id: <urn:x>\r\nWARC-Concurrent-To: <a>\r\n"
        b"warc-concurrent-to: <b>\r\nX-Own: 1\r\ncontent-length: 3\r\n\r\na\nb\r\n\r\n"
    )
    (headers, block), = w.parsed(raw)
    assert block == b"a\nb" and headers == {
        "WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "WARC-Concurrent-To": "<a>, <b>", "X-Own": "1", "Content-Length": "3",
    }
    assert w.written(headers, block).count(b"WARC-Concurrent-To: ") == 2
    assert [(h, b) for h, b in w.parsed(w.written(headers, block))] == [({**headers}, block)]
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw))
    (tmp_path / "y.warc").write_bytes(raw * 3)
    (tmp_path / "z.warc").write_bytes(b"")
    read = w.read_warc(spark, str(tmp_path))
    assert [bytes(r.block) for r in read.collect()] == [b"a\nb"] * 5
    assert w.derivatives(read, []).count() == 10
    with pytest.raises(ValueError):
        list(w.parsed(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"))


def test_a_file_is_never_parted(spark, tmp_path):
    """However small the splits of the session are, and though blocks look like records."""
    one = w.written({"WARC-Type": "response"}, b"WARC/1.0\r\n\r\n" * 20_000)
    (tmp_path / "x.warc").write_bytes(one * 12)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert {len(r.block) for r in w.read_warc(spark, str(tmp_path)).collect()} == {240_000}
        assert w.read_warc(spark, str(tmp_path)).count() == 12
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_both_records_match_what_is_written_out_by_hand():
    html = "<title>t</title><p>a<a href=/x>b</a><div>c"
    headers, block = w.response(1, "http://h.example/p", html, "2026-01-02T00:00:00Z")
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    (meta, m), (text, t) = w.derived(headers, block)
    assert t == b"ab\nc" and m.decode() == (
        "source-status: HTTP/1.1 200 OK\r\nsource-content-type: text/html; charset=utf-8\r\n"
        f"source-content-length: {len(html)}\r\nsource-block-digest: {sha1(block)}\r\n"
        f"conversion: {text['WARC-Record-ID']}\r\noutlink: http://h.example/x a/@href\r\n"
    )
    for own, data, beside, kind in ((meta, m, text, "metadata"), (text, t, meta, "conversion")):
        assert own == {
            "WARC-Type": kind, "WARC-Record-ID": own["WARC-Record-ID"], "WARC-Refers-To": headers["WARC-Record-ID"],
            "WARC-Concurrent-To": beside["WARC-Record-ID"], "WARC-Target-URI": "http://h.example/p",
            "WARC-Date": "2026-01-02T00:00:00Z", "WARC-Source-Payload-Digest": sha1(html.encode()), "WARC-Block-Digest": sha1(data),
            "Content-Type": "text/plain; charset=UTF-8" if kind == "conversion" else "application/warc-fields",
            "Content-Length": str(len(data)),
        }
    assert meta["WARC-Record-ID"] != text["WARC-Record-ID"]
