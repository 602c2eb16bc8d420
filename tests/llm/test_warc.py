import gzip
import hashlib
import io
import tracemalloc
import zlib

import duckdb

from fieldlab.llm import op10_warc as op

from .common_cases import saved

PAGES = [(1, "http://a/x", "<html><head><title>t</title></head><body><h1>Ä &amp; B</h1><p>one<br>two</p><script>no()</script><!-- no --></body></html>"), (2, None, None), (3, "http://a/y", ""), (3, "http://a/y", "")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_links_headers_and_digests(spark):
    source = op.responses(pages(spark))
    ids = {r.key: r for r in source.collect()}
    for r in op.derivatives(source).collect():
        s = ids[r.key]
        assert r.refers_to == s.record_id and r.source_digest == s.payload_digest == "sha256:" + hashlib.sha256(s.payload.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        if r.record_type == "metadata":
            assert f"source-digest: {s.payload_digest}" in r.block and "Content-Type: text/html" in r.block
        elif r.key == 1:
            assert r.block == "Ä & B\none\ntwo"
    assert op.derivatives(source).count() == 8


def test_conversion_of_odd_markup(spark):
    cases = {
        "<p>It&#8217;s a caf&eacute; &#x2014; 5&nbsp;&euro; &amp;lt; &unknown; &</p>": "It’s a café — 5 € &lt; &unknown; &",
        "<p>a</p><script>if (a<b) leak('x')": "a",
        "<p>a</p><!-- open <p>b</p>": "a",
        "<p>a</p><style>p{}": "a",
        "<p title='a>b' class=\"c>d\">text</p>": "text",
        "<a title='odd>one</a> two": "one two",
        "<SCRIPT>x</SCRIPT><DIV>up</DIV>1 < 2": "up\n1 < 2",
        "<a " + "b='>' " * 1000 + ">long</a>": "long",
        "<" + "'" * 100_000: None,
        "<p " + '"' * 100_001: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string").withColumn("url", op.F.lit("http://a/\r\nb"))
    got = {r.key: r for r in op.derivatives(op.responses(df)).where("record_type = 'conversion'").collect()}
    for i, want in enumerate(cases.values()):
        assert want is None or got[i].block == want
        assert got[i].target_uri == "http://a/b"


def test_ids_of_different_pages_differ(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (1, "u", "b"), (None, None, "b")], "page_id long, url string, html string")
    made = op.derivatives(op.responses(df))
    assert made.count() == 8 and made.select("record_id").distinct().count() == 6


def test_written_files_are_read_again(spark, tmp_path):
    made = op.derivatives(op.responses(pages(spark)))
    for kind in (None, "gzip"):
        op.write_warc(made.coalesce(2), str(tmp_path / str(kind)), kind)
        back = op.read_warc(spark, str(tmp_path / str(kind)))
        want = sorted({(r.record_type, r.record_id, r.refers_to, r.target_uri, r.block_digest, r.source_digest, r.block) for r in made.collect()})
        assert sorted((r.record_type, r.record_id, r.refers_to, r.target_uri, r.block_digest, r.source_digest, r.payload) for r in back.collect()) == want


def test_responses_of_a_file_are_converted(spark, tmp_path):
    body = "<p>héllo</p>".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    rows = op.read_warc(spark, str(tmp_path / "a.warc.gz"))
    assert rows.count() == 2 and rows.first().payload == "<p>héllo</p>" and rows.first().http_headers.startswith("HTTP/1.1 200")
    got = op.derivatives(rows.where("record_type = 'response'")).where("record_type = 'conversion'").first()
    assert got.source_digest == "sha256:" + hashlib.sha256(body).hexdigest() and rows.first().block_digest == "sha256:" + hashlib.sha256(http).hexdigest()
    assert got.block == "héllo" and got.refers_to == "<urn:uuid:1>" and got.date == "2024-01-01T00:00:00Z"


def test_query_equals_its_sql(spark, tmp_path):
    for folder in ("/root/testdata/sf0.001", saved(pages(spark), tmp_path, "pages")):
        files = "pages.parquet" if folder.startswith("/root") else "pages.parquet/*.parquet"
        duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{folder}/{files}'")
        got = op.query(spark, folder)
        assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(op.ORACLE).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall())
    assert op.derivatives(op.responses(pages(spark).limit(0))).count() == 0


def test_digests_are_of_bytes(spark, tmp_path):
    body = "Grüße".encode("latin-1")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + body
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
    r = op.read_warc(spark, str(tmp_path / "a.warc")).first()
    assert r.payload_digest == "sha256:" + hashlib.sha256(body).hexdigest() and r.block_digest == "sha256:" + hashlib.sha256(block).hexdigest()


def record(body: bytes, kind="resource", extra=b"") -> bytes:
    return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <%d>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), len(body), extra, len(body), body)


def plain_records(data: bytes):
    """Blocks of a file that is held whole."""
    while (data := data.lstrip(b"\r\n")).startswith(b"WARC/"):
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(head.partition(b"Content-Length: ")[2].split(b"\r\n")[0])
        yield rest[:n]
        data = rest[n:]


def test_streamed_records_equal_whole_ones(monkeypatch):
    """Chunks of any size, records that hold other records, members cut anywhere, padding and ends that come early."""
    inner = record(b"a\r\n\r\nWARC/1.1\r\n\r\n") + record(b"")
    bodies = [b"", b"x" * 5000, inner, gzip.compress(inner, mtime=0), b"\r\n\r\n" * 3, "ä".encode() * 700]
    whole = b"".join(map(record, bodies))
    kinds = {
        "plain": whole, "by record": b"".join(gzip.compress(record(b)) for b in bodies), "one member": gzip.compress(whole), "stored": gzip.compress(whole, 0),
        "odd members": b"".join(gzip.compress(whole[i : i + 777]) for i in range(0, len(whole), 777)), "padded": gzip.compress(whole) + b"\0" * 100,
    }
    assert list(plain_records(whole)) == bodies
    for size in (1, 2, 7, 1000, 1 << 20):
        monkeypatch.setattr(op, "CHUNK", size)
        for kind, data in kinds.items():
            assert [block for _, block in op.parsed(io.BytesIO(data))] == bodies, (size, kind)
    *most, last = (block for _, block in op.parsed(io.BytesIO(whole[:-1000])))
    assert most == bodies[:-1] and last == bodies[-1][:404]
    assert not list(op.parsed(io.BytesIO(b""))) and not list(op.parsed(io.BytesIO(b"no records" * 100)))


def test_memory_is_of_a_batch(tmp_path):
    """60 MB that are small as gzip, and a batch at a time."""
    with open(tmp_path / "a.warc.gz", "wb") as f:
        for i in range(60):
            f.write(gzip.compress(record(b"%d" % i * (1 << 19)), 1))
    tracemalloc.start()
    with open(tmp_path / "a.warc.gz", "rb") as f:
        counts = [b.num_rows for b in op.batches(f)]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(counts) == 60 and len(counts) > 5 and peak < 50 << 20


def test_codings_and_charsets(spark, tmp_path):
    text = "<p>Grüße</p>"
    raw, latin = text.encode(), text.encode("latin-1")
    chunked = lambda b: b"5;x=1\r\n" + b[:5] + b"\r\n%X\r\n" % len(b[5:]) + b[5:] + b"\r\n0\r\n\r\n"
    deflated = zlib.compressobj(wbits=-15)
    cases = [
        (b"Content-Type: text/html; charset=ISO-8859-1", latin),
        (b"Transfer-Encoding: chunked", chunked(raw)),
        (b"Content-Encoding: gzip", gzip.compress(raw)),
        (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(gzip.compress(raw))),
        (b"Content-Encoding: deflate", zlib.compress(raw)),
        (b"Content-Encoding: deflate", deflated.compress(raw) + deflated.flush()),
        (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", raw),
        (b"Content-Type: text/html;\r\n charset=\"latin1\"", latin),
        (b"Content-Type: text/html; charset=none-such", raw),
        (b"Content-Encoding: br", raw),
    ]
    for i, (fields, body) in enumerate(cases):
        http = b"HTTP/1.1 200 OK\r\n" + fields + b"\r\n\r\n" + body
        (tmp_path / f"{i}.warc").write_bytes(record(http, "response", b"WARC-Target-URI: u%d\r\n" % i))
    rows = op.read_warc(spark, str(tmp_path))
    got = {r.target_uri: r for r in rows.collect()}
    assert rows.rdd.getNumPartitions() == len(got) == len(cases)
    for i, (_, body) in enumerate(cases):
        assert got[f"u{i}"].payload == text and got[f"u{i}"].payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
