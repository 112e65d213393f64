"""WARC derivatives against files made and read by other code."""

import base64
import gzip
import hashlib
import re
import zlib

import pytest

from tabweave.llm.warc import DATE, _resolved, derive, derive_files, derived_bytes, derived_row, page_responses, read_derivatives, read_responses, split_message, warc_records, write_derivatives, write_responses


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind, rid, block, *more, version="1.0"):
    head = "".join(f"{k}: {v}\r\n" for k, v in (("WARC-Type", kind), ("WARC-Record-ID", rid), *more, ("content-length", len(block))))
    return f"WARC/{version}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


HTML = "<html><head><title>Caf\u00e9 &amp; more</title></head><body><p>One two<br>three <a href='../x?y=1'>link</a><script>no()</script></body></html>"
PACKED = gzip.compress(HTML.encode())
CHUNKED = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(PACKED[i : i + 50]), PACKED[i : i + 50]) for i in range(0, len(PACKED), 50)) + b"0\r\n\r\n"
RESPONSES = [
    ("<urn:uuid:a>", b"HTTP/1.1 200 OK\r\nServer: x: y\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + HTML.encode(), (("WARC-Date", "2024-01-02T03:04:05Z"), ("WARC-Target-URI", "http://e.org/a/b"), ("WARC-Payload-Digest", "sha1:GIVEN"), ("WARC-IP-Address", "10.0.0.1")), "One two\nthree link"),
    ("<urn:uuid:b>", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + CHUNKED, (("WARC-Date", "2024-01-02T03:04:06Z"), ("WARC-Target-URI", "<http://e.org/c>")), "One two\nthree link"),
    ("<urn:uuid:c>", b"HTTP/1.0 404 Not Found\nContent-Type: text/html; charset=latin-1\n\n<p>caf\xe9", (("WARC-Date", "2024-01-02T03:04:07Z"),), "caf\u00e9"),
    ("<urn:uuid:d>", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG<p>no", (), None),
    ("<urn:uuid:e>", b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\na <b> c", (), "a <b> c"),
    ("<urn:uuid:f>", b"", (), ""),
]


def source_file():
    parts = [record("warcinfo", "<urn:uuid:w>", b"software: other\r\n")]
    for rid, block, more, _ in RESPONSES:
        parts.append(record("request", rid.replace("uuid:", "uuid:q"), b"GET / HTTP/1.1\r\n\r\n"))
        parts.append(record("response", rid, block, *more, ("X-Folded", "one\r\n two")))
    return parts


def split_records(data):
    """Records by a reader of its own, which trusts lengths alone."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        out.append((fields, rest[:n]))
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = rest[n + 4 :]
    return out


@pytest.mark.parametrize("form", ["members", "one member", "plain"])
def test_derivatives_of_a_file(spark, tmp_path, form):
    parts = source_file()
    data = b"".join(map(gzip.compress, parts)) if form == "members" else gzip.compress(b"".join(parts)) if form == "one member" else b"".join(parts)
    path = tmp_path / "in.warc.gz"
    path.write_bytes(data)
    responses = read_responses(spark, [f"file://{path}"])
    assert sorted((r.record_id, bytes(r.block)) for r in responses.collect()) == [(rid, block) for rid, block, _, _ in RESPONSES]
    files = write_derivatives(responses, f"file://{tmp_path}/out", file_bytes=1)
    assert len(files) == 11
    found = {}
    for f in files:
        raw = open(f.removeprefix("file://"), "rb").read()
        for fields, block in split_records(gzip.decompress(raw)):
            assert fields["WARC-Block-Digest"] == sha(block)
            found[fields["WARC-Refers-To"], fields["WARC-Type"]] = fields, block.decode()
    for rid, block, more, text in RESPONSES:
        fields, meta = found[rid, "metadata"]
        body = re.split(rb"\r\n\r\n|\n\n", block, maxsplit=1)[-1]
        given = dict(more)
        payload = given.get("WARC-Payload-Digest", sha(body))
        assert fields["WARC-Date"] == given.get("WARC-Date", DATE) and fields["WARC-Source-Payload-Digest"] == payload
        assert fields.get("WARC-Target-URI") == (given["WARC-Target-URI"].strip("<>") if "WARC-Target-URI" in given else None)
        lines = meta.split("\r\n")
        assert "source-record-header: X-Folded: one two" in lines and f"source-payload-digest: {payload}" in lines and f"source-block-digest: {sha(block)}" in lines and f"source-length: {len(body)}" in lines
        assert all(f"source-record-header: {k}: {v}" in lines for k, v in more)
        http = [x.strip().decode() for x in re.split(rb"\r\n\r\n|\n\n", block, maxsplit=1)[0].split(b"\n")] if block else []
        assert (f"source-status: {http[0]}" in lines if http else True) and all(f"source-header: {x}" in lines for x in http[1:])
        if text is None:
            assert (rid, "conversion") not in found and not any(x.startswith("conversion-id") for x in lines)
            continue
        head, plain = found[rid, "conversion"]
        assert plain == text and f"conversion-id: {head['WARC-Record-ID']}" in lines and head["Content-Type"].startswith("text/plain") and head["WARC-Record-ID"] != fields["WARC-Record-ID"]
    assert "title: Caf\u00e9 & more" in found["<urn:uuid:a>", "metadata"][1] and "outlink: http://e.org/x?y=1" in found["<urn:uuid:a>", "metadata"][1]
    assert read_derivatives(spark, files).count() == 11
    by_files = read_derivatives(spark, derive_files(spark, [f"file://{path}"])).collect()
    assert sorted(map(tuple, by_files), key=str) == sorted(map(tuple, read_derivatives(spark, files).collect()), key=str)


def test_links_resolve_as_usual():
    import itertools
    from urllib.parse import urljoin

    for uri, link in itertools.product(("http://a.org", "https://a.org/x/y?q#f", "http://a.org?x", "ftp://a/b", "", "no", "http://u@h/x"), ("/", "/a", "/a/b/", "/a//b", "/../c", "/.x", "//h/p", "b", "?q", "#f", "/a?b=1", "/a;p", "/\u00e9,.")):
        assert _resolved(uri, link) == urljoin(uri, link), (uri, link)
    assert _resolved("http://a.org", "https://x.org/../y") == "https://x.org/../y" and _resolved("http://a", "http://[x") == "http://[x"


def test_records_longer_than_a_step(tmp_path):
    blocks = [b"x" * n for n in (0, 1, 65_535, 65_536, 3_000_000, 7)]
    parts = [record("resource", f"<urn:{i}>", b) for i, b in enumerate(blocks)]
    for data in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts)), b"".join(p.replace(b"\r\n", b"\n") for p in parts)):
        (tmp_path / "long").write_bytes(data)
        with open(tmp_path / "long", "rb") as f:
            assert [b for _, b in warc_records(f)] == blocks


def test_damaged_files(tmp_path):
    for data, what in ((b"".join(source_file())[:-20], "ends within"), (gzip.compress(b"".join(source_file()))[:-20], "ends within"), (b"GET / HTTP", "not a WARC")):
        path = tmp_path / "bad"
        path.write_bytes(data)
        with open(path, "rb") as f, pytest.raises(ValueError, match=what):
            list(warc_records(f))
    row = derive("<x>", None, None, None, b"<p>b d")[1]
    path.write_bytes(derived_bytes(row).replace(b"b d", b"b e"))
    with open(path, "rb") as f, pytest.raises(ValueError, match="damaged"):
        [derived_row(*x) for x in warc_records(f)]
    assert split_message(b"no status") == ("", [], b"no status") and zlib.crc32(b"") == 0


def test_pages(spark):
    rows = [(1, "http://a.org/", "<p>x</p>"), (1, "http://a.org/", "<p>x</p>"), (2, None, None), (None, "u v\r\nw: q", ""), (3, "http://[bad", "<a href='//[x'>q</a>"), (4, "http://b.org", "<p>" + "long text " * 200_000 + "</p>"), (5, "http://c.org", "HTTP/1.1 500 No\r\nContent-Type: text/html\r\n\r\n<p>whole")]
    pages = spark.createDataFrame([(*r, 5, "k") for r in rows], "page_id long, url string, html string, block int, record_id string")
    files = write_responses(page_responses(pages))
    sources = {r.record_id: r for r in read_responses(spark, files).collect()}
    got = read_derivatives(spark, write_derivatives(read_responses(spark, files))).collect()
    assert len(sources) == 6 and all(re.fullmatch("<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", x) for x in sources)
    assert sorted((str(r.page_id), r.record_type) for r in got) == sorted((str(i), k) for i, _, _ in rows for k in ("metadata", "conversion"))
    assert all(r.refers_to in sources for r in got)  # every source stands in a file
    text = {r.page_id: r.block for r in got if r.record_type == "conversion"}
    assert text == {1: "x", 2: "", None: "", 3: "q", 4: ("long text " * 200_000).strip(), 5: "whole"}
    assert all(r.source_digest == sha(split_message(bytes(sources[r.refers_to].block))[2]) for r in got)
    assert write_responses(page_responses(pages.where("false"))) == [] and read_derivatives(spark, []).count() == read_responses(spark, []).count() == 0


PAGE = b"<p>one two</p>"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html%s\r\n%s\r\n"
TWO = gzip.compress(b"<p>one ") + gzip.compress(b"two</p>")


def told(block, most=1 << 20):
    """The text, or None, and the note of a response."""
    rows = derive("<urn:x>", "http://e.org/", None, "", block, most)
    note = re.findall("conversion-note: (.*)\r\n", rows[0][-1])
    assert len(rows) == 2 or "conversion-id" not in rows[0][-1]
    return rows[1][-1] if len(rows) == 2 else None, note


@pytest.mark.parametrize("name", ["idna", "undefined", "punycode", "unicode_escape", "raw-unicode-escape", "hex", "base64", "rot13", "zlib", "mbcs", "nothing", "x" * 400, "utf-16\x00", "K"])
def test_odd_character_sets_are_utf8(name):
    assert told(HEAD % (b"; charset=" + name.encode(), b"") + PAGE)[1] == []
    assert "one two" in told(HEAD % (b"", b"") + f"<meta charset={name}>".encode() + PAGE)[0] or name.startswith("utf-16")


def test_character_sets():
    for name in ("latin-1", "windows-1252", "utf-8", "koi8-r", "shift_jis", "euc-kr", "gb18030", "big5", "utf-16", "utf-7"):
        assert told(HEAD % (f"; charset={name}".encode(), b"") + "<p>one two</p>".encode(name))[0] == "one two"


def test_encodings_of_bodies():
    import zstandard

    raw = zlib.compressobj(wbits=-15)
    bodies = {
        b"gzip": [(gzip.compress(PAGE), "one two", []), (TWO, "one two", []), (TWO + b"\0\0\0", "one two", []), (PAGE, "one two", []), (gzip.compress(PAGE)[:-9], "one two", ["the body is cut short"]), (b"\x1f\x8b nothing", None, ["damaged gzip"]), (b"", "", [])],
        b"x-gzip, identity": [(TWO, "one two", [])],
        b"gzip, gzip": [(gzip.compress(TWO), "one two", [])],
        b"deflate": [(zlib.compress(PAGE), "one two", []), (raw.compress(PAGE) + raw.flush(), "one two", []), (PAGE, "one two", [])],
        b"deflate, gzip": [(gzip.compress(zlib.compress(PAGE)), "one two", [])],
        b"br": [(b"\x0b\x02\x80abc\x03", None, ["unknown encoding br"])],
        b"zstd": [(zstandard.compress(PAGE), None, ["unknown encoding zstd"])],
    }
    for coding, cases in bodies.items():
        for body, text, note in cases:
            found = told(HEAD % (b"", b"Content-Encoding: " + coding + b"\r\n") + body)
            assert found[1] == note and (found[0] == text or note and text and text.startswith(found[0])), (coding, body)
    whole = HEAD % (b"", b"Transfer-Encoding: gzip, chunked\r\n")
    assert told(whole + b"%x\r\n%s\r\n0\r\n\r\n" % (len(TWO), TWO)) == ("one two", [])
    assert told(whole + b"%x\r\n%s" % (len(TWO), TWO[:20]))[1] == ["the body is cut short"]


def test_an_unpacked_body_is_bounded():
    bomb = gzip.compress(b"<p>" + b"x" * 5_000_000)
    assert told(HEAD % (b"", b"Content-Encoding: gzip\r\n") + bomb) == (None, ["longer than 1048576 bytes when unpacked"])
    assert len(told(HEAD % (b"", b"Content-Encoding: gzip\r\n") + bomb, 5_000_003)[0]) == 5_000_000
    many = b"".join([gzip.compress(b"y" * 100_000)] * 20)
    assert told(HEAD % (b"", b"Content-Encoding: gzip\r\n") + many)[0] is None


def test_a_record_without_a_length_is_named(tmp_path):
    for header in (b"", b"Content-Length: x\r\n", b"Content-Length: -4\r\n"):
        (tmp_path / "odd").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:odd>\r\n" + header + b"\r\nabcd\r\n\r\n")
        with open(tmp_path / "odd", "rb") as f, pytest.raises(ValueError, match="urn:uuid:odd"):
            list(warc_records(f))


def test_one_odd_page_does_not_end_the_job(spark):
    rows = [(1, "http://a.org/", "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<meta charset=idna><p>one"), (2, "http://a.org/", "HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\n<p>two"), (3, "http://a.org/", "<p>three")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = read_derivatives(spark, write_derivatives(page_responses(pages))).collect()
    assert {r.page_id: r.block for r in got if r.record_type == "conversion"} == {1: "one", 3: "three"}
    assert sum("conversion-note: unknown encoding br" in r.block for r in got) == 1
