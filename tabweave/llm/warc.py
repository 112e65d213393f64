"""WARC derivatives: from response records to linked metadata and conversion records, in WARC files.

`read_responses` takes WARC files as they come (plain or gzip, any version), `page_responses` makes responses of bare
pages. Every response gets a `metadata` record (application/warc-fields: the source record's own header, the HTTP status
and headers, digests and length, the page's title and links) and, if it holds text, a `conversion` record. Both refer to
the response by the id that it has in its file. Their own ids follow from that one, so a job that runs again makes the
same records. Files hold one gzip member for each record, so any record can be read alone.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from typing import BinaryIO
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import page_text
from .shared import new_folder, small_batches, valid
from .token_files import _opened

#: The date of records whose source has none, and the headers of a source that is a bare page.
DATE = "1970-01-01T00:00:00Z"
BARE_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: A response: its record's id, address and date, its record's header lines, and the HTTP message.
RESPONSE = "record_id string, target_uri string, date string, headers string, block binary"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_digest string, block string"
#: A file takes no further record once it has so many bytes.
FILE_BYTES = 1 << 30
#: The header line by which a record tells the row of a table that it was made from.
ROW_NUMBER = "WARC-Source-Row"
#: Packed bytes that are read at a time.
STEP = 1 << 16
CUT = "the file ends within a record"
#: A body that is longer when unpacked has no conversion record.
MOST_INFLATED = 64 << 20
#: Names that Python's codecs know, but that are no character sets of pages.
_NO_CHARSETS = frozenset(("idna", "punycode", "undefined", "unicode-escape", "raw-unicode-escape", "mbcs", "oem"))
#: A host's address, and links whose whole address follows from it without a look at dots.
_HOST = re.compile(r"https?://[^\s/?#;@\[\]\\]+(?=[/?#]|$)")
_ROOTED = re.compile(r"(?:/[^\s/?#;.][^\s/?#;]*)+/?$|/$")
_WHOLE = re.compile(r"https?://[^\s/?#]+(?:[/?#]\S*)?$")
_CHARSET = re.compile(rb"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.IGNORECASE)


#: What 10 bits are in base 32.
_PAIRS = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]


def digest(data: bytes) -> str:
    bits = int.from_bytes(hashlib.sha1(data).digest())
    return "sha1:" + "".join([_PAIRS[bits >> at & 1023] for at in range(150, -1, -10)])


def own_id(kind: str, source: str) -> str:
    """The id of the record of a kind that is derived from a source: a UUID of version 5."""
    made = bytearray(hashlib.sha1(uuid.NAMESPACE_URL.bytes + f"{kind} {source}".encode("utf-8", "replace")).digest()[:16])
    made[6], made[8] = made[6] & 15 | 80, made[8] & 63 | 128
    h = made.hex()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _line(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split())


def _fields(lines: Iterable[str]) -> dict[str, str]:
    """Header lines by name in small letters; of repeated ones the first."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _inflated(file: BinaryIO) -> Iterator[bytes]:
    """A file's bytes in pieces; gzip, of one member or many, is told by its first bytes."""
    data = file.read(STEP)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = file.read(STEP)
        return
    member, begun = zlib.decompressobj(31), False
    while data or (data := file.read(STEP)):
        begun = True
        if out := member.decompress(data, 16 * STEP):
            yield out
        data = member.unconsumed_tail
        if member.eof:
            data, member, begun = member.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError(CUT)


def warc_records(file: BinaryIO) -> Iterator[tuple[list[str], bytes]]:
    """Header lines and block of each record of a file, one record at a time."""
    pieces, held, at = _inflated(file), b"", 0
    while True:
        while held[at : at + 1] in (b"\r", b"\n"):  # what separates records
            at += 1
        end = held.find(b"\r\n\r\n", at)
        bare = held.find(b"\n\n", at, end if end >= 0 else len(held))
        end, gap = (bare, 2) if bare >= 0 else (end, 4)
        if end < 0:
            piece = next(pieces, b"")
            if piece:
                held, at = held[at:] + piece, 0
                continue
            if at == len(held):
                return
            raise ValueError(CUT if held[at : at + 5] == b"WARC/" else f"not a WARC record: {held[at : at + 40]!r}")
        version, *rest = held[at:end].decode("utf-8", "replace").split("\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        lines: list[str] = []
        for line in rest:
            line = line.rstrip("\r")
            if line[:1] in (" ", "\t") and lines:
                lines[-1] += " " + line.strip()
            else:
                lines.append(line)
        at = end + gap
        given = next((x[15:].strip() for x in lines if x[:15].lower() == "content-length:"), "")
        if not (given.isascii() and given.isdigit()):
            raise ValueError(f"no length in the record {_fields(lines).get('warc-record-id', '')!r}: {given[:40]!r}")
        length = int(given)
        if len(held) - at >= length:
            block, at = held[at : at + length], at + length
        else:
            parts, size = [held[at:]], len(held) - at
            while size < length:
                if not (piece := next(pieces, b"")):
                    raise ValueError(CUT)
                parts.append(piece)
                size += len(piece)
            whole = b"".join(parts)
            block, held, at = whole[:length], whole[length:], 0
        yield lines, block


def record_bytes(header: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """A record in the form of WARC 1.1; its length is added to the header."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in header)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def split_message(block: bytes) -> tuple[str, list[str], bytes]:
    """Status line, header lines and body of an HTTP message; without a status line all is body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    at = [(i, len(gap)) for gap in (b"\r\n\r\n", b"\n\n") if (i := block.find(gap)) >= 0]
    end, gap = min(at, default=(len(block), 0))
    status, *lines = [_line(x) for x in block[:end].decode("utf-8", "replace").split("\n")]
    return status, [x for x in lines if ":" in x], block[end + gap :]


class _NoText(ValueError):
    """Why a body can't be read."""


_CHUNK = re.compile(rb"([0-9a-fA-F]{1,8})[^\r\n]{0,1024}\r?\n")


def _joined(body: bytes) -> tuple[bytes, bool]:
    """A body without the sizes of its chunks, and whether it is whole; one that isn't made of chunks stays as it is."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out), True
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1
    return (b"".join(out), False) if out and at >= len(body) else (body, True)


def _inflate(data: bytes, bits: int, most: int) -> tuple[bytes, bool]:
    """Unpacked data, of gzip all members, and whether it is whole. What follows a member and is none is padding."""
    out, size = [], 0
    while data:
        member = zlib.decompressobj(bits)
        try:
            got = member.decompress(data, most - size + 1)
        except zlib.error:
            if out:
                break
            raise
        out.append(got)
        size += len(got)
        if size > most:
            raise _NoText(f"longer than {most} bytes when unpacked")
        if not member.eof:
            return b"".join(out), False
        data = member.unused_data if bits > 15 else b""
    return b"".join(out), True


def _unpacked(body: bytes, fields: dict[str, str], most: int) -> tuple[bytes, bool]:
    """A body without its transfer and content encodings, and whether it is whole.

    One that is named packed but begins otherwise was unpacked before it was stored, and stays as it is.
    """
    transfer = [x.strip() for x in fields.get("transfer-encoding", "").lower().split(",")]
    codings = [x.strip() for x in fields.get("content-encoding", "").lower().split(",")] + [x for x in transfer if x != "chunked"]
    body, whole = _joined(body) if "chunked" in transfer else (body, True)
    for coding in reversed(codings):
        if coding in ("", "identity", "none", "binary") or not body:
            continue
        if coding in ("gzip", "x-gzip"):
            if body[:2] != b"\x1f\x8b":
                continue
            try:
                body, all_there = _inflate(body, 31, most)
            except zlib.error as e:
                raise _NoText(f"damaged {coding}") from e
            whole &= all_there
        elif coding == "deflate":
            for bits in (15, -15):
                try:
                    body, all_there = _inflate(body, bits, most)
                except zlib.error:
                    continue
                whole &= all_there
                break
        else:
            raise _NoText(f"unknown encoding {coding[:40]}")
    return body, whole


def _text(body: bytes, kind: str) -> str:
    """A body's text; a character set that isn't known or isn't one is UTF-8."""
    named = _CHARSET.search(kind.encode("utf-8", "replace")) or _CHARSET.search(body[:1024])
    name = named[1].decode().lower() if named else "utf-8"
    if name.replace("_", "-") not in _NO_CHARSETS:
        with suppress(LookupError, UnicodeError):
            return body.decode(name, "replace")
    return body.decode("utf-8", "replace")


def _resolved(uri: str, link: str) -> str:
    """A link's whole address; one that has a scheme and a host already, or can't be resolved, stands as it is."""
    if _WHOLE.match(link):
        return link
    if _ROOTED.match(link) and (host := _HOST.match(uri)):
        return host[0] + link
    try:
        return _line(urljoin(uri, link))
    except ValueError:
        return _line(link)


def derive(record_id: str | None, target_uri: str | None, date: str | None, headers: str | None, block: bytes | None, most: int = MOST_INFLATED) -> list[tuple]:
    """The metadata record of a response, and its conversion record if it holds text, as rows of RECORD.

    A text that can't be read has no conversion; the metadata's `conversion-note` says why, or that the body was cut short.
    """
    uri, date, block, source, lines = _line(target_uri or ""), date or DATE, block or b"", record_id or "", (headers or "").split("\n")
    held = _fields(lines)
    status, http, body = split_message(block)
    fields = _fields(http)
    kind = fields.get("content-type", "text/html").lower()
    source_digest = held.get("warc-payload-digest") or digest(body)
    page_id = int(held[ROW_NUMBER.lower()]) if held.get(ROW_NUMBER.lower(), "").lstrip("-").isdigit() else None

    meta = [("source-record-header", _line(x)) for x in lines if ":" in x] + [("source-status", status)] * bool(status) + [("source-header", x) for x in http]
    meta += [("source-payload-digest", source_digest), ("source-block-digest", held.get("warc-block-digest") or digest(block)), ("source-length", str(len(body)))]
    made, page = [], None
    if "html" in kind or "xml" in kind or kind.startswith("text/"):
        try:
            plain, whole = _unpacked(body, fields, most)
            page = _text(plain, kind)
            meta += [] if whole else [("conversion-note", "the body is cut short")]
        except _NoText as e:
            meta += [("conversion-note", str(e))]
    if page is not None:
        text, title, links = (page, "", []) if kind.startswith("text/plain") else page_text(page)
        data = text.encode("utf-8", "replace")
        own = own_id("conversion", source)
        of_text = digest(data)
        meta += [("conversion-id", own), ("conversion-digest", of_text)] + [("title", title)] * bool(title)
        meta += [("outlink", _resolved(uri, link)) for link in links]
        made = [("conversion", own, "text/plain; charset=utf-8", data, of_text)]
    fields_of = "".join([f"{k}: {v}\r\n" for k, v in meta]).encode("utf-8", "replace")
    made.insert(0, ("metadata", own_id("metadata", source), "application/warc-fields", fields_of, digest(fields_of)))
    return [(page_id, what, own, source, uri, date, content, len(data), sha, source_digest, data.decode()) for what, own, content, data, sha in made]


def derived_bytes(row: tuple) -> bytes:
    """A row of RECORD as a record."""
    page_id, kind, own, source, uri, date, content, _, block_digest, source_digest, block = row
    head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Refers-To", source), ("WARC-Refers-To-Date", date)]
    head += [("WARC-Refers-To-Target-URI", uri), ("WARC-Target-URI", uri)] if uri else []
    head += [("WARC-Block-Digest", block_digest), ("WARC-Source-Payload-Digest", source_digest)]
    head += [(ROW_NUMBER, str(page_id))] if page_id is not None else []
    return record_bytes([*head, ("Content-Type", content)], block.encode())


def derived_row(lines: list[str], block: bytes) -> tuple:
    """The same read back; a digest that doesn't fit is an error."""
    h = _fields(lines)
    if digest(block) != h["warc-block-digest"]:
        raise ValueError(f"damaged record {h['warc-record-id']}")
    page_id = h.get(ROW_NUMBER.lower())
    return (None if page_id is None else int(page_id), h["warc-type"], h["warc-record-id"], h["warc-refers-to"], h.get("warc-target-uri", ""), h["warc-date"], h["content-type"], len(block), h["warc-block-digest"], h["warc-source-payload-digest"], block.decode())


def response_bytes(record_id: str | None, target_uri: str | None, date: str | None, headers: str | None, block: bytes | None) -> bytes:
    """A row of RESPONSE as a record; lines that `headers` has already aren't made anew."""
    block = block or b""
    own = [(k.strip(), _line(v)) for k, colon, v in (x.partition(":") for x in (headers or "").split("\n")) if colon and k.strip().lower() != "content-length"]
    there = {k.lower() for k, _ in own}
    made = [("WARC-Type", "response"), ("WARC-Record-ID", record_id or ""), ("WARC-Date", date or DATE), ("WARC-Target-URI", _line(target_uri or "")), ("Content-Type", "application/http; msgtype=response")]
    made += [("WARC-Payload-Digest", digest(split_message(block)[2])), ("WARC-Block-Digest", digest(block))]
    return record_bytes([*((k, v) for k, v in made if k.lower() not in there and v), *own], block)


def page_responses(pages: DataFrame, payload: str = "html") -> DataFrame:
    """pages (page_id, url, payload, and date if there is one) as rows of RESPONSE.

    A payload that begins with `HTTP/` is a whole message, else the body of one. A null payload is empty, a null
    address has none, a null date is DATE. The record's id follows from the row, so repeated rows share it.
    """
    url, text = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col(payload).cast("string"), F.lit(""))
    page_id = F.col("page_id").cast("long")
    h = F.md5(F.concat_ws("\n", page_id.cast("string"), url, text))
    uuid_of = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    date = F.coalesce(F.col("date").cast("string"), F.lit(DATE)) if "date" in pages.columns else F.lit(DATE)
    block = F.when(text.startswith("HTTP/"), text).otherwise(F.concat(F.lit(BARE_HEADERS), text)).cast("binary")
    headers = F.when(page_id.isNull(), "").otherwise(F.concat(F.lit(f"{ROW_NUMBER}: "), page_id.cast("string")))
    return pages.select(F.concat(F.lit("<urn:uuid:"), uuid_of, F.lit(">")).alias("record_id"), url.alias("target_uri"), date.alias("date"), headers.alias("headers"), block.alias("block"))


class _Files:
    """Gzip members into files of a bounded size, each named anew."""

    def __init__(self, folder: str, name: str, level: int, most: int) -> None:
        self.folder, self.name, self.level, self.most, self.done, self.out, self.size = folder, name, level, most, [], None, 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.path, self.size = f"{self.folder}/{self.name}-{uuid.uuid4().hex}.warc.gz", 0
            self.out = _opened(self.path, "w")
        data = gzip.compress(record, self.level, mtime=0)
        self.out.write(data)
        self.size += len(data)
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append(self.path)
            self.out = None


def _written(source: DataFrame, rows_of: Callable[[pa.RecordBatch], Iterable[tuple]], records_of: Callable[..., Iterable[bytes]], folder: str, name: str, level: int, file_bytes: int) -> list[str]:
    """A task reports its files when they are whole, so those of a task that failed are never read. The driver gets one row for each file."""
    small_batches(source.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, name, level, file_bytes)
        for b in batches:
            for row in rows_of(b):
                for record in records_of(*row):
                    files.add(record)
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array(files.done, pa.string())], names=["path"])

    return sorted(r.path for r in source.mapInArrow(run, "path string").collect())


def _rows(b: pa.RecordBatch) -> Iterable[tuple]:
    return zip(*(c.to_pylist() for c in b.columns), strict=True)


def _in_files(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of RESPONSE in the files whose paths a batch holds."""
    for path in b.column(0).to_pylist():
        with _opened(path, "r") as f:
            yield from (row for lines, block in warc_records(f) if (row := _response(lines, block)) is not None)


def _as_responses(df: DataFrame) -> DataFrame:
    return df.select(*((valid(n) if t == "string" else F.col(n).cast(t)).alias(n) for n, _, t in (x.rpartition(" ") for x in RESPONSE.split(", "))))


def _paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(paths)), "i long, path string").repartitionByRange(max(1, min(len(paths), 100_000)), "i").select("path")


def _derived(*row: object) -> Iterable[bytes]:
    return map(derived_bytes, derive(*row))


def write_responses(responses: DataFrame, folder: str | None = None, level: int = 1, file_bytes: int = FILE_BYTES) -> list[str]:
    """Rows of RESPONSE to WARC files; returns their paths. No rows give no files; other columns are not read."""
    return _written(_as_responses(responses), _rows, lambda *row: [response_bytes(*row)], folder or new_folder(responses.sparkSession, "responses"), "responses", level, file_bytes)


def write_derivatives(responses: DataFrame, folder: str | None = None, level: int = 1, file_bytes: int = FILE_BYTES) -> list[str]:
    """Rows of RESPONSE to WARC files of their metadata and conversion records; returns their paths.

    A null block is an empty message, a null address an empty one, a null date DATE, a null id empty; repeated rows give
    repeated records of the same ids; no rows give no files; other columns are not read. A record's own block is held whole;
    of a compressed body no more than MOST_INFLATED bytes are. Bytes that aren't of the page's character set are U+FFFD.
    """
    return _written(_as_responses(responses), _rows, _derived, folder or new_folder(responses.sparkSession, "derived"), "derived", level, file_bytes)


def derive_files(spark: SparkSession, paths: list[str], folder: str | None = None, level: int = 1, file_bytes: int = FILE_BYTES) -> list[str]:
    """The same for the response records of WARC files, of which a task reads one after the other as a stream.

    Records of other types are passed over, repeated ones derived again, missing headers taken as null above; no paths give
    no files. A file that ends within a record, or holds a record without a length, is an error that names it.
    """
    return _written(_paths(spark, paths), _in_files, _derived, folder or new_folder(spark, "derived"), "derived", level, file_bytes) if paths else []


def _read(spark: SparkSession, paths: list[str], schema: str, row_of, size_of) -> DataFrame:
    """What row_of makes of the records of files; a file is read as a stream, a batch holds some megabytes or one row."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = [x.rpartition(" ") for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, _, t) in zip(zip(*rows, strict=True), columns, strict=True)], names=[n for n, _, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with _opened(path, "r") as f:
                    for lines, block in warc_records(f):
                        if (row := row_of(lines, block)) is None:
                            continue
                        rows.append(row)
                        held += size_of(row)
                        if held > 1 << 23:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    small_batches(spark)
    if not paths:
        return spark.createDataFrame([], schema)
    return _paths(spark, paths).mapInArrow(run, schema)


def _response(lines: list[str], block: bytes) -> tuple | None:
    h = _fields(lines)
    if h.get("warc-type", "").lower() != "response":
        return None
    return h.get("warc-record-id"), h.get("warc-target-uri", "").strip("<>"), h.get("warc-date"), "\n".join(lines), block


def read_responses(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The response records of WARC files, as rows of RESPONSE; other records are passed over.

    A header that is missing is null, an empty block empty; repeated records are repeated rows; a record is held whole, and
    no paths give no rows. A file that ends within a record, or holds a record without a length, is an error.
    """
    return _read(spark, paths, RESPONSE, _response, lambda r: len(r[4]))


def read_derivatives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of WARC files written by write_derivatives, as rows of RECORD."""
    return _read(spark, paths, RECORD, derived_row, lambda r: r[7])
