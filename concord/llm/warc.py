"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from.

Each response record yields one ``metadata`` record (application/warc-fields: the page's title, language
and links, and the source's own headers) and one ``conversion`` record (text/plain). Both carry
WARC-Refers-To with the response's id, its target URI and date, and the source's payload digest, and have
block digests of their own. Ids are derived from the source's id and digest, so a repeated task writes the
same records. Rows are independent: one pass, no shuffle.

A payload is read as its headers say: chunks are joined, gzip, deflate and zstd undone, and the charset is that of
the header, of a byte order mark or of a meta tag, in this order, else UTF-8. Only text has a conversion: pages lose
their tags, plain texts do not; images, archives and contents in an unknown encoding yield their metadata alone.

WARC files are read by streams: a compressed file is one task's, its members and records come one after the other
and one record is in memory at a time. Plain files are first looked through by hopping from header to header, and
are then read in runs of whole records by as many tasks as they are long. Records are written by Spark's text writer
with the record separator of the format, so the output goes through the cluster's own file system and commit
protocol; every part file is one WARC file. ``gzip_members`` gives each record as a gzip member of its own, for
stores that fetch single records.

Defined results: a page without a url has no target URI, and its records carry no such field; null html is a
response with an empty payload, whose conversion is empty; null ids hash as empty; repeated pages give repeated
records; an empty table gives none; a very long page is read whole; a body whose chunks or compression break off is
read as far as it goes; a page's links keep their order, ties and repeats included; other
columns may have any name and type. Header names are read in any case, with or without a space behind the colon;
a line that begins with white space continues the field before it.
"""

from __future__ import annotations

import base64
import codecs
import contextlib
import gzip
import hashlib
import html as entities
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import byte_texts, picked

CRLF = "\r\n"
SEPARATOR = "\r\n\r\n"
#: The date of responses whose source has none.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs

RECORD = (
    "page_id {id_type}, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, content_length long, block_digest string, source_payload_digest string, source_headers string, block string"
)

#: A head and what may stand in it. Its end tag may be left out: the first text or tag that belongs to a body
#: ends it too. A title without an end tag ends at the next tag; a script or the like at </head> or, as in a
#: body, with the page.
#: A tag up to its end: a quoted attribute may hold a >, one whose quote is not closed ends at the next >, and a tag
#: that is not closed at all ends before the next one.
_REST = r"""(?:[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+(?:>|(?=<))"""
_HEAD = rf"""<head(?=[\s/>]){_REST}(?>
    \s++
    | <!--.*?--> | <[!?][^>]*+>
    | <title(?=[\s/>]){_REST} (?: (?:(?!</(?:head|body|title)\b|<(?:body|title)\b).)*+ </title\s*> | [^<]*+ )
    | <(script|style|noscript|template|noframes)(?=[\s/>]){_REST} (?: .*?</\2\s*> | .*?(?=</head\s*>) | .*+ )
    | <(?:meta|link|base|basefont|bgsound|head|html)(?=[\s/>]){_REST}
    | </(?!(?:head|body|html|br)\b)[a-z][^>]*+>
)*+(?:</head\s*>)?"""
_DROPPED = re.compile(rf"(?isx)<!--.*?-->|<(script|style|noscript|template)\b{_REST}.*?(?:</\1\s*>|\Z)|{_HEAD}")
_BREAKS = re.compile(rf"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b{_REST}")
_TAG = re.compile(rf"(?s)<[a-zA-Z/!?]{_REST}")
_OPENING = {name: re.compile(rf"(?is)<{name}(?=[\s/>]){_REST}") for name in ("title", "html", "a")}
_TITLE_END = re.compile(r"(?i)</title\s*>")
_LANGUAGE = re.compile(r"""(?is)\slang\s*=\s*["']?([A-Za-z-]+)""")
_LINK = re.compile(r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SPACE = re.compile(r"[ \t\r\f\v ]+")


def digest(data: bytes) -> str:
    """The digest of a block as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(parts))}>"


def plain_text(page: str) -> str:
    """The readable text of a page: blocks on lines of their own, entities decoded, no empty lines."""
    closed = page.rfind("-->") + 3 if "-->" in page else 0
    if "<!--" in page[closed:]:  # a comment that never ends hides nothing
        page = page[:closed] + page[closed:].replace("<!--", " ")
    text = _TAG.sub("", _BREAKS.sub("\n", _DROPPED.sub(" ", page)))
    lines = (_SPACE.sub(" ", line).strip() for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def page_fields(page: str) -> list[tuple[str, str]]:
    """title, language and each outlink, one line each, as warc-fields."""
    fields = []
    if (opened := _OPENING["title"].search(page)) and (closed := _TITLE_END.search(page, opened.end())):
        fields.append(("title", " ".join(entities.unescape(_TAG.sub("", page[opened.end() : closed.start()])).split())))
    if (opened := _OPENING["html"].search(page)) and (found := _LANGUAGE.search(opened[0])):
        fields.append(("language", found[1].lower()))
    for tag in _OPENING["a"].finditer(page):
        if link := _LINK.search(tag[0]):
            target = " ".join(entities.unescape(next((g for g in link.groups() if g is not None), "")).split())
            fields.append(("outlink", target))
    return fields


def response(page_id, url: str | None, payload: bytes) -> dict:
    """A page as a response record: id, target, date, HTTP header block and payload."""
    headers = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}"
    payload_digest = digest(payload)
    name = "" if page_id is None else str(page_id)
    return {"record_id": urn("response", name, url or "", payload_digest), "target_uri": url, "date": DATE, "headers": headers, "payload": payload, "payload_digest": payload_digest}


def header_fields(head: bytes) -> dict[str, str]:
    """The named fields of a header block, by lower-cased name; the first of a repeated name counts."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name = line.split(":", 1)[0].strip().lower()
            fields.setdefault(name, line.split(":", 1)[1].strip())
    return fields


def _halves(data: bytes) -> tuple[bytes, bytes]:
    """A header block and what follows its empty line."""
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := data.find(mark)) >= 0]
    if not ends:
        return data, b""
    at, size = min(ends)
    return data[:at], data[at + size :]


def response_of(fields: dict[str, str], block: bytes) -> dict:
    """A response record as ``derivatives`` takes it, from its header fields and block."""
    http, payload = _halves(block)
    target = fields.get("warc-target-uri")
    return {"record_id": fields["warc-record-id"], "target_uri": target.strip("<>") if target else None, "date": fields.get("warc-date", DATE), "headers": http.decode("utf-8", "replace"), "payload": payload, "payload_digest": fields.get("warc-payload-digest") or digest(payload)}


def parse_response(record: bytes) -> dict:
    """A response record as it stands in a WARC file: WARC headers, HTTP headers and payload."""
    head, block = _halves(record)
    fields = header_fields(head)
    return response_of(fields, block[: int(fields["content-length"])])


#: What browsers read where these names stand.
CHARSETS = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "utf8": "utf-8", "shift-jis": "cp932", "shift_jis": "cp932", "gb2312": "gb18030", "gbk": "gb18030", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "x-sjis": "cp932", "iso-8859-9": "cp1254", "tis-620": "cp874"}
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_META = re.compile(rb"""(?is)<meta\b[^>]*?\bcharset\s*=\s*["']?\s*([\w.:-]+)""")
_CHARSET = re.compile(r"""(?i)\bcharset\s*=\s*["']?\s*([\w.:-]+)""")
#: Types whose payload is a page, and the other ones that are text.
PAGES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml", "")


def joined_chunks(body: bytes) -> bytes:
    """The data of a chunked body, as far as its chunks are whole; a body that has no chunks is its own data."""
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            break
        if size == 0:
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1
    return b"".join(out) if out else body


def uncompressed(body: bytes, encoding: str) -> bytes | None:
    """A body without one content encoding, as far as it goes; None for an encoding that is not known."""
    if encoding in ("", "identity"):
        return body
    if encoding in ("gzip", "x-gzip", "deflate"):
        for wbits in (31,) if "gzip" in encoding else (15, -15):  # some servers leave out deflate's own header
            found = _inflated_body(body, wbits)
            if found or not body:
                return found
        return body if "gzip" in encoding and body[:2] != b"\x1f\x8b" else b""  # crawlers may have undone it
    if encoding == "zstd":
        with contextlib.suppress(zstandard.ZstdError):
            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
        return b""
    return None


def _inflated_body(body: bytes, wbits: int) -> bytes:
    member, out = zlib.decompressobj(wbits), []
    with contextlib.suppress(zlib.error):
        for at in range(0, len(body), 1 << 16):
            out.append(member.decompress(body[at : at + (1 << 16)]))
    return b"".join(out)


def charset_of(content_type: str, body: bytes) -> str:
    """The name of the codec that a body is read by."""
    for mark, codec in _MARKS:
        if body.startswith(mark):
            return codec
    declared = _CHARSET.search(content_type)
    name = declared[1] if declared else (found[1].decode("ascii", "replace") if (found := _META.search(body[:4096])) else "utf-8")
    name = CHARSETS.get(name.lower(), name.lower())
    try:
        codecs.lookup(name)
    except (LookupError, ValueError):
        return "utf-8"
    return name


def text_of(headers: dict[str, str], payload: bytes) -> tuple[str, bool] | None:
    """The text of a payload and whether it is a page with tags; None for what is no text."""
    content_type = headers.get("content-type", "")
    kind = content_type.split(";")[0].strip().lower()
    if kind not in PAGES and not kind.startswith("text/"):
        return None
    body: bytes | None = joined_chunks(payload) if "chunked" in headers.get("transfer-encoding", "").lower() else payload
    for encoding in reversed([e.strip().lower() for e in headers.get("content-encoding", "").split(",")]):
        body = None if body is None else uncompressed(body, encoding)
    if body is None or not kind and b"\0" in body[:1024]:
        return None
    return body.decode(charset_of(content_type, body), "replace").removeprefix("\ufeff"), kind in PAGES


def derivatives(source: dict) -> list[dict]:
    """The metadata record of one response and, if it is text, its conversion record."""
    headers = header_fields(source["headers"].encode("utf-8", "replace"))
    found = text_of(headers, source["payload"])
    page, tagged = found or ("", False)
    fields = [("source-" + name, value) for name, value in headers.items()]
    metadata = "".join(f"{name}: {value}{CRLF}" for name, value in [*(page_fields(page) if tagged else []), *fields])
    blocks = [("metadata", "application/warc-fields", metadata)]
    if found:
        text = plain_text(page) if tagged else "\n".join(line.rstrip() for line in page.splitlines())
        blocks.append(("conversion", "text/plain; charset=utf-8", text))
    out = []
    for kind, content_type, block in blocks:
        data = block.encode("utf-8", "replace")
        out.append({"warc_type": kind, "record_id": urn(kind, source["record_id"], source["payload_digest"]), "refers_to": source["record_id"], "target_uri": source["target_uri"], "warc_date": source["date"], "content_type": content_type, "content_length": len(data), "block_digest": digest(data), "source_payload_digest": source["payload_digest"], "source_headers": source["headers"], "block": block})
    return out


NAMES = ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_payload_digest", "source_headers", "block")


def _batch(first: pa.Array, name: str, made: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r[n] for r in made], pa.int64() if n == "content_length" else pa.string()) for n in NAMES]
    return pa.RecordBatch.from_arrays([first, *columns], names=[name, *NAMES])


def build(pages: DataFrame) -> DataFrame:
    """Both derivative records of every row of ``pages`` (page_id, url, html)."""
    own = picked(pages, "page_id", "url", "html")
    schema = RECORD.format(id_type=own.schema["page_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], []
            for i, (page_id, url, html) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2)))):
                for record in derivatives(response(page_id, url, html or b"")):
                    rows.append(i)
                    made.append(record)
            yield _batch(batch.column(0).take(pa.array(rows, pa.int64())), "page_id", made)

    return own.mapInArrow(run, schema)


#: Bytes of whole records of a plain file that one task reads.
RUN_BYTES = 64 << 20


def build_from_files(spark: SparkSession, path: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The derivative records of every response record in the WARC files at ``path``, with the file's name as ``source_file``.

    Other record types are left alone. A file is read through a stream, a record at a time.
    """
    files = spark.read.format("binaryFile").load(path).select("path")  # the contents are not read here
    schema = "source_file string, " + RECORD.split(", ", 1)[1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [(name, *run) for name in batch.column(0).to_pylist() for run in record_runs(name, run_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.string()), *(pa.array([r[i] for r in runs], pa.int64()) for i in (1, 2))], names=["path", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(name) as stream:
                    if first:
                        stream.seek(first)
                    for fields, block in records_of(stream, last):
                        if fields.get("warc-type", "").lower() == "response":
                            made = derivatives(response_of(fields, block))
                            yield _batch(pa.array([name] * len(made), pa.string()), "source_file", made)

    spread = spark.sparkContext.defaultParallelism
    runs = files.repartition(spread).mapInArrow(cut, "path string, first long, last long")
    return runs.repartition(spread, "path", "first").mapInArrow(run, schema)


@contextlib.contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    """A file of any file system that its workers reach as a stream of its records, gzip members undone."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        name = "/" + rest.lstrip("/")
        system, name = fs.LocalFileSystem(), name if os.path.exists(name) else unquote(name)
    else:
        system, name = fs.FileSystem.from_uri(quote(path, safe=":/%@?=&"))
    with system.open_input_file(name) as raw:
        packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        with io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else _Raw(raw), 1 << 20) as stream:
            yield stream


class _Raw(io.RawIOBase):
    """A file of a file system as one that can be buffered."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)

    def seek(self, at: int, whence: int = 0) -> int:
        return self.file.seek(at, whence)

    def tell(self) -> int:
        return self.file.tell()


def record_runs(path: str, run_bytes: int) -> Iterator[tuple[int, int | None]]:
    """Where runs of whole records of about ``run_bytes`` begin and end in a file; a compressed one is one run."""
    with opened(path) as stream:
        if isinstance(stream.raw, gzip.GzipFile):
            yield 0, None
            return
        first = 0
        while True:
            fields = _header(stream)
            if fields is None:
                break
            stream.seek(int(fields["content-length"]), 1)
            if stream.tell() - first >= run_bytes:
                yield first, stream.tell()
                first = stream.tell()
        yield first, None


def _header(stream: BinaryIO) -> dict[str, str] | None:
    """The fields of the next record's header; None at the end."""
    line = stream.readline()
    while line in (b"\n", b"\r\n", b"\r"):  # what separates records
        line = stream.readline()
    if not line:
        return None
    lines = [line]
    while (line := stream.readline()) not in (b"\n", b"\r\n"):
        if not line:
            raise ValueError("a record has no end of its header")
        lines.append(line)
    return header_fields(b"".join(lines))


def records_of(stream: BinaryIO, last: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields, by lower-cased name, and the block of each record from where a stream is, up to ``last``."""
    while last is None or stream.tell() < last:
        fields = _header(stream)
        if fields is None:
            return
        yield fields, stream.read(int(fields["content-length"]))


def inflated(data: bytes | memoryview | pa.Buffer) -> bytes:
    """A file's records, whether it is plain or one or many gzip members."""
    data = memoryview(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        return bytes(data)
    out = []
    while len(data):
        member = zlib.decompressobj(31)
        out += [member.decompress(data), member.flush()]
        rest = len(member.unused_data)
        data = data[len(data) - rest :] if rest else data[:0]
    return b"".join(out)


def serialized(records: DataFrame) -> DataFrame:
    """``value``: each record as text, without the separator that ends it. Line breaks in a field become spaces; null fields are left out."""
    line = lambda name, column: F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(column.cast("string"), r"[\r\n]+", " "), F.lit(CRLF)), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length")),
        F.lit(CRLF),
    )
    return records.select(F.concat(head, "block").alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the records as WARC files, one for each partition."""
    serialized(records).write.mode("overwrite").option("lineSep", SEPARATOR).option("compression", compression).text(path)


def gzip_members(records: DataFrame) -> DataFrame:
    """``member``: each record, with its separator, as a gzip member; members one after the other are a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [gzip.compress(text + SEPARATOR.encode(), mtime=0) for text in byte_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    return serialized(records).mapInArrow(run, "member binary")


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields, by lower-cased name, and the block of each record of one uncompressed WARC file."""
    return records_of(io.BytesIO(data))
