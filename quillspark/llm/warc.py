"""WARC derivatives: each response becomes a linked metadata record and a plain-text conversion record.

Both carry WARC-Refers-To (the response's id), its target URI and date; the metadata block lists the source's HTTP status
and headers, title, language, outgoing links and payload digest; the conversion block is the page's text. Record ids are derived
from the response's id and the record type, so that runs agree; digests are SHA-1 in base 32, of the payload as it was stored.

The payload is unchunked and decompressed as its headers say, and decoded by the charset of the header, else of a byte order mark, else of
a meta tag, else as UTF-8. Every pattern stops at the next tag, and what is hidden is passed over in one scan forward, so that
pages take time in proportion to their length, however broken.

Defined cases: a null payload is empty (digest of no bytes, empty text); responses without an id get none referred to; an unknown charset
counts as none; an encoding that cannot be undone leaves an empty text and a `content-not-decoded` field; an unclosed comment, script or
style hides the rest of the page, other unclosed elements hide nothing; a tag without its end goes up to the next one; empty tables give
none; repeated rows give repeated records; other columns, also of clashing names, are ignored, but page_id is kept. A record is one row.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_hidden = re.compile(r"(?i)<!--|<(script|style|noscript|template|svg)\b")
_close = {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "noscript", "template", "svg")}
_block = re.compile(r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|nav|footer|header|main|aside|blockquote|pre|hr|dd|dt|dl|title|body|html)\b[^<>]*(?:>|(?=<)|\Z)")
_tag = re.compile(r"<[a-zA-Z/!?][^<>]*(?:>|(?=<)|\Z)")
_space = re.compile(r"[^\S\n]+")
_lines = re.compile(r" ?\n[ \n]*")
_title = re.compile(r"(?i)<title\b[^<>]*>")
_title_end = re.compile(r"(?i)</title\s*>")
_lang = re.compile(r"""(?i)<html\b[^<>]*?\slang\s*=\s*["']?([A-Za-z-]+)""")
_href = re.compile(r"""(?i)<a\b[^<>]*?\shref\s*=\s*["']?([^"'\s<>]+)""")
_meta_charset = re.compile(rb"""(?i)<meta\b[^<>]*?charset\s*=\s*["']?([A-Za-z0-9_.:-]{1,40})""")
_head_charset = re.compile(r"""(?i)charset\s*=\s*["']?([A-Za-z0-9_.:-]{1,40})""")


def visible(page: str) -> str:
    """The page without comments and elements that are not shown, found in one scan forward."""
    out, at, never = [], 0, set()
    while m := _hidden.search(page, at):
        name = (m[1] or "").lower()
        if not name:
            stop = page.find("-->", m.end())
            stop = stop + 3 if stop >= 0 else len(page)
        else:
            shut = None if name in never else _close[name].search(page, m.end())
            if not shut and name not in ("script", "style"):
                never.add(name)  # no end from here on: a tag like others
                out.append(page[at : m.end()])
                at = m.end()
                continue
            stop = shut.end() if shut else len(page)
        out += [page[at : m.start()], " "]
        at = stop
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """Visible text, one block a line."""
    text = _block.sub("\n", visible(page))
    text = html.unescape(_tag.sub("", text))
    return _lines.sub("\n", _space.sub(" ", text)).strip()


def header(head: str | None, name: str) -> str:
    """The value of an HTTP header, the last of that name."""
    found = ""
    for line in (head or "").splitlines()[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name:
            found = value.strip()
    return found


def _unchunk(data: bytes) -> bytes:
    """Chunked transfer coding undone; data that is not chunked stays as it is."""
    out, at = [], 0
    while at < len(data):
        stop = data.find(b"\r\n", at, at + 40)
        size = data[at:stop].partition(b";")[0].strip() if stop >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(out) if out else data
        n = int(size, 16)
        if n == 0:
            break
        out.append(data[stop + 2 : stop + 2 + n])
        at = stop + 4 + n
    return b"".join(out)


def _inflate(data: bytes, bits: int) -> bytes:
    """As much as can be decompressed; raises if nothing can."""
    out = []
    while data:
        d = zlib.decompressobj(bits)
        try:
            out.append(d.decompress(data))
        except zlib.error:
            if out:
                break
            raise
        data = d.unused_data if d.eof and bits == 31 else b""
    return b"".join(out)


def body_of(head: str | None, payload: bytes) -> tuple[bytes, str]:
    """The payload without its codings, and the coding that could not be undone, if any."""
    if "chunked" in header(head, "transfer-encoding").lower():
        payload = _unchunk(payload)
    for name in reversed([x.strip().lower() for x in header(head, "content-encoding").split(",") if x.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                payload = _inflate(payload, 31) if payload[:2] == b"\x1f\x8b" else payload
            elif name == "deflate":
                try:
                    payload = _inflate(payload, 15)
                except zlib.error:
                    payload = _inflate(payload, -15)
            elif name == "zstd":
                import zstandard

                payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
            elif name != "identity":
                return b"", name
        except Exception:  # of three libraries: broken data
            return b"", name
    return payload, ""


def decode(head: str | None, body: bytes, charset: str | None = None) -> str:
    """The page as text, by the charset given, of the header, of a byte order mark or of a meta tag, else UTF-8."""
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    told, meta = _head_charset.search(header(head, "content-type")), _meta_charset.search(body[:4096])
    for name in (charset, told and told[1], next((n for m, n in marks if body.startswith(m)), None), meta and meta[1].decode()):
        try:
            if name and codecs.lookup(name)._is_text_encoding:
                name = codecs.lookup(name).name
                # as browsers read these names
                return body.decode({"iso8859-1": "cp1252", "ascii": "cp1252", "utf-8": "utf-8-sig"}.get(name, name), "replace")
        except (LookupError, UnicodeError):
            pass
    return body.decode("utf-8-sig", "replace")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(parts).encode('utf-8', 'surrogatepass')).digest(), version=4)}>"


FIELDS = [("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("block", pa.string())]
RECORD = "struct<warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, block string>"


def derivatives(ref: str | None, uri: str | None, date: str | None, head: str | None, payload: bytes | None, charset: str | None = None) -> list[tuple]:
    """The metadata record and the conversion record of one response."""
    payload = payload or b""
    body, failed = body_of(head, payload)
    page = decode(head, body, charset)
    source = digest(payload)
    title, lang = _title.search(page), _lang.search(page)
    fields = [("fetched-from", uri or ""), ("source-payload-digest", source)]
    for k, line in enumerate(x for x in (head or "").splitlines() if x.strip()):
        fields.append(("http-status-line" if k == 0 else "http-header", line))
    if failed:
        fields.append(("content-not-decoded", failed))
    shut = title and _title_end.search(page, title.end())
    title = page[title.end() : shut.start()] if shut else ""
    if title:
        fields.append(("title", " ".join(html.unescape(title).split())))
    if lang:
        fields.append(("language", lang[1]))
    fields += [("outlink", html.unescape(x)) for x in _href.findall(page)]
    meta, text = "".join(f"{k}: {v}\r\n" for k, v in fields), plain_text(page)
    out = []
    for kind, mime, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        raw = block.encode("utf-8", "surrogatepass")
        out.append((kind, record_id(kind, ref or "", uri or "", source), ref, uri, date, mime, source, digest(raw), len(raw), block))
    return out


def derive(responses: DataFrame) -> DataFrame:
    """responses(record_id, target_uri, warc_date, http_head, payload): two records each, with the response's other columns dropped."""

    @F.arrow_udf(f"array<{RECORD}>")
    def run(ref: pa.Array, uri: pa.Array, date: pa.Array, head: pa.Array, payload: pa.Array) -> pa.Array:
        names = [n for n, _ in FIELDS]
        rows = [[dict(zip(names, r)) for r in derivatives(*(x.as_py() for x in row))] for row in zip(ref, uri, date, head, payload)]
        return pa.array(rows, pa.list_(pa.struct(FIELDS)))

    keep = [c for c in responses.columns if c == "page_id"]
    made = responses.select(*keep, F.explode(run("record_id", "target_uri", "warc_date", "http_head", "payload")).alias("r"))
    return made.select(*keep, "r.*")


def responses_from_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """pages(page_id, url, html) as response records; the table holds no headers, so a plain one is given."""
    h = F.md5(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))))
    urn = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")
    return pages.select("page_id", urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_head"), F.col("html").cast("binary").alias("payload"))


def parse_warc(data: bytes | BinaryIO) -> Iterator[dict]:
    """Records of a WARC file, gzip or not, one after the other: headers, and for responses the HTTP head and payload."""
    raw = io.BufferedReader(data) if isinstance(data, io.RawIOBase) else io.BufferedReader(io.BytesIO(data)) if isinstance(data, bytes) else data
    start = raw.peek(2)[:2] if hasattr(raw, "peek") else b""
    file = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if start == b"\x1f\x8b" else raw
    try:
        while line := file.readline(1 << 16):
            if not line.startswith(b"WARC/"):
                continue
            fields = {}
            while (line := file.readline(1 << 16)) and line.strip():
                k, _, v = line.decode("utf-8", "replace").partition(":")
                fields[k.strip().lower()] = v.strip()
            size = fields.get("content-length", "")
            body = file.read(int(size)) if size.isdigit() else b""
            head, _, payload = body.partition(b"\r\n\r\n") if fields.get("warc-type") == "response" else (b"", b"", body)
            yield {"warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "warc_date": fields.get("warc-date"), "http_head": head.decode("latin-1"), "payload": payload}
    except (EOFError, zlib.error, gzip.BadGzipFile):  # a file that breaks off: what came before it stays
        return


WARC_ROW = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, http_head string, payload binary"
#: Bytes of payload in one batch of records.
BATCH = 4 << 20


def read_warc(spark: SparkSession, path: str, streamed: bool = True) -> DataFrame:
    """All records under path. Spark lists the files; a task reads its files record by record, so that memory follows the record.

    streamed=False reads each file whole through Spark, for stores that only Spark reaches; Spark bounds such a file to 2 GB.
    """
    kinds = pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in (x.split()[0] for x in WARC_ROW.split(", "))])

    def run(batches):
        for b in batches:
            for at in b.column(0).to_pylist():
                if streamed:
                    from pyarrow import fs

                    store, name = fs.FileSystem.from_uri(at.replace("file:/", "file:///", 1) if at.startswith("file:/") and not at.startswith("file://") else at)
                    source = io.BufferedReader(store.open_input_stream(name, compression=None))
                else:
                    source = at
                rows, held = [], 0
                for record in parse_warc(source):
                    rows.append(record)
                    held += len(record["payload"])
                    if held >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path" if streamed else "content").mapInArrow(run, WARC_ROW)


def record_text() -> Column:
    """A derived record as WARC text, without the two line ends that close it."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(name + ": "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    return F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"), line("WARC-Block-Digest", "block_digest"), line("WARC-Payload-Digest", "payload_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length"), F.lit("\r\n"), F.col("block"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC text files."""
    records.select(record_text().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return derive(responses_from_pages(pages))
