"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record (WARC/1.1) gives two linked records. The metadata record
(application/warc-fields) keeps what the HTTP header said and what the payload
is: status, content type, charset, length, digests, title, number of links. The
conversion record (text/plain) holds the payload's text. Both name the response
in WARC-Refers-To, repeat its target URI and date, and carry digests of their
own blocks; the source's block and payload digests and every line of the source's
HTTP header, repeated ones too, are preserved in the metadata, byte for byte. Record
ids are derived from the response's id and the record's type, so that a rerun writes
the same files. Chunked and gzip or deflate bodies are undone before the text is taken.

`responses` builds response records from pages; `derive` works on the bytes of
records from anywhere, row by row, without a shuffle.

Defined results: a null html is an empty payload, a null URL an empty target; line
ends in a header value are written as %0D and %0A, so no value adds or ends a header.
What is no response record, is cut short or unpacks to more than `MOST_BYTES`, gives
one metadata row whose `problem` says why, and no record. A status that is not three
digits is null; a charset that is unknown or fits no text reads as UTF-8; a body in an
encoding that is not known here (the metadata then says `unread`) or is broken behind
some point has the text up to there. `digest_ok` is null where a declared digest's
algorithm is unknown. Repeated rows are derived as often as they occur; an empty
table gives no row; columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewarden.llm.common import sliced

END = b"\r\n"
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|title)\b.*?(?:</\1\s*>|\Z)|<!DOCTYPE[^>]*>", re.S | re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>", re.I)
_TAG = re.compile(r"</?[a-zA-Z](?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>|<[!?][^>]*>")
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LINK = re.compile(r"<a\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?\bhref\s*=", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


MOST_BYTES = 1 << 28
_STATUS = re.compile(rb"HTTP/\S+[ \t]+([0-9]{3})(?![0-9])")
_CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r?\n")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def verified(declared: str | None, *bodies: bytes) -> bool | None:
    """Whether the declared digest (base32 or hex) is that of one of the bodies; null if its algorithm is unknown."""
    if declared is None:
        return True
    name, _, value = declared.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    sums = [hashlib.new(name, b).digest() for b in bodies]
    value = value.strip()
    return any(value.lower() == s.hex() or value.upper().rstrip("=") == base64.b32encode(s).decode().rstrip("=") for s in sums)


def dechunked(body: bytes) -> bytes:
    """A chunked body joined; what is behind a broken chunk is left out, a body that begins with none is returned as it is."""
    out, at = [], 0
    while found := _CHUNK.match(body, at):
        size, at = int(found[1], 16), found.end()
        out.append(body[at : at + size])
        at += size
        at += 2 if body[at : at + 2] == END else body[at : at + 1] == b"\n"
        if not size:
            break
    return b"".join(out) if at else body


def unpacked(body: bytes, encoding: str) -> tuple[bytes, bool]:
    """The body without its content encodings, and whether all are known; ValueError if it is too large."""
    for name in reversed([x.strip().lower() for x in encoding.split(",")]):
        if name in ("", "identity", "none"):
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            return b"", False
        raw = name == "deflate" and (len(body) < 2 or body[0] & 15 != 8 or (body[0] << 8 | body[1]) % 31)
        out, rest = [], body
        while rest and sum(map(len, out)) <= MOST_BYTES:
            machine = zlib.decompressobj(-15 if raw else 47)
            try:
                out.append(machine.decompress(rest, MOST_BYTES + 1))
            except zlib.error:
                # read again in small steps, up to what is broken
                machine = zlib.decompressobj(-15 if raw else 47)
                try:
                    for k in range(0, len(rest), 64):
                        out.append(machine.decompress(rest[k : k + 64], MOST_BYTES + 1))
                except zlib.error:
                    pass
                break
            rest = machine.unused_data if machine.eof else b""
        body = b"".join(out)
        if len(body) > MOST_BYTES:
            raise ValueError("too large")
    return body, True


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def _line(name: str, value: str) -> bytes:
    """A header line; line ends in the value are escaped, bytes that were no UTF-8 come out as they were."""
    text = f"{name}: {value}".replace("\r", "%0D").replace("\n", "%0A")
    try:
        return text.encode("utf-8", "surrogateescape")
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace")


def _shown(value: str | None) -> str | None:
    """The value as valid text."""
    return None if value is None else value.encode("utf-8", "replace").decode() if not value.isascii() else value


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    lines = [_line(k, v) for k, v in head]
    return END.join([b"WARC/1.1", *lines, b"", block, b"", b""])


def lines_of(head: bytes) -> list[tuple[str, str]]:
    """Field names in lower case and values, in order; folded lines are joined."""
    out = []
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).splitlines():
        name, mark, value = line.partition(b":")
        if mark:
            out.append((name.strip().lower().decode("utf-8", "surrogateescape"), value.strip().decode("utf-8", "surrogateescape")))
    return out


def fields_of(head: bytes) -> dict[str, str]:
    """The first value of each field."""
    return dict(reversed(lines_of(head)))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; ValueError if it is none or cut short."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = fields_of(head.partition(b"\r\n")[2])
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        raise ValueError("no length")
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ValueError("cut short")
    return fields, rest[:length]


def plain(page: str) -> str:
    """The text of a page: a line per block, white space folded, character references decoded."""
    page = _RAW.sub("", page)
    end = page.rfind(">") + 1  # what starts behind it is a tag cut short, or text
    page = _TAG.sub("", _BLOCK.sub("\x00", page[:end])) + _OPEN.split(page[end:], maxsplit=1)[0]
    lines = (" ".join(entities.unescape(x).split()) for x in page.split("\x00"))
    return "\n".join(x for x in lines if x)


def respond(url: str | None, page: str | None, date: str) -> bytes:
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = [("WARC-Record-ID", record_id("response", _shown(url) or "", digest(block))), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return record("response", fields, block)


def responses(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """id and `record`, the bytes of a response record."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, html_col):
            made = [respond(u, h, date) for u, h in zip(batch.column(url_col).to_pylist(), batch.column(html_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(made, pa.binary())], [id_col, "record"])

    return df.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, record binary")


NAMES = ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "source_block_digest", "source_payload_digest", "digest_ok", "http_status", "source_content_type", "block_digest", "block", "record", "problem")
KINDS = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, source_block_digest string, source_payload_digest string, digest_ok boolean, http_status int, source_content_type string, block_digest string, block binary, record binary, problem string"


def read(payload: bytes, content_type: str) -> str:
    """The payload as text, by the charset that header or page names."""
    charset = _CHARSET.search(content_type.encode("utf-8", "replace")) or _CHARSET.search(payload[:1024])
    try:
        return payload.decode(charset[1].decode() if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):  # no charset, or one that is no encoding of texts
        return payload.decode("utf-8", "replace")


def derivatives(data: bytes | None) -> list[tuple]:
    """Rows of NAMES: the metadata and the conversion record of one response."""
    try:
        fields, block = parse(data or b"")
        if fields.get("warc-type") != "response":
            raise ValueError("not a response")
        head, _, body = block.partition(b"\r\n\r\n")
        status, _, lines = head.partition(b"\r\n")
        said = lines_of(lines)
        http = dict(reversed(said))
        sent = dechunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body
        payload, known = unpacked(sent, http.get("content-encoding", ""))
    except ValueError as why:
        return [("metadata", *[None] * 12, str(why))]
    code = _STATUS.match(status)
    source, uri, date = fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), fields.get("warc-date", "")
    sums = {k: fields.get(f"warc-{k}-digest") for k in ("block", "payload")}
    each = (verified(sums["block"], block), verified(sums["payload"], body, sent))
    ok = False if False in each else None if None in each else True
    page = read(payload, http.get("content-type", ""))
    text = plain(page).encode("utf-8", "replace")
    title = _TITLE.search(page)
    about = [("source-status", status.decode("utf-8", "surrogateescape")), *((f"source-header-{k}", v) for k, v in said), ("source-block-digest", sums["block"] or digest(block)), ("source-payload-digest", sums["payload"] or digest(body)), ("source-payload-length", str(len(body)))]
    about += [("content-encoding", "unread")] * (not known)
    about += [("title", " ".join(entities.unescape(title[1]).split()) if title else ""), ("links", str(len(_LINK.findall(page)))), ("text-length", str(len(text)))]
    meta = b"".join(_line(k, v) + END for k, v in about)
    rows = []
    for kind, made, mime in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        own, sum_ = record_id(kind, _shown(source), digest(made)), digest(made)
        whole = record(kind, [("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Block-Digest", sum_), ("Content-Type", mime)], made)
        rows.append((kind, own, *map(_shown, (source, uri, date, sums["block"], sums["payload"])), ok, int(code[1]) if code else None, _shown(http.get("content-type")), sum_, made, whole, None))
    return rows


def derive(df: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """Per response its metadata and its conversion record: id and the columns NAMES."""
    kind = df.schema[id_col].dataType.simpleString()
    kinds = [{"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}[k.split()[1]] for k in KINDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, record_col):
            ids, rows = [], []
            for own, data in enumerate(batch.column(record_col).to_pylist()):
                new = derivatives(data)
                rows += new
                ids += [own] * len(new)
            if not rows:
                continue
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(ids)), *cols], [id_col, *NAMES])

    return df.select(id_col, record_col).mapInArrow(run, f"`{id_col}` {kind}, {KINDS}")
