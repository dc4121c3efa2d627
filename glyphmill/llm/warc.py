"""WARC derivatives: metadata and plain-text conversion records from responses.

`responses` makes response records from pages, `read_warc` reads those of .warc and .warc.gz files; `derive` converts each response into a metadata record (JSON: source headers, HTTP headers, title, links)
and a conversion record (plain text). Both refer to the response (WARC-Refers-To, with its target URI and date) and carry its payload digest; each has a block digest of its own.
Record ids are name-based, so that a run gives the same ones again. `records` writes them as bytes, `parse` reads such bytes back.

Bodies are decoded as their HTTP headers say (chunked transfer, gzip or deflate, charset; UTF-8 with replacement where it is missing or unknown). A page is scanned once, tag by tag, in time that grows with
its length whatever is left open in it.

Null URLs and pages count as empty (an empty page has a metadata record without links and an empty conversion). A null, malformed or foreign record, or one whose body can't be decoded, gives a row with the
reason in `error` and nulls, and no other row is lost. Repeated rows give repeated records with equal ids; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_map

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
SPACE_ID = uuid.uuid5(uuid.NAMESPACE_URL, "urn:glyphmill:warc")
#: Elements whose content is no text, and those that end a line.
HIDDEN = ("script", "style", "template", "noscript")
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav title blockquote pre hr dl dt dd main aside form".split())
_open = re.compile(r"<[a-zA-Z/!?]")
_close = re.compile(r"</(script|style|template|noscript|title)\s*>", re.I)
_name = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b")
_href = re.compile(r"""[\s"'/]href\s*=\s*(["']|[^\s>"']+)""", re.I)
_blank = re.compile(r"[ \t\r\f\v ]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, chr(0).join(parts))}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The (headers, block) pairs of concatenated records; ValueError where a record is cut off or malformed."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        headers = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, sep, value = line.partition(":")
            if not sep:
                raise ValueError(f"bad header at {at}")
            headers[name] = value.strip()
        if not headers.get("Content-Length", "").isdigit():
            raise ValueError("no length")
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        if len(block) < size or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("cut-off record")
        out.append((headers, block))
    return out


class Page:
    """One pass over a page: text (block elements as line ends), title and links. Positions of closing tags and quotes that were looked for in vain are not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.links, self.head = page, [], None
        self.closing: dict[str, list[tuple[int, int]]] = {}
        for m in reversed(list(_close.finditer(page))):
            self.closing.setdefault(m[1].lower(), []).append((m.start(), m.end()))
        self.last = {mark: page.rfind(mark) for mark in ("-->", '"', "'")}
        parts, at = [], 0
        while tag := _open.search(page, at):
            parts.append(page[at : tag.start()])
            piece, at = self.tag(tag.start())
            parts.append(piece)
        parts.append(page[at:])
        self.text = "".join(parts)

    def closed(self, name: str, at: int) -> tuple[int, int] | None:
        """The next closing tag from a place on; places only grow, so those before are dropped."""
        left = self.closing.get(name, [])
        while left and left[-1][0] < at:
            left.pop()
        return left[-1] if left else None

    def tag(self, at: int) -> tuple[str, int]:
        """(what stands for the tag, where the page goes on)."""
        page = self.page
        if page.startswith("<!--", at) and self.last["-->"] >= at + 4:
            return " ", page.find("-->", at + 4) + 3
        end = page.find(">", at)
        whole, end = end >= 0, end + 1 if end >= 0 else len(page)
        found = _name.match(page, at, end)
        name = found[1].lower() if found else ""
        opening = page[at + 1] != "/"
        if whole and opening and name in HIDDEN and (close := self.closed(name, end)):
            return " ", close[1]
        if whole and opening and name == "title" and self.head is None and (close := self.closed(name, end)):
            self.head = page[end : close[0]]
        if opening and name == "a" and (href := _href.search(page, at, end)):
            mark = href[1]
            if mark not in ('"', "'"):
                self.links.append(mark)
            elif self.last[mark] >= href.end():
                self.links.append(page[href.end() : page.find(mark, href.end())])
        return "\n" if name in BLOCKS else "", end


def lines_of(text: str) -> str:
    """Entities resolved, blanks collapsed, no blank lines."""
    return "\n".join(line for line in (_blank.sub(" ", x).strip() for x in html.unescape(text).split("\n")) if line)


def plain_text(page: str) -> str:
    """Text without markup: block elements end lines, blanks collapse, blank lines go."""
    return lines_of(Page(page).text)


def title_and_links(page: str) -> tuple[str, list[str]]:
    found = Page(page)
    return one_line(found.head), [html.unescape(u).strip() for u in found.links]


def one_line(title: str | None) -> str:
    return _blank.sub(" ", html.unescape(title or "").replace("\n", " ")).strip()


def body_of(headers: dict[str, str], payload: bytes) -> str:
    """The page of a response: transfer and content encodings undone, then its charset; ValueError where that fails."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while True:
            line = payload.find(b"\r\n", at)
            if line < 0:
                raise ValueError("cut-off chunk")
            size = int(payload[at:line].split(b";")[0], 16)
            if not size:
                break
            if line + 2 + size > len(payload):
                raise ValueError("cut-off chunk")
            parts.append(payload[line + 2 : line + 2 + size])
            at = line + 4 + size
        payload = b"".join(parts)
    for coding in reversed([x.strip().lower() for x in headers.get("content-encoding", "").split(",") if x.strip()]):
        if coding in ("gzip", "x-gzip", "deflate"):
            try:
                payload = zlib.decompress(payload, 47) if coding != "deflate" or payload[:1] == b"\x78" else zlib.decompress(payload, -15)
            except zlib.error as e:
                raise ValueError(f"{coding}: {e}") from None
        elif coding != "identity":
            raise ValueError(f"unknown encoding {coding}")
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", headers.get("content-type", ""), re.I)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def clean_uri(url: str) -> str:
    """Header values are one line."""
    return re.sub(r"[\r\n]+", " ", url).strip()


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, response): a WARC response record of each page."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            url, payload = clean_uri(url or ""), (page or "").encode("utf-8", "replace")
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            block, own = http + payload, digest(payload)
            out.append(record({"WARC-Type": "response", "WARC-Record-ID": record_id("response", url, own), "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": own, "WARC-Block-Digest": digest(block)}, block))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], ["page_id", "response"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(pages.select("page_id", "url", "html"), f"page_id {id_type}, response binary", work)


def derivatives(response: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers of the response, metadata record, conversion record); ValueError if it is no response that can be read."""
    records = parse(response)
    if len(records) != 1:
        raise ValueError(f"{len(records)} records")
    (headers, block), = records
    if headers.get("WARC-Type", "").lower() != "response":
        raise ValueError(f"a record of type {headers.get('WARC-Type')}")
    if missing := [n for n in ("WARC-Record-ID", "WARC-Date") if n not in headers]:
        raise ValueError(f"no {missing[0]}")
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.decode("latin-1").split("\r\n")
    sent = {name: value.strip() for name, sep, value in (x.partition(":") for x in lines) if sep}
    page = Page(body_of({n.lower(): v for n, v in sent.items()}, payload))
    source, uri, own = headers["WARC-Record-ID"], headers.get("WARC-Target-URI", ""), headers.get("WARC-Payload-Digest") or digest(payload)
    linked = {"WARC-Date": headers["WARC-Date"], "WARC-Target-URI": uri, "WARC-Refers-To": source, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": headers["WARC-Date"], "WARC-Source-Payload-Digest": own}
    facts = {"Envelope": {"WARC-Header-Metadata": headers, "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": status, "Headers": sent, "HTML-Metadata": {"Head": {"Title": one_line(page.head)}, "Links": [{"path": "A@/href", "url": html.unescape(u).strip()} for u in page.links]}}}}}
    meta = json.dumps(facts, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")
    text = lines_of(page.text).encode("utf-8", "replace")
    made = lambda kind, mime, body: record({"WARC-Type": kind, "WARC-Record-ID": record_id(kind, source), **linked, "Content-Type": mime, "WARC-Block-Digest": digest(body)}, body)
    return headers, made("metadata", "application/json", meta), made("conversion", "text/plain", text)


def derive(archived: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, response_id, metadata, conversion, error) from (key, response): two linked records for each response, as bytes, or why there are none."""

    def one(response: bytes | None) -> tuple:
        try:
            if response is None:
                raise ValueError("no record")
            headers, meta, text = derivatives(response)
        except (ValueError, KeyError) as e:  # UnicodeDecodeError is a ValueError
            return None, None, None, f"{type(e).__name__}: {e}"
        return headers["WARC-Record-ID"], meta, text, None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*map(one, batch.column("response").to_pylist()), strict=True))
        return pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary(), pa.string()), strict=True))], [key, "response_id", "metadata", "conversion", "error"])

    id_type = archived.schema[key].dataType.simpleString()
    return arrow_map(archived.select(key, "response"), f"`{key}` {id_type}, response_id string, metadata binary, conversion binary, error string", work)


def members(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) of the records of a file, plain or gzip by records; after an unreadable place the next record start is looked for once."""
    zipped, at = data[:2] == b"\x1f\x8b", 0
    start = b"\x1f\x8b\x08" if zipped else b"WARC/1."
    while at < len(data):
        try:
            if zipped:
                inflate, parts, end = zlib.decompressobj(31), [], at
                while not inflate.eof and end < len(data):  # in pieces, as what follows a member is copied
                    parts.append(inflate.decompress(data[end : end + 65536]))
                    end = min(len(data), end + 65536)
                if not inflate.eof:
                    raise ValueError("cut-off member")
                one, size = b"".join(parts), end - at - len(inflate.unused_data)
            else:
                end = data.find(b"\r\n\r\n", at)
                length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", data[at:end]) if end >= 0 else None
                if not length or not data.startswith(b"WARC/", at):
                    raise ValueError("no record")
                size = end + 8 + int(length[1]) - at
                one = data[at : at + size]
                if len(one) < size:
                    raise ValueError("cut-off record")
            yield at, one, None
            at += size
        except (ValueError, zlib.error) as e:
            yield at, None, f"{type(e).__name__}: {e}"
            at = data.find(start, at + 1)
            if at < 0:
                return


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, type, response, error): every record of .warc and .warc.gz files (each below 2 GB, one file in a task), with its bytes; damaged places are rows with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(name: str, rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True))], ["path", "offset", "type", "response", "error"])

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for at, one, error in members(content.as_py()):
                    kind = re.search(rb"(?i)\r\nwarc-type:[ \t]*(\w+)", one.partition(b"\r\n\r\n")[0]) if one is not None else None
                    rows.append((at, kind[1].decode() if kind else None, one, error))
                    held += len(one or b"")
                    if held > 1 << 23:
                        yield out(name, rows)
                        rows, held = [], 0
                if rows:
                    yield out(name, rows)

    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1))
    return files.mapInArrow(run, "path string, offset bigint, type string, response binary, error string")


def describe(derived: DataFrame) -> DataFrame:
    """What reading the derivatives back shows: ids, references, digests and sizes, a row for each page."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for response, meta, text, error in zip(*(batch.column(c).to_pylist() for c in ("response_id", "metadata", "conversion", "error")), strict=True):
            if error is not None:
                rows.append((None,) * 12 + (error,))
                continue
            (mh, mb), (ch, cb) = parse(meta)[0], parse(text)[0]
            html_facts = json.loads(mb)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
            rows.append((response, mh["WARC-Record-ID"], ch["WARC-Record-ID"], mh["WARC-Refers-To"] == ch["WARC-Refers-To"] == response, ch["WARC-Target-URI"], ch["WARC-Source-Payload-Digest"], mh["WARC-Block-Digest"], ch["WARC-Block-Digest"], html_facts["Head"]["Title"], len(html_facts["Links"]), len(cb), len(cb.split()), None))
        cols = list(zip(*rows, strict=True))
        types = [pa.string()] * 3 + [pa.bool_()] + [pa.string()] * 5 + [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["page_id", *NAMES])

    id_type = derived.schema["page_id"].dataType.simpleString()
    return arrow_map(derived, f"page_id {id_type}, response_id string, metadata_id string, conversion_id string, linked boolean, target_uri string, payload_digest string, metadata_digest string, conversion_digest string, title string, n_links bigint, text_bytes bigint, text_words bigint, error string", work)


NAMES = ("response_id", "metadata_id", "conversion_id", "linked", "target_uri", "payload_digest", "metadata_digest", "conversion_digest", "title", "n_links", "text_bytes", "text_words", "error")


def write_records(derived: DataFrame, path: str) -> None:
    """A table of gzip members, one for each record (kind, page_id, bytes); concatenated they are a .warc.gz file."""
    both = derived.filter("error is null").select("page_id", F.explode(F.create_map(F.lit("metadata"), "metadata", F.lit("conversion"), "conversion")).alias("kind", "record"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import gzip

        members = [gzip.compress(r, mtime=0) for r in batch.column("record").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("kind"), pa.array(members, pa.binary())], ["page_id", "kind", "member"])

    id_type = derived.schema["page_id"].dataType.simpleString()
    arrow_map(both, f"page_id {id_type}, kind string, member binary", work).write.parquet(path)
