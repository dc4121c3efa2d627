"""WARC derivatives against the library's own HTML parser, on damaged records, and in linear time."""

import gzip
import json
import random
import time
import zlib
from html.parser import HTMLParser

from glyphmill.llm import warc


class Reader(HTMLParser):
    """Text, title and links of well-formed pages, event by event."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.heads, self.hidden, self.title = [], [], [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in warc.HIDDEN:
            self.hidden += 1
        elif not self.hidden:
            self.title = tag == "title"
            self.text.append("\n" if tag in warc.BLOCKS else "")
            if tag == "a" and dict(attrs).get("href") is not None:
                self.links.append(dict(attrs)["href"].strip())

    def handle_endtag(self, tag):
        if tag in warc.HIDDEN:
            self.hidden -= 1
            self.text.append(" ")
        elif not self.hidden:
            self.title = False
            self.text.append("\n" if tag in warc.BLOCKS else "")

    def handle_comment(self, data):
        self.text.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.title:
                self.heads.append(data)


def page(rng):
    word = lambda: "".join(rng.choice("abcxyzäé&;1 ") for _ in range(rng.randint(1, 9))).replace("&", "&amp;")
    parts = [f"<html><head><TITLE class=x>{word()}\n{word()}</title></head><body>"]
    for _ in range(rng.randint(0, 30)):
        parts.append(rng.choice([
            f"<p>{word()} {word()}</p>", f"<div id='a'>{word()}<br/>{word()}</div>", f'<a class="k" href="/{rng.randint(0, 99)}?a=1&amp;b=2">{word()}</a>', f"<A href='u{rng.randint(0, 9)}'>{word()}</A>", f"<a href=plain{rng.randint(0, 9)}>x</a>",
            f"<script>var a = {rng.randint(0, 9)} < 3;</script>", "<style>p { b: c }</style>", f"<!-- {word()} <p> -->", f"<b>{word()}</b>", f"<h2>{word()}</h2>", f"<ul><li>{word()}<li>{word()}</ul>", "<a name='n'>no link</a>",
        ]))
    return "".join(parts) + "</body></html>"


def test_pages_match_the_library_s_parser():
    rng = random.Random(9)
    for _ in range(300):
        text = page(rng)
        reader = Reader()
        reader.feed(text)
        reader.close()
        title, links = warc.title_and_links(text)
        assert warc.plain_text(text) == "\n".join(x for x in (" ".join(y.split()) for y in "".join(reader.text).split("\n")) if x)
        assert links == reader.links and title == " ".join("".join(reader.heads).split())


def test_a_megabyte_of_open_ends_takes_linear_time():
    for piece in ("<script> a ", "<a ", "<!-- a ", '<a href="x ', "</script ", "<title>", "<", "<a href=' <!--"):
        text = piece * (1_000_000 // len(piece))
        began = time.process_time()
        warc.plain_text(text)
        warc.title_and_links(text)
        assert time.process_time() - began < 8, piece


def response(body, *headers, kind="response"):
    block = "\r\n".join(["HTTP/1.1 200 OK", *headers, "", ""]).encode() + body
    return warc.record({"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": warc.DATE, "WARC-Target-URI": "http://x/"}, block)


def test_bodies_are_decoded():
    text = "<p>größer</p>"
    deflated = zlib.compressobj(wbits=-15)
    raw = deflated.compress(text.encode()) + deflated.flush()
    for body, *headers in [
        (text.encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"), (text.encode(), "content-type: text/html; charset=nonsense"), (gzip.compress(text.encode()), "Content-Encoding: gzip"), (zlib.compress(text.encode()), "Content-Encoding: deflate"),
        (raw, "content-encoding: deflate"), (b"5\r\n" + text.encode()[:5] + b"\r\nA;x=1\r\n" + text.encode()[5:] + b"\r\n0\r\n\r\n", "Transfer-Encoding: chunked"),
    ]:
        if headers[-1].startswith("Transfer"):
            assert len(text.encode()) == 15
        _, _, text_record = warc.derivatives(response(body, *headers))
        assert warc.parse(text_record)[0][1].decode() == "größer", headers


def test_records_that_fail_are_rows(spark):
    good = response(b"<title>T</title><a href=u>x</a>")
    bad = [None, b"", b"junk", good[:-9], response(b"x", kind="request"), good + good, response(b"x", "Content-Encoding: gzip"), response(b"zz\r\n", "Transfer-Encoding: chunked"), good.replace(b"Content-Length: ", b"Content-Length: -")]
    rows = [(i, bytes(r) if r is not None else None, i) for i, r in enumerate([good, *bad])]
    table = spark.createDataFrame(rows, "page_id long, response binary, error int")  # a clashing name
    derived = warc.derive(table)
    out = {r.page_id: r for r in derived.collect()}
    assert len(out) == len(rows) and out[0].error is None and json.loads(warc.parse(bytes(out[0].metadata))[0][1])
    assert all(out[i].error and out[i].metadata is None for i in range(1, len(rows)))
    described = {r.page_id: r for r in warc.describe(derived).collect()}
    assert described[0].title == "T" and described[0].n_links == 1 and described[3].error == out[3].error


def test_files_are_read_back(spark, tmp_path):
    records = [response(f"<p>{i}</p>".encode() * 50) for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(records[0]) + b"\x1f\x8b\x08damaged" + b"".join(map(gzip.compress, records[1:])))
    (tmp_path / "c.warc").write_bytes(records[0] + b"lost " + records[1] + records[2][:-40])
    (tmp_path / "d.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    by = lambda name: [r for r in sorted(rows, key=lambda r: r.offset) if r.path.endswith(name)]
    assert [bytes(r.response) for r in by("a.warc")] == records
    assert [bytes(r.response) for r in by("b.warc.gz") if r.response] == records and any(r.error for r in by("b.warc.gz"))
    assert [bytes(r.response) for r in by("c.warc") if r.response] == records[:2] and sum(r.error is not None for r in by("c.warc")) == 2
    assert {r.type for r in rows if r.response} == {"response"} and not by("d.warc")
