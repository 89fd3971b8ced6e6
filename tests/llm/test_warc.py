import gzip
import random
from html.parser import HTMLParser
from pathlib import Path

from concord.llm import warc as w

PAGE = """<!doctype html><html lang="EN"><head><title>A &amp; B</title><style>p{x}</style><script>var t="</p>";</script></head>
<body><nav><a href="/x">X</a> <a href='y?a=1&amp;b=2'>Y</a></nav><!-- gone <p> --><h1>Head</h1><p>One<br>two &lt;3 <b>bo</b>ld</p><script>bad()</script><p>A < B and &copy;</p></body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, "http://a/1", PAGE), (2, "http://a/2", ""), (3, None, None), (None, "x", "<p>é"), (1, "http://a/1", PAGE)], "page_id long, url string, html string")


def test_text_and_fields():
    assert w.plain_text(PAGE) == "X Y\nHead\nOne\ntwo <3 bold\nA < B and ©"
    assert w.page_fields(PAGE) == [("title", "A & B"), ("language", "en"), ("outlink", "/x"), ("outlink", "y?a=1&b=2")]
    assert w.plain_text("") == w.plain_text("<script>never closed") == ""


def test_a_head_may_end_without_its_tag():
    head = '<html><head><!-- c --><meta charset="utf-8"><title>t <b> u</title><link rel=x href=y><style>p{}</style><script>var a = "<p>no</p>";</script>'
    body = "<p>Hello world</p><p>again"
    for start in ("<body>", '<BODY class="a">', "", "</head><body>", "</head>"):
        assert w.plain_text(head + start + body) == "Hello world\nagain", start
    assert w.plain_text("<html><head><title>t</title><body><p>Hello world</p></body></html>") == "Hello world"
    assert w.plain_text("<head><title>t</title>plain text<p>more") == "plain text\nmore"
    assert w.plain_text("<head><title>t</title><div>one</div><p>two</head>three") == "one\ntwothree"
    assert w.plain_text("<head><title>never closed<body><p>one") == w.plain_text("<head><title>never closed</head><p>one") == "one"
    assert w.plain_text("<head><style>never closed</head><p>one") == "one"
    assert w.plain_text("<head><title>The <head> tag</title><p>one") == "one"
    assert w.plain_text("<header>top</header><p>one") == "top\none"
    assert w.plain_text("<head>" * 3000 + "<title>" * 3000 + "<p>one") == "one"


def test_records_link_to_their_source(spark):
    found = w.build(pages(spark)).collect()
    assert len(found) == 10
    for r in found:
        source = w.response(r["page_id"], {1: "http://a/1", 2: "http://a/2", None: "x"}.get(r["page_id"]), {1: PAGE, None: "<p>é"}.get(r["page_id"], "").encode())
        assert r["refers_to"] == source["record_id"] and r["source_payload_digest"] == w.digest(source["payload"]) and r["source_headers"] == source["headers"]
        assert r["content_length"] == len(r["block"].encode()) and r["block_digest"] == w.digest(r["block"].encode())
    assert len({r["record_id"] for r in found}) == 8  # the repeated page repeats its records
    assert {r["warc_type"] for r in found} == {"metadata", "conversion"}


def test_files_read_back(spark, tmp_path):
    records = w.build(pages(spark))
    w.write_warc(records, str(tmp_path / "out"))
    read = [x for f in Path(tmp_path / "out").glob("*.gz") for x in w.read_warc(gzip.decompress(f.read_bytes()))]
    wanted = sorted((r["record_id"], r["refers_to"], r["block"]) for r in records.collect())
    assert sorted((h["warc-record-id"], h["warc-refers-to"], b.decode()) for h, b in read) == wanted
    for head, block in read:
        assert head["warc-block-digest"] == w.digest(block) and int(head["content-length"]) == len(block)


def test_a_url_cannot_add_fields(spark):
    df = spark.createDataFrame([(1, "u\r\nWARC-Type: evil", "<p>x")], "page_id long, url string, html string")
    for r in w.serialized(w.build(df)).collect():
        fields, _ = next(w.read_warc((r["value"] + w.SEPARATOR).encode()))
        assert fields["warc-type"] in ("metadata", "conversion") and fields["warc-target-uri"] == "u WARC-Type: evil"


def test_response_records_parse():
    source = w.response(7, "http://a/7", PAGE.encode())
    block = source["headers"].encode() + b"\r\n\r\n" + source["payload"]
    record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {source['record_id']}\r\nWARC-Target-URI: http://a/7\r\nWARC-Date: {w.DATE}\r\nWARC-Payload-Digest: {source['payload_digest']}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    assert w.parse_response(record) == source
    assert w.derivatives(w.parse_response(record)) == w.derivatives(source)


def test_odd_tables(spark):
    df = pages(spark)
    assert w.build(df.limit(0)).count() == 0
    assert w.build(df.selectExpr("*", "1 as block", "2 as record_id")).count() == 10
    assert w.build(spark.createDataFrame([(1, "u\r\nWARC-Type: evil", "<p>" + "x y " * 200_000)], df.schema)).where("warc_type = 'conversion'").first()["content_length"] == 799_999


class Reader(HTMLParser):
    """An independent reader of pages: the standard library's parser, with blocks on lines of their own."""

    BLOCKS = {"p", "div", "h1", "li", "ul", "br", "nav", "td", "tr", "table"}
    HIDDEN = {"script", "style", "title"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        self.out += ["\n"] * (tag in self.BLOCKS) or [" "] * (tag in self.HIDDEN)

    def handle_comment(self, data):
        self.out.append(" ")  # what is dropped parts words

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        self.out += ["\n"] * (tag in self.BLOCKS)

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def text(self):
        lines = [" ".join(p for p in x.split(" ") if p) for x in "".join(self.out).split("\n")]
        return "\n".join(x for x in lines if x)


def test_random_pages_against_another_parser():
    rng = random.Random(13)
    words = ["alpha", "beta", "&amp;", "&lt;x", "é", "1 > 0", "x=y", "a"]
    attributes = ["", ' class="k"', ' title="a>b"', " data-x='p > q'", ' href="/u?a=1&amp;b=2"', " disabled"]
    for _ in range(400):
        def node(depth):
            if depth == 0 or rng.random() < 0.3:
                return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
            tag = rng.choice(["p", "div", "b", "li", "span", "h1", "a", "nav"])
            inner = "".join(node(depth - 1) for _ in range(rng.randrange(1, 4)))
            return rng.choice([f"<{tag}{rng.choice(attributes)}>{inner}</{tag}>", f"{inner}<br{rng.choice(attributes)}>", f"<!-- {tag} -->{inner}", f"<script>var a = '{tag}';</script>{inner}"])

        head = rng.choice(["", "<head><title>t</title></head>", "<head><meta charset=utf-8><style>p{x}</style></head>", "<head><title>t</title>"])
        page = f"<!doctype html><html>{head}<body{rng.choice(attributes)}>" + "".join(node(3) for _ in range(3)) + "</body></html>"
        assert w.plain_text(page) == Reader(page).text(), page


def test_attributes_may_hold_the_end_of_a_tag():
    assert w.plain_text('<p title="a>b">hi</p>') == "hi" and w.plain_text("<p title='a>b' x=1>hi") == "hi"
    assert w.plain_text('<p title="never closed>hi</p>there') in ("hi\nthere", "there", "hi</p>there".replace("</p>", "\n"))
    assert w.plain_text("<p>5 < 6 and it's \"quoted\" > 4</p>") == '5 < 6 and it\'s "quoted" > 4'
    assert w.plain_text("<" + "a=\"" * 20_000).startswith("<a=")  # and soon


def test_headers_in_any_form():
    block = b"HTTP/1.1 200 OK\r\ncontent-type:text/html\r\nX-Long: a\r\n\tb\r\n\r\n<p>x"
    record = b"WARC/1.1\r\nwarc-type:response\r\nWARC-RECORD-ID: <urn:x>\r\ncontent-LENGTH:%d\r\n\r\n" % len(block) + block
    source = w.parse_response(record)
    assert source["record_id"] == "<urn:x>" and source["target_uri"] is None and source["payload"] == b"<p>x"
    assert "source-content-type: text/html" in w.derivatives(source)[0]["block"] and "source-x-long: a b" in w.derivatives(source)[0]["block"]


def test_files_are_read_by_the_cluster(spark, tmp_path):
    sources = [w.response(i, f"http://a/{i}", f"<p>page {i}".encode()) for i in range(7)]

    def record(s, kind="response"):
        block = s["headers"].encode() + b"\r\n\r\n" + s["payload"]
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {s['record_id']}\r\nWARC-Target-URI: {s['target_uri']}\r\nWARC-Date: {s['date']}\r\nWARC-Payload-Digest: {s['payload_digest']}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(map(record, sources[:3])))
    (folder / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(s)) for s in sources[3:6]) + gzip.compress(record(sources[0], "request")))
    (folder / "c.warc.gz").write_bytes(gzip.compress(record(sources[6])))
    (folder / "d.warc").write_bytes(b"")
    found = w.build_from_files(spark, str(folder)).collect()
    assert sorted(r["refers_to"] for r in found) == sorted([s["record_id"] for s in sources] * 2)
    assert {r["block"] for r in found if r["warc_type"] == "conversion"} == {f"page {i}" for i in range(7)}
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>page {i}") for i in range(7)], "page_id long, url string, html string")
    plain = lambda rows: sorted((r["record_id"], r["block"], r["block_digest"]) for r in rows)
    assert plain(found) == plain(w.build(pages).collect())


def test_each_record_is_a_member(spark):
    records = w.build(pages(spark))
    members = [bytes(r["member"]) for r in w.gzip_members(records).collect()]
    read = [x for x in w.read_warc(w.inflated(b"".join(members)))]
    assert len(read) == len(members) == 10 and all(len(list(w.read_warc(gzip.decompress(m)))) == 1 for m in members)
    assert sum("warc-target-uri" not in fields for fields, _ in read) == 2  # the page without a url


def test_broken_pages_are_read_in_a_moment():
    import time

    for part in ('a="', "<p ", "<p x='", "<script ", "<script>", "<!--", "<a href=", "<a ", "<title>", "<html lang", "</title><title>", "<head><title>", "<head ", "-->", "<p title='>"):
        for page in (part * 20_000, "<p>x" + part * 20_000):
            began = time.perf_counter()
            w.plain_text(page), w.page_fields(page)
            assert time.perf_counter() - began < 2, part
    assert w.plain_text("a<!-- never closed <p>b") == "a never closed\nb"


def made(headers, payload):
    """The records of a response with these HTTP headers, by their kind."""
    source = {"record_id": "<urn:x>", "target_uri": "http://a", "date": w.DATE, "headers": "HTTP/1.1 200 OK\r\n" + headers, "payload": payload, "payload_digest": w.digest(payload)}
    return {r["warc_type"]: r["block"] for r in w.derivatives(source)}


def test_charsets():
    cafe = "<p>café – 5 €"
    assert made("Content-Type: text/html; charset=iso-8859-1", cafe.encode("cp1252"))["conversion"] == "café – 5 €"
    russian = '<html><head><meta http-equiv="Content-Type" content="text/html; charset=windows-1251"></head><p>Привет'
    assert made("Content-Type: text/html", russian.encode("cp1251"))["conversion"] == "Привет"
    assert made('Content-Type: text/html; charset="Shift_JIS"', "<p>日本".encode("cp932"))["conversion"] == "日本"
    assert made("Content-Type: text/html; charset=latin1", "\ufeff<p>é".encode("utf-16"))["conversion"] == "é"  # the mark counts first
    assert made("Content-Type: text/html; charset=no-such", "<p>é".encode())["conversion"] == "é"
    assert made("", "<meta charset=utf8><p>é".encode())["conversion"] == "é"


def test_transfer_and_content_encodings():
    import zlib

    page = b"<p>hello world</p>" * 20
    chunked = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(page[i : i + 33]), page[i : i + 33]) for i in range(0, len(page), 33)) + b"0\r\n\r\n"
    want = "\n".join(["hello world"] * 20)
    html = "Content-Type: text/html\r\n"
    assert made(html + "Transfer-Encoding: chunked", chunked)["conversion"] == want
    assert made(html + "Transfer-Encoding: chunked", page)["conversion"] == want  # whoever stored it had joined the chunks
    assert made(html + "Transfer-Encoding: chunked", chunked[: len(chunked) // 2])["conversion"].startswith("hello world\nhello")
    for name, data in (("gzip", gzip.compress(page)), ("x-gzip", gzip.compress(page)), ("deflate", zlib.compress(page)), ("deflate", zlib.compress(page)[2:-4]), ("zstd", w.zstandard.compress(page)), ("identity", page), ("gzip", page)):
        assert made(html + f"Content-Encoding: {name}", data)["conversion"] == want, name
    assert made(html + "Content-Encoding: gzip", gzip.compress(page * 500)[:200])["conversion"].startswith("hello")
    both = b"%x\r\n%s\r\n0\r\n\r\n" % (len(gzip.compress(page)), gzip.compress(page))
    assert made(html + "Transfer-Encoding: chunked\r\nContent-Encoding: gzip", both)["conversion"] == want
    assert set(made(html + "Content-Encoding: br", b"\x0b\x02\x80")) == {"metadata"}


def test_only_text_has_a_conversion():
    assert set(made("Content-Type: image/png", b"\x89PNG\r\n\x1a\n")) == {"metadata"}
    assert set(made("Content-Type: application/pdf", b"%PDF")) == set(made("", b"\0\1\2")) == {"metadata"}
    assert made("Content-Type: text/plain", b"a < b <p>\r\n  c  \n")["conversion"] == "a < b <p>\n  c"
    assert "title" not in made("Content-Type: text/plain", b"<title>x</title>")["metadata"]


def test_plain_files_are_read_in_runs(spark, tmp_path):
    sources = [w.response(i, f"http://a/{i}", b"<p>" + b"x%d " % i * (i * 40)) for i in range(30)]
    data = b""
    for s in sources:
        block = s["headers"].encode() + b"\r\n\r\n" + s["payload"]
        data += f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {s['record_id']}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a b.warc").write_bytes(data)
    runs = list(w.record_runs(f"file:{tmp_path}/a%20b.warc", 2000))
    assert len(runs) > 5 and runs[0][0] == 0 and runs[-1][1] is None and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    found = w.build_from_files(spark, str(tmp_path), run_bytes=2000).collect()
    assert sorted(r["refers_to"] for r in found) == sorted([s["record_id"] for s in sources] * 2)
    assert len({r["record_id"] for r in found}) == 60
