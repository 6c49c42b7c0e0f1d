"""Operators over pages against brute force."""

import gzip
import hashlib
import html
import io
import json
import random
import re
import struct
import zipfile

import pytest

from quarrykit.llm import html_extraction as hx
from quarrykit.llm import url_filter, warc
from quarrykit.llm.queries import RULES

PAGES = "page_id long, url string, html string"

# -- WARC


def test_archives_round_trip(frame):
    rng = random.Random(1)
    large = [f"<p>{'é' * n}{n}</p>" for n in (50, 60, 5000)]
    rows = [(i, f"http://h.example/{i}", rng.choice([*large, "small", "", None, f"own {i} " * 40])) for i in range(80)]
    rows += [(None, None, large[0]), (None, None, "no id " * 40), (7, rows[7][1], rows[7][2]), (200, "http://x/\r\nWARC-Type: response", large[2])]
    got = warc.warc_round_trip(frame(PAGES, rows)).collect()
    first = {}
    for i, _, text in rows:
        if i is not None and len((text or "").encode()) >= 100:
            first[text] = min(i, first.get(text, i))
    want = []
    for i, _, text in rows:
        data = (text or "").encode()
        to = first.get(text)
        revisit = to is not None and to != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.warc_round_trip(frame(PAGES, [])).collect() == []


def test_payloads_come_back(spark, frame, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>Größe {i}</p>" * (i + 1)) for i in range(30)]
    archives = warc.write_archives(frame(PAGES, rows), f"file://{tmp_path}/a")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, archives).collect()}
    assert got == {i: h for i, _, h in rows}
    for r in archives.collect():  # other ZIP and gzip readers understand them too
        with zipfile.ZipFile(r.archive.removeprefix("file://")) as z:
            assert z.testzip() is None and {warc.DATA, warc.INDEX, warc.PACKAGE} == set(z.namelist())


def test_rows_with_odd_urls_and_long_payloads(spark, frame, tmp_path):
    long = "".join(random.Random(4).choices("abcdefghij <>", k=9_000_000))
    rows = [(1, None, "no url"), (2, "", "empty url"), (3, "http://h/a b\r\nX-Page-ID: 9", "line ends"), (4, "http://h/", long), (4, "http://h/", long), (5, "x", None)]
    archives = warc.write_archives(frame(PAGES, rows), f"file://{tmp_path}/a")
    got = warc.read_archives(spark, archives).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode() if r.payload is not None else None) for r in got if r.page_id != 1) == sorted(
        (i, u.replace("\r\n", "%0D%0A"), h or "") for i, u, h in rows if i != 1
    )
    assert [r.url for r in got if r.page_id == 1] == [None]
    ids = set()
    for r in archives.collect():
        with zipfile.ZipFile(r.archive.removeprefix("file://")) as z:
            entries = [line for line in z.read(warc.INDEX).decode().splitlines()]
            assert entries == sorted(entries) and all(len(x.split(" ", 2)) == 3 for x in entries)
            data = gzip.decompress(z.read(warc.DATA)).decode()
            ids.update(re.findall("WARC-Record-ID: (.*)\r", data))
    assert len(ids) == len(rows)  # equal rows have ids of their own


def foreign_record(kind, target, block, content_type, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{random.random()}>\r\nWARC-Date: 2020-02-02T02:02:02Z\r\n"
    return (head + (f"warc-target-uri:{target}\r\n" if target else "") + extra + f"Content-Type: {content_type}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("package", [True, False])
def test_archives_of_others(spark, tmp_path, index, packed, package):
    """Two WARC files of other names, other record types, chunked answers, with and without index and package."""
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nabcd\r\n3;x=y\r\nefg\r\n0\r\n\r\n"
    files = {
        "rec-a": [("warcinfo", None, b"software: x\r\n", "application/warc-fields"), ("response", "http://a/1", b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\n<p>one</p>", "application/http; msgtype=response")],
        "rec-b": [("resource", "http://a/2", b"<p>two \xff</p>", "text/html"), ("response", "http://a/3", chunked, "application/http;msgtype=response"), ("request", "http://a/3", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request")],
    }
    at = tmp_path / "other.wacz"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_STORED) as z:
        z.writestr("pages/pages.jsonl", "{}")
        lines, names = [], []
        for name, records in files.items():
            name += ".warc.gz" if packed else ".warc"
            data = b""
            for r in records:
                one = foreign_record(*r, extra="X-Long: a\r\n  folded\r\n")
                one = gzip.compress(one) if packed else one
                lines.append(f"com,a)/ 20200202020202 {json.dumps({'url': r[1], 'offset': str(len(data)), 'length': len(one), 'filename': name})}")
                data += one
            z.writestr(f"archive/{name}", data)
            names.append(f"archive/{name}")
        if index:
            z.writestr("indexes/own.cdx.gz", gzip.compress(("!meta {}\n" + "\n".join(lines)).encode()))
        if package:
            z.writestr("datapackage.json", json.dumps({"resources": [{"path": x} for x in [*names, "pages/pages.jsonl", *["indexes/own.cdx.gz"] * index]]}))
    got = warc.read_archives(spark, spark.createDataFrame([(f"file://{at}",)], "archive string")).collect()
    payloads = {("warcinfo", None): b"software: x\r\n", ("response", "http://a/1"): b"<p>one</p>", ("resource", "http://a/2"): b"<p>two \xff</p>", ("response", "http://a/3"): b"abcdefg", ("request", "http://a/3"): b""}
    assert {(r.record_type, r.url): bytes(r.payload) for r in got} == payloads and len(got) == 5
    assert all(r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest() and r.payload_bytes == len(r.payload) and r.page_id is None for r in got)


def test_damage_is_an_error(spark, frame, tmp_path):
    (r,) = warc.write_archives(frame(PAGES, [(1, "u", "payload " * 50)]).coalesce(1), f"file://{tmp_path}/a").collect()
    path = r.archive.removeprefix("file://")
    with zipfile.ZipFile(path) as z:
        members = {n: z.read(n) for n in z.namelist()}
    whole = gzip.decompress(members[warc.DATA]).replace(b"payload payload", b"payload PAYLOAD", 1)
    with zipfile.ZipFile(tmp_path / "b.wacz", "w") as z:
        z.writestr(warc.DATA, gzip.compress(whole))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, spark.createDataFrame([(f"file://{tmp_path}/b.wacz",)], "archive string")).collect()


def test_archives_are_rolled(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 700)
    rows = [(i, "u", "".join(random.Random(i).choices("abcdefgh", k=900))) for i in range(40)]
    archives = warc.write_archives(frame(PAGES, rows), f"file://{tmp_path}/a")
    assert archives.count() > 6
    assert sorted(r.page_id for r in warc.read_archives(spark, archives).collect()) == list(range(40))


def directory_of(data):
    return warc.ZipDirectory(lambda at, n: data[at : at + n], len(data))


def test_zip_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"stored bytes")
        z.writestr(zipfile.ZipInfo("b/ü.txt"), b"PK\x05\x06 in the data")
        z.writestr("c.txt", b"packed " * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK"
    found = directory_of(out.getvalue())
    for name, want in (("a.txt", b"stored bytes"), ("b/ü.txt", b"PK\x05\x06 in the data")):
        at, n = found.stored(name)
        assert out.getvalue()[at : at + n] == want
    with pytest.raises(ValueError, match="compressed"):
        found.stored("c.txt")
    with pytest.raises(ValueError, match="not a ZIP"):
        directory_of(b"nothing of the kind" * 9)


def test_zip64_directories():
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:  # more members than 16 bits count
        for i in range(65_600):
            z.writestr(zipfile.ZipInfo(str(i)), b"%d" % i)
    at, n = directory_of(many.getvalue()).stored("65599")
    assert many.getvalue()[at : at + n] == b"65599"
    # sizes and offsets that stand in the ZIP64 field, as for members beyond 4 GB
    name, data = b"big", b"0123456789"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 3, 20) + name + struct.pack("<HHQQ", 1, 16, 10, 10) + data
    entry = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 3, 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, 10, 10, 0)
    record = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<IIQI", 0x07064B50, 0, len(local) + len(entry), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = local + entry + record + locator + end
    at, n = directory_of(whole).stored("big")
    assert whole[at : at + n] == data


# -- URL filter


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def fitting_rule(host, path):
    fits = [(len(r), r) for _, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1] if fits else None


def test_urls(frame):
    rng = random.Random(2)
    hosts = ["example.com", "www.EXAMPLE.com", "example.net", "a.b.example.net", "x.org", "com", "notexample.com", "ÄX.de", "example.com:80", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x=1", "/de/8#a", "/de/9", "/es/1?u=http://a.com/en/", "?q=/en/", "#/en/", "/en"]
    urls = [f"{rng.choice(['http', 'https', 'x'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/en/", "http://com/en/\nx", "http://example.com/en/7" + "é?" * 50_000, "http://h.org/" + "9" * 100_000, "x" * 100_000]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(None, urls[3], None), (3, urls[3], None)]
    got = url_filter.judge(frame(PAGES, rows), RULES).collect()
    says = {r: v for v, r in RULES}
    assert len(got) == len(rows)
    want = [(i, *split_url(u), fitting_rule(*split_url(u))) for i, u, _ in rows]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(want, key=str)
    assert all(r.verdict == (says[r.rule] if r.rule else r.verdict) and r.verdict in ("allow", "block") for r in got)
    assert url_filter.judge(frame(PAGES, []), RULES).collect() == []
    assert {r.verdict for r in url_filter.judge(frame(PAGES, [(1, "x://y.z/", None)]), RULES).collect()} == {"allow"}


def test_trees_learn(spark):
    """Held-out accuracy on URLs whose label depends on two features."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        digits, long = rng.random() < 0.5, rng.random() < 0.5
        url = f"http://{'h' * rng.randrange(3, 9)}.{rng.choice(['com', 'org'])}/{''.join(rng.choice('0123456789' if digits else 'abcdef') for _ in range(40 if long else 12))}"
        rows.append((i, url, digits and not long if rng.random() < 0.98 else not digits))
    df = spark.createDataFrame(rows, "i long, url string, blocked boolean").withColumns({"host": url_filter.host_of("url"), "path": url_filter.path_of("url")})
    model = url_filter.train(df.where("i < 2000").drop("i"))
    held = df.where("i >= 2000").withColumns(url_filter.lexical_features() | model.suffix_features())
    right = held.where((model.margin() > 0) == held.blocked).count()
    assert len(model.trees) == 8 and right >= 940


def test_ties_of_gain_are_settled(spark):
    """Two features that part the labels equally well: the same trees whatever the order and the deal of the rows."""
    rows = [(f"http://h{'-' * (i % 2)}.com/{'a' * 5 if i % 2 else 'a/bb'}", bool(i % 2)) for i in range(40)]
    found = []
    for seed in range(3):
        mixed = random.Random(seed).sample(rows, len(rows))
        df = spark.createDataFrame(mixed, "url string, blocked boolean").repartition(seed + 1).withColumns({"host": url_filter.host_of("url"), "path": url_filter.path_of("url")})
        model = url_filter.train(df)
        found.append([t["splits"] for t in model.trees])
    assert found[0] == found[1] == found[2] and found[0][0]


def test_rare_suffixes_are_pooled(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SUFFIXES", 1)
    rows = [(f"http://a.com/{i}", False) for i in range(30)] + [(f"http://a.bad{i}/", True) for i in range(20)]
    df = spark.createDataFrame(rows, "url string, blocked boolean").withColumns({"host": url_filter.host_of("url"), "path": url_filter.path_of("url")})
    model = url_filter.train(df)
    assert set(model.suffixes) == {"com"} and model.rest[0] > model.suffixes["com"][0]
    told = df.withColumns(url_filter.lexical_features() | model.suffix_features())
    assert told.where((model.margin() > 0) != told.blocked).count() == 0


def test_filter_stays_in_the_jvm(spark, sf):
    plan = url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan


# -- HTML extraction


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b<br>c</p>d", "a b c d"),
        ("<article><h1>T</h1><p>one <b>bo</b>ld &eacute;&#233;&#xe9;\n\t x</p></article><footer>f</footer>", "T one bold ééé x"),
        ("<body><nav>m</nav><header>h</header><main><header>kept</header>x<aside>s</aside></main><div class='ad'>a</div></body>", "kept x"),
        ("<article>a<script>var x='</p>'; if (a<b) {}</script><style>p{}</style><!-- <p>no</p> -->b</article>", "ab"),
        ("<article>text<section class='comments-list'><p>first!</p></section><form><input>x</form></article>", "text"),
        ("<div id=cookie-notice>We use</div><div class='content'>real <span>te</span>xt</div>", "real text"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a b 1 2"),
        ("<ARTICLE><P CLASS=\"lead\" HIDDEN>no</P><P>1 < 2 & 3 &lt; 4</P></ARTICLE>", "1 < 2 & 3 < 4"),
        ("<article>x</article><div>after</div>", "x"),
        ("<div class=site-header>Site</div><article><div class=post-header><h1>T</h1></div>x<div class=share-bar>s</div></article>", "T x"),
        ("<article><p>a</div></span>b</article>", "ab"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<title>t</title><p>a&nbsp;b", "a b"),
        ("<article><textarea>no <b></textarea>yes<![CDATA[ raw ]]></article>", "yes raw"),
        ("<body><div role=navigation>no</div><div aria-hidden=true>no</div><div style='display: none'>no</div>yes</body>", "yes"),
    ],
)
def test_texts(page, want):
    made = hx.page_of(page)
    assert hx.extract(made) == hx.extract(hx.Page(hx.read(hx.written(made.root)))) == want


def test_names_that_tell_of_others():
    for name in ("content has-sidebar", "no-comments", "post without-ads"):
        assert hx.extract(hx.page_of(f"<div class='{name}'>text<p class='sidebar'>no</p></div>")) == "text"


def brute_matching(a, b):
    """Simple tree matching by its recurrence."""
    if a.tag != b.tag:
        return 0

    def best(i, j):
        return 0 if i < 0 or j < 0 else max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + brute_matching(a.kids[i], b.kids[j]))

    return 1 if a.tag == "#text" else 1 + (a.mark == b.mark) + best(len(a.kids) - 1, len(b.kids) - 1)


def random_page(rng, depth=3):
    def tree(depth):
        if not depth or rng.random() < 0.2:
            return hx.Node("#text", text=rng.choice("xyz"))
        node = hx.Node(rng.choice("ab"), 0, rng.choice(["", "m"]))
        node.kids = [tree(depth - 1) for _ in range(rng.randrange(4))]
        return node

    root = hx.Node("")
    root.kids = [tree(depth) for _ in range(rng.randrange(1, 4))]
    return hx.Page(root)


def test_simple_tree_matching():
    rng = random.Random(5)
    for _ in range(300):
        a, b = random_page(rng).slots, random_page(rng).slots
        matching = hx.Matching(a, b)
        assert matching.weight == brute_matching(a, b)
        pairs = matching.pairs()
        assert sum(1 if x.tag == "#text" else 1 + (x.mark == y.mark) for x, y in pairs) == matching.weight
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_runs_are_slots():
    rng = random.Random(6)
    for _ in range(100):
        page = random_page(rng, 4)
        slots = list(hx._all(page.slots))
        assert [x.text for s in slots if s.tag == "#text" for x in s.nodes].sort() == [x.text for x in hx.leaves(page.root)].sort()
        assert all(x.shape != y.shape for s in slots for x, y in zip(s.kids, s.kids[1:], strict=False))


def test_trees_beyond_the_bounds_match_from_both_ends(monkeypatch):
    pages = [hx.page_of("<body>" + "".join(f"<h2>{k} {i}</h2><p>{k} {i} text</p><ul><li>{i}</ul>" for i in range(n)) + "<div>end</div></body>") for k, n in (("a", 9), ("b", 14))]
    whole = hx.Matching(pages[0].slots, pages[1].slots)
    monkeypatch.setattr(hx, "CELLS", 4)
    ends = hx.Matching(pages[0].slots, pages[1].slots)
    assert 0 < ends.weight <= whole.weight and any(x.texts() == y.texts() == ["end"] for x, y in ends.pairs() if x.tag == "#text")


def site(rng, i, article=True):
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    paragraphs = [prose(30) for _ in range(rng.randrange(1, 5))] + ["The same line everywhere."] * (rng.random() < 0.6)
    tag = "article" if article else "div"
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    page = f"<body><div><span>Welcome to our site</span></div><{tag}><h2>{(title := prose(3))}</h2>{body}<div>Share with friends</div></{tag}><div><b>All rights kept</b></div></body>"
    return page, " ".join([title, *paragraphs])


@pytest.mark.parametrize("article", [True, False])
def test_wrappers_are_induced(frame, article):
    """What is constant on a host goes without any name or tag that tells; shared lines of varying slots stay."""
    rng = random.Random(6)
    made = [site(rng, i, article) for i in range(60)]
    rows = [(i, f"http://one.example/{i}", page) for i, (page, _) in enumerate(made)]
    rows += [(100, "http://other.example/", "<p>alone"), (101, None, None), (None, None, "<p>no id")]
    rows += [(102, "http://one.example/copy", made[0][0]), (0, rows[0][1], rows[0][2])]
    got = hx.main_text(frame(PAGES, rows)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert sum(by[i] == want for i, (_, want) in enumerate(made)) == 60
    assert (by[100], by[101], by[None], by[102]) == ("alone", "", "no id", made[0][1])
    assert hx.main_text(frame(PAGES, [])).collect() == []


LEGAL = "All rights kept. No part of this site may be copied, stored or sent on without the written leave of its owners. " * 2
NOTICE = "This site keeps small files on your machine so that it knows you when you come back another day, and for nothing else at all."


def heavy(text, title="Title"):
    """More unmarked template than article."""
    return f"<body><div><span>{NOTICE}</span></div><div><h2>{title}</h2><p>{text}</p></div><div><b>{LEGAL}</b></div></body>"


def test_templates_that_outweigh_articles(frame):
    rng = random.Random(9)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(20)]
    rows = [(i, f"http://one.example/{i}", heavy(t, f"Title {t.split()[0]}")) for i, t in enumerate(prose)]
    by = {r.page_id: r.text for r in hx.main_text(frame(PAGES, rows)).collect()}
    assert len(LEGAL) + len(NOTICE) > 2 * max(map(len, prose)) and all(by[i] == f"Title {t.split()[0]} {t}" for i, t in enumerate(prose))


def test_copies_are_no_references():
    """Pages that differ by a count, a date or an edited word don't make each other's article template."""
    text = " ".join(f"w{i}" for i in range(40))
    page = lambda n, more="": hx.page_of(f"<div><h2>One title</h2><p>{text}{more}</p><div>Seen {n} times since {n}-05</div><div>Rights</div></div>")
    copies = [page(n) for n in range(6)] + [page(7, " edited")]
    assert len(hx.choose(copies)) == 1 and hx.induce(hx.choose(copies)) == ""


def test_references_are_distinct_pages(frame, spark):
    """Copies that fill a host, and hosts of two or three pages, keep no template; the deal changes no text."""
    rng = random.Random(10)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    of = lambda host, k, i: (1000 * k + i, f"http://{host}.example/{i}", heavy(prose[i], f"Title {prose[i][:5]}"))
    rows = [of("filled", 1, i) for i in range(12)] + [(5000 + i, f"http://filled.example/copy{i}", heavy(prose[0], f"Title {prose[0][:5]}")) for i in range(400)]
    rows += [of("three", 2, i) for i in (20, 21, 22)] + [of("two", 3, i) for i in (30, 31)]
    found = []
    for width in ("4", "1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            found.append({r.page_id: r.text for r in hx.main_text(frame(PAGES, rows)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {i: f"Title {prose[at][:5]} {prose[at]}" for i, at in ((i, 0 if i >= 5000 else i % 1000) for i, _, _ in rows)}
    assert found == [want] * 3


def test_lines_that_some_pages_share_stay():
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    made = [hx.page_of(f"<article><h1>{'One common line' if i < 6 else text(-i)}</h1><p>{text(i)}</p></article>") for i in range(16)]
    wrapper = hx.wrapper_of(hx.induce(hx.choose(made)))
    assert wrapper and all(hx.extract(p, wrapper) == " ".join(x.text for x in hx.leaves(p.root)) for p in made)


def texts_at(frame, spark, rows, width, **how):
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        return {r.page_id: r.text for r in hx.main_text(frame(PAGES, rows), **how).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("hints", [True, False])
def test_hot_hosts_are_dealt_out(frame, spark, hints):
    rng = random.Random(7)
    made = [site(rng, i) for i in range(400)]
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.example/{i}", page) for i, (page, _) in enumerate(made)]
    by = texts_at(frame, spark, rows, "4", hints=hints)
    assert all(by[i] == want for i, (_, want) in enumerate(made) if i % 3)
    assert all(made[i][1] in by[i] for i in range(400))


def test_notices_of_some_pages(frame, spark):
    """A notice that three quarters of a host's pages have goes from all, however the pages are dealt out."""
    rng = random.Random(13)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    want = {i: f"{prose(4)} {prose(30)} {prose(20)}" for i in range(300)}
    rows = []
    for i, text in want.items():
        w = text.split()
        notice = f"<div><span>{NOTICE}</span></div>" if i % 4 else ""
        rows.append((i, "http://one.example/", f"<body>{notice}<div><h2>{' '.join(w[:4])}</h2><p>{' '.join(w[4:34])}</p><p>{' '.join(w[34:])}</p></div><div><b>{LEGAL}</b></div></body>"))
    assert [texts_at(frame, spark, rows, width) for width in ("4", "50")] == [want] * 2


def test_wide_and_deep_pages_end_soon(frame):
    import time

    began = time.time()
    wide = ["".join(f"<h2>{k}{i}h</h2><p>{k}{i}p {k}{i}q</p>" + "<ul><li>x</ul>" * (i % 7 == 0) for i in range(20_000)) for k in "abc"]
    deep = ["<div>" * 3000 + f"{k}1 {k}2 {k}3" + "</div>" * 3000 for k in "abc"]
    rows = [(i, "http://wide.example/", f"<body><div>menu of all</div><div>{x}</div></body>") for i, x in enumerate(wide)]
    rows += [(10 + i, "http://deep.example/", x) for i, x in enumerate(deep)]
    rows += [(20 + i, "http://same.example/", "<body>" + "".join(f"<p>{k} {j}" for j in range(20_000))) for i, k in enumerate("abc")]
    by = {r.page_id: r.text for r in hx.main_text(frame(PAGES, rows)).collect()}
    assert all(by[10 + i] == f"{k}1 {k}2 {k}3" for i, k in enumerate("abc"))
    assert all(by[i].startswith(f"{k}0h {k}0p {k}0q x {k}1h") and by[i].endswith(f" {k}19999q x") for i, k in enumerate("abc"))
    assert all(by[20 + i].count(k) == 20_000 for i, k in enumerate("abc"))
    assert time.time() - began < 120


def article_of(page):
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", page.split("<article>", 1)[1].split("</article>")[0])).split())


def test_articles_of_the_test_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    by = {r.page_id: r.text for r in hx.main_text(pages).collect()}
    assert all(by[r.page_id] == article_of(r.html) for r in pages.collect())


def test_induction_alone_finds_the_articles(spark):
    """Without any tag, role or name that tells: on every host that has two pages, and only by its wrapper."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.withColumn("host", url_filter.host_of("url")).collect()
    by = {r.page_id: r.text for r in hx.main_text(pages, hints=False).collect()}
    many = {r.host for r in rows if sum(x.host == r.host for x in rows) > 1}
    told = [r for r in rows if r.host in many]
    assert len(told) > 200 and all(by[r.page_id] == article_of(r.html) for r in told)
    assert all(hx.extract(hx.page_of(r.html, False), None, False) != article_of(r.html) for r in told)
