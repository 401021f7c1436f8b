"""Main text against a plain reading of this data's pages, and hand-made pages."""

import html
import re

import pytest

from verbspark.llm import html_main_text as H
from verbspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def plain(source):
    """What this data's article elements say: their text, a block per heading or paragraph."""
    article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", source or "", re.S)
    blocks = re.split(r"</?(?:p|h\d)>", article.group(1) if article else "")
    texts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_whole_table_against_plain_reading(spark):
    expected = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op7_html_main_text"](spark, DATA).collect()}
    assert {i: g[:2] for i, g in got.items()} == expected
    assert all(g[2] == len(g[1]) for g in got.values())


CASES = {
    "<p>a<p>b<div>c</div>d": "a\n\nb\n\nc\n\nd",
    "<article><h1>T &amp;amp; &lt;x&gt;</h1><p>one\n two<br>three</p><ul><li>x<li>y <b>z</b></ul></article><p>after": "T &amp; <x>\n\none two three\n\nx\n\ny z",
    "<div class='content with-sidebar'><article><p>kept</p><aside>no</aside><div id=comments><article>no</article></div></article></div>": "kept",
    "<header>no</header><main><header><h1>Title</h1></header><p>text</p><form>no<p>no</form></main><footer>no": "Title\n\ntext",
    "<nav><ul><li>no</ul></nav><script>if (a<b) '</p>'</script><style>p{}</style><p>yes<!-- <p>no --> on": "yes on",
    "<p title='a > b' class=x>1 < 2 &nbsp; &copy;&#233;</p>": "1 < 2 ©é",
    "<p hidden>no</p><div style='display: none'>no</div><div class='ad banner'>no</div><p class='lead'>yes</p>": "yes",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\n\nb\n\nc",
    "": "",
    "no markup": "no markup",
    "<p>open <b>bold <p>next</b> end": "open bold\n\nnext end",
    "<textarea>no</textarea><p>x</p><script>never closed <p>": "x",
    "<div " + "x" * 50000: "<div " + "x" * 50000,
    "<div>" * 3000 + "deep": "deep",
    "<p a=\"unclosed>text</p><p>more</p>": "text\n\nmore",
}


@pytest.mark.parametrize("source", CASES)
def test_hand_made_pages(source):
    assert H.Page(source).text(frozenset()) == CASES[source]


def test_templates_of_a_host(spark):
    chrome = "<div class=box><p>Read our terms</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{chrome}<div><p>story {i}</p></div></body>", "h") for i in range(12)]
    rows += [(20, "http://b.example/", f"<body>{chrome}<p>only page</p></body>", "h"), (21, None, None, "h"), (22, "nonsense", "", "h")]
    rows += [(30 + i, f"HTTP://user@C.example:80/{i}", "<body><div><p>a copy</p></div></body>", "h") for i in range(12)]
    rows += [(50 + i, f"https://d.example/{i}", f"<article><p>repeated passage</p><div class=x>tools</div><p>own {i}</p></article>", "h") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert [got[i] for i in range(12)] == [f"story {i}" for i in range(12)]
    assert got[20] == "Read our terms\n\nonly page" and got[21] == got[22] == ""
    assert {got[30 + i] for i in range(12)} == {"a copy"}
    assert [got[50 + i] for i in range(8)] == [f"repeated passage\n\nown {i}" for i in range(8)]


def test_shuffled_templates_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_HASHES", -1)
    rows = [(i, "http://a.example/", f"<div><p>same</p></div><p>x{i}</p>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r.text for r in H.extract(df).collect()) == [f"x{i}" for i in range(6)]
    assert H.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("broadcast", [1_000_000, -1])
def test_rotating_blocks_of_a_large_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(H, "BROADCAST_HASHES", broadcast)
    rows = []
    for i in range(600):  # each block is on 10 of 600 pages
        box = f"<div class=box><p>Rotating notice {i % 60}</p></div>"
        rows.append((i, f"http://big.example/{i}", f"<body>{box}<div><p>story {i}</p></div><ul><li>link {i % 60}</ul></body>"))
        rows.append((1000 + i, f"http://art.example/{i}", f"<article><p>told {i % 60}</p>{box}<ul><li>item {i % 60}<li>own {i}</ul></article>"))
    rows += [(2000 + i, f"http://few.example/{i}", f"<div><p>on four pages</p></div><p>x{i}</p>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert [got[i] for i in range(600)] == [f"story {i}" for i in range(600)]
    assert [got[1000 + i] for i in range(600)] == [f"told {i % 60}\n\nitem {i % 60}\n\nown {i}" for i in range(600)]
    assert [got[2000 + i] for i in range(4)] == [f"on four pages\n\nx{i}" for i in range(4)]


def side_parts(host, n):
    """Pages without an article element whose side parts have new text on every page."""
    page = "<body><div class=top>Site name</div><div class=text><p>story {i}</p></div><div class=related-links>see {i}</div><section id=comments><p>said {i}</p></section></body>"
    return [(i, f"http://{host}/{i}", page.format(i=f"{host} {i}")) for i in range(n)]


def test_templates_decide(spark, monkeypatch):
    rows = side_parts("a.example", 6) + [(100 + i, u, h) for i, u, h in side_parts("b.example", 1)]
    rows.append((200, "http://a.example/x", "<body><p>x</p><div class=related-work>named on this page alone</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert [got[i] for i in range(6)] == [f"story a.example {i}" for i in range(6)]
    assert got[100] == "Site name\n\nstory b.example 0" and got[200] == "x\n\nnamed on this page alone"

    none = lambda parsed, *_: parsed.select("host", H.F.lit(H.PAGE_FRAME).alias("hash"), H.F.lit(False).alias("often")).distinct()
    monkeypatch.setattr(H, "site_templates", none)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert [got[i] for i in range(6)] == [f"Site name\n\nstory a.example {i}\n\nsee a.example {i}\n\nsaid a.example {i}" for i in range(6)]


def test_names_are_not_needed_where_templates_are(spark, monkeypatch):
    """Without the list of names, all pages of the table and the rotating blocks of a host keep their texts."""
    monkeypatch.setattr(H, "_MARKS", frozenset())
    monkeypatch.setattr(H, "_HEADER_MARKS", frozenset())
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    assert all(H.Page(source or "").text(frozenset()) == plain(source) for _, source in pages)


def test_brute_force_of_the_counts(spark):
    """Templates of the whole table by plain counting."""
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    pages = {}
    for r in df.collect():
        found = H.Page(r.html or "").parts()
        pages.setdefault(re.match(r"https?://([^/:?#]*)", r.url)[1].lower(), {})[found.digest] = found.all_hashes()
    expected = {}
    for host, own in pages.items():
        for h in {h for hashes in own.values() for h in hashes}:
            n = sum(h in hashes for hashes in own.values())
            if n >= (2 if h & 1 else 5):
                expected[host, h] = n >= 0.2 * len(own)
    seen = {}
    original = H.site_templates
    try:
        H.site_templates = lambda *a: seen.setdefault("table", original(*a))
        H.extract(df)
    finally:
        H.site_templates = original
    assert {(r["host"], r["hash"]): r["often"] for r in seen["table"].collect()} == expected
    assert sum(1 for _, h in expected if not h & 1) > 10
