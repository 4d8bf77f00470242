import html
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from duskwatch.llm import pages as P  # noqa: E402

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head>
<body class="x"><header><h2>Site</h2></header><nav><ul><li><a href="/a>b">A</a><li>B</ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><main><article><h1>Head &lt;1&gt; &amp;c&eacute;</h1><p>One <b>bold</b>
 two<br>three <p>Unclosed &nbsp; para<ul><li>x<li>y</ul><aside>side</aside><form><p>mail</p></form><table><tr><td>c1<td>c2</table><section class="comments"><p>nice!</p></section></article></main>
<div class="sidebar"><p>more</p></div><footer>&copy; us</footer></body></html>"""


def text_of(page, low=frozenset()):
    return "\n".join(P._kept(P.blocks(page)[0], low))


def test_one_page():
    assert text_of(PAGE) == "Head <1> &cé\nOne bold two three\nUnclosed para\nx\ny\nc1\nc2"


def test_odd_markup():
    assert text_of("") == "" and text_of("plain text") == "plain text"
    assert text_of("<p>a < b</p>") == "a < b"
    assert text_of("<div>a<p>b</div>c") == "a\nb\nc"
    assert text_of('<p title="x>y">a</p><p title=\'"\'>b') == "a\nb"
    assert text_of('<p title="open>a</p>') == "a"
    assert text_of("<script>never closed <p>x") == "" and text_of("a<!-- never closed <p>x") == "a"
    assert text_of("</div></p>a</b>b") == "a\nb" or text_of("</div></p>a</b>b") == "ab"
    assert text_of("<p>" + "<b>" * 2000 + "deep</p>") == "deep"


def test_names_are_matched_whole_and_not_around_an_article():
    for wrapper in ('class="layout has-sidebar"', 'class="site menu-open"', 'class="page with-footer"', 'class="sidebar"', 'id="menu-page"'):
        assert text_of(f'<div {wrapper}><div class="ad">Buy</div><article><p>a</p></article></div>') == "a"
    assert text_of('<form><header>x</header><main><p>a</p></main></form>') == "a"
    inside = "".join(f'<div class="{c}">{c}</div>' for c in ("share-price", "related-work", "alert", "search", "footer-note"))
    assert text_of(f"<article>{inside}</article>") == "share-price\nrelated-work\nalert\nsearch\nfooter-note"
    assert text_of('<main><article>a<section class="comments"><article class="comment">no</article><article>no</article></section></article></main>') == "a"
    assert text_of('<aside><article>teaser</article></aside><p>a</p>') == "a" and text_of('<div hidden><article>x</article></div><p>a</p>') == "a"


def test_given_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in P.main_texts(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:h1|p)>", "\0", article))).split("\0")
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_branches_that_all_pages_share_go(spark):
    page = "<body><div class=top><p>Welcome to our site</p></div><div class=story><p>Story {0} begins</p><p>and ends {0}</p><p>In all pages</p></div><div class=end><p>Call us</p></div></body>"
    rows = [(i, f"http://One.example/{i}", page.format(i)) for i in range(8)] + [(100, "http://two.example/", page.format(100))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for r in P.main_texts(df).collect():  # the second host shows one page, so all hosts' tree judges it
        assert r.text == f"Story {r.page_id} begins\nand ends {r.page_id}\nIn all pages"
    alone = P.main_texts(df.filter("page_id = 100")).first()
    assert alone.text.startswith("Welcome")  # nothing to compare with: nothing is known to be shared


def test_equal_pages_are_one_page(spark):
    page = "<body><div class=story><p>Story {0}</p></div><div class=end><p>Call us</p></div></body>"
    rows = [(i, "http://one.example/", page.format(0)) for i in range(6)] + [(10 + i, f"http://h{i}.example/", page.format(0)) for i in range(6)]
    rows += [(20 + i, "http://two.example/", page.format(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    alone = df.filter("page_id < 20")  # one content only, on one host and on others: nothing is known to be shared
    assert {r.text for r in P.main_texts(alone).collect()} == {"Story 0\nCall us"}
    got = {r.page_id: r.text for r in P.main_texts(df).collect()}  # the copies' hosts show one page each, so all hosts' tree judges them
    assert got == {i: f"Story {max(i - 20, 0)}" for i, *_ in rows}


def test_shared_blocks_inside_an_article_go(spark):
    page = "<main><div class=bar><p>Read our terms</p></div><article><h1>T{0}</h1><p>Story {0}</p><div class=end><p>Call us</p></div></article></main>"
    rows = [(i, "http://one.example/", page.format(i)) for i in range(6)] + [(9, "http://two.example/", "<article><div class=end><p>Only here</p></div></article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in P.main_texts(df).collect()}
    assert got == {i: f"T{i}\nStory {i}" for i in range(6)} | {9: "Only here"}


def test_importance(spark):
    page = "<body><div class=a><p>same</p></div><div class=b><p>{0}</p></div></body>"
    df = spark.createDataFrame([("h", page.format(i)) for i in range(10)], "host string, html string")
    tree = {r.path: r.importance for r in P.style_tree(df).collect() if r.host == "h"}
    assert tree["/div.a#/p.#"] == 0 and tree["/div.b#/p.#"] > 0.9 and tree["/div.a#"] < 0.5 < tree["/div.b#"] + 0.1


def test_edges(spark):
    rows = [(1, None, None), (None, "no host", "<p>x</p>"), (2, "http://h/", ""), (2, "http://h/", ""), (3, None, "<article>" + "<p>long text</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS low", "4 AS n_chars", "5 AS text")
    got = sorted([(r.page_id, r.url, r.text, r.n_chars) for r in P.main_texts(df).collect()], key=str)
    long = "\n".join(["long text"] * 20_000)
    assert got == sorted([(1, None, "", 0), (None, "no host", "x", 1), (2, "http://h/", "", 0), (2, "http://h/", "", 0), (3, None, long, len(long))], key=str)
    assert P.main_texts(df.filter("page_id > 99")).count() == 0
