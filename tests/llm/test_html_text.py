"""Texts of pages with known articles, alignments against the classic table, pairing across ranges."""

import random

from skarn.llm.html_text import common, extract, lines, op1_html_extraction, shared_lines

FOLDER = "/root/testdata/sf0.01"


def article_of(page):
    """The article of the given pages, cut by hand: they have one article element without furniture."""
    import html
    import re

    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", inner))
    return "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = op1_html_extraction(spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article_of(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment():
    rnd = random.Random(4)
    for _ in range(1500):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(0, 14))] for _ in range(2))
        places = common(a, b)
        assert len(places) == longest(a, b) and places == sorted(set(places))
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in places)
    long = [rnd.randrange(10**9) for _ in range(4000)]
    assert len(common(long, [x for x in long if x % 3])) == sum(x % 3 > 0 for x in long)


def test_structure():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body>
    <header>Site</header><nav><ul><li>Home<li>About</ul></nav><div id="cookie-notice">We use cookies</div>
    <main><h1>Title &amp; more</h1><p>One<br>two&nbsp;three <b>bo</b>ld<!-- not this --> <script>var a = "</p>";</script>
    <p>Next 1 &lt; 2</p><div class="ad">Buy</div><form>Search <input></form><ul><li>a<li>b</ul>
    <aside>Side</aside><div class="reader comments"><p>First!</p></div><p>Last &am</main>
    <p>outside</p><footer>&copy; x</footer></body>"""
    assert [t for t, mark in lines(page) if mark == 0] == ["Title & more", "One two three bold", "Next 1 < 2", "a", "b", "Last &am"]
    assert lines(None) == [] and lines("") == [] and lines("plain") == [("plain", 1)]
    assert lines("<p>a<script>never closed") == [("a", 1)]


def test_names_do_not_mark_the_page_and_open_elements_end():
    kept = lambda page: [t for t, mark in lines(page) if mark != 2]
    assert kept('<html class="no-search"><body class="no-sidebar"><p>one<p>two</body></html>') == ["one", "two"]
    assert kept('<body><article class="post has-comments"><p>text</article><p>else</body>') == ["text"]
    assert kept('<body><main id="content-with-sidebar"><h1 class="post-header">Title</h1>text</main></body>') == ["Title", "text"]
    assert kept('<article><p class="notice">take care<p>one<div><p class="ad">buy</div>two</article>') == ["one", "two"]
    assert kept("<article><ul><li class=ad>buy<li>one<li class=promo>more</ul>two</article>") == ["one", "two"]
    assert kept("<dl><dt class=ad>buy<dd>one<dt>two<dd class=promo>more</dl>three") == ["one", "two", "three"]
    assert kept("<table><tr class=ad><td>buy<tr><td>one<td class=share>send<td>two<tr><td class=ad>x</table>three") == ["one", "two", "three"]
    assert kept("<p>one <span class=ad>buy</p>two") == ["one", "two"]
    assert kept("<div class=ad><ul><li>buy<li>now</ul><table><tr><td></div>still</table></div>two") == ["two"]
    assert kept("<head><title>t</title><body><p>one") == ["one"]


def _plain_page(i, host):
    menu = "".join(f"<div>{host} menu {k}</div>" for k in range(5))
    return f"<body>{menu}<div>words of page {i} alone</div><div>more of {i}</div><div>{host} imprint</div></body>"


def test_differencing(spark):
    rows = [(i, f"https://Host{i % 3}.example.org/a/{i:04d}?q=1", _plain_page(i, i % 3)) for i in range(300)]
    rows += [(1000, None, None), (1001, "no address", ""), (1002, "https://alone.example.org/", _plain_page(7, 9)), (5, *rows[5][1:]), (None, *rows[6][1:])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, h int")
    for parts in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = extract(frame).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert len(got) == len(rows)
        for r in got:
            if r["page_id"] is not None and r["page_id"] < 300 and r["page_id"] not in (5, 6):
                assert r["text"] == f"words of page {r['page_id']} alone\n\nmore of {r['page_id']}", r
        by = {r["page_id"]: r["text"] for r in got}
        assert by[1000] == by[1001] == "" and by[1002].startswith("9 menu 0\n\n") and "imprint" in by[6]  # 6 and its copy
    assert extract(frame.limit(0)).count() == 0 and shared_lines(frame.limit(0).select("page_id", "url", "html")).count() == 0
