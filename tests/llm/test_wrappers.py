"""Main text of pages: wrappers with optional and repeated parts, marked-up traps, odd rows."""

import html
import re

from aligner.llm import catalog, wrappers

SCHEMA = "page_id long, url string, html string, text string, wrapper string, host int"
TEMPLATE = """<html><head><title>x</title></head><body><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div class="left sidebar">side <b>bar</b></div><main><article><header class="article-header"><h1>Title %d &amp;
more</h1></header><p>Para one<b>bold</b> x&nbsp;y.<p>Second &lt;p&gt; 3 < 4 &eacute;&#233;%s<div class="ad">AD</div><ul><li>item a<li>item b</ul>
<form>name <input></form><aside>see</aside><span class="sponsored">buy</span><script>var a="</p><p>no";</script><p hidden>gone</p></article>
<section class="comments"><p>Great!</p></section></main><footer>c</footer></body></html>"""
PLAIN = """<body><div class=top><a href=1>A</a> <a href=2>B</a></div><div class="post-content"><h2>T%d</h2><p>Body text %s is long.</p>%s</div>
<div>All rights reserved</div></body>"""


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "x", 3) for i, u, h in rows], SCHEMA)


def texts(spark, rows):
    return {r.page_id: (r.url, r.text, r.n_chars) for r in wrappers.main_text(frame(spark, rows)).collect()}


def test_article_without_its_surroundings(spark):
    rows = [(i, f"https://a.example/{i}", TEMPLATE % (i, "<p>more</p>" * i)) for i in range(5)]
    for i, (url, text, n) in texts(spark, rows).items():
        assert url == rows[i][1] and n == len(text)
        assert text == " ".join([f"Title {i} & more Para onebold x y. Second <p> 3 < 4 éé", *["more"] * i, "item a item b"])


def test_pages_without_article_elements(spark):
    rows = [(i, f"http://B.example:80/{i}", PLAIN % (i, f"number {i}", f"<p>another {i}</p>" * i)) for i in range(5)]
    for i, (_, text, _) in texts(spark, rows).items():
        assert text == " ".join([f"T{i} Body text number {i} is long.", *[f"another {i}"] * i])


def test_odd_rows(spark):
    pages = [None, "", "plain text only", "<p>unclosed <b", '<a href="x', "<!-- never closed <p>x", "&amp;", "<script>never", "</p></div>x",
             "<article><p>" + "long &amp; " * 60000 + "</p>", "<article>" + "<p>x y</p>" * 3000 + "</article>"]
    rows = [(i, None if i % 2 else "no host", h) for i, h in enumerate(pages)] + [(None, "http://c/1", "<article>q</article>")] * 2
    got = sorted(((r.page_id, r.text) for r in wrappers.main_text(frame(spark, rows)).collect()), key=repr)
    wanted = {0: "", 1: "", 5: "", 7: "", 9: ("long & " * 60000).strip(), 10: ("x y " * 3000).strip(), None: "q"}
    assert len(got) == len(rows)
    assert all(t == wanted[i] for i, t in got if i in wanted)
    assert wrappers.main_text(frame(spark, rows).limit(0)).collect() == []


def test_groups_and_optional_parts():
    def stream(page):
        return wrappers.collapse(wrappers.read(page)[0])

    one = stream("<article><h1>a</h1><p>x</p></article>")
    many = stream("<article><h1>b</h1><p>x</p><p>y</p><p>z</p><div>extra</div></article>")
    wrapper = wrappers.align(one, many)
    assert [(n.key, n.optional) for n in wrapper] == [
        ("<article", False), ("<h1", False), ("#article/h1", False), ("/h1", False), ("(<p #article/p /p)+", False), ("<div", True),
        ("#article/div", True), ("/div", True), ("/article", False)]
    assert wrapper[2].constant is None and wrapper[2].pages == 2


def test_query_gives_the_articles(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = catalog.QUERIES["op1_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())


LAYOUTS = ['<html><body><div class="post"><h2>T{0}</h2><p>Body text number {0} of a longer post, which goes on.</p></div></body></html>',
           '<html><body><div class="news"><p>Short news {0}.</p></div></body></html>']


def test_every_layout_of_a_host_keeps_its_text(spark):
    rows = [(i, f"https://two.example/{i}", LAYOUTS[i % 2].format(i)) for i in range(10)]
    for i, (_, text, _) in texts(spark, rows).items():
        assert text == (f"Short news {i}." if i % 2 else f"T{i} Body text number {i} of a longer post, which goes on.")


def test_pages_without_host_keep_their_own_text(spark):
    names = ["story", "entry", "content", "text"]
    rows = [(i, None if i % 2 else "no host", f'<body><div class="{n}"><p>{"Words of " * (i + 1)}{n}.</p></div></body>') for i, n in enumerate(names)]
    for i, (_, text, _) in texts(spark, rows).items():
        assert text == f"{'Words of ' * (i + 1)}{names[i]}."


def test_parts_of_an_article_in_containers_side_by_side(spark):
    page = '<body><div class="lead"><p>Lead {0} tells what follows.</p></div><div class="story"><p>Story {0} has {1}.</p></div><div>Imprint</div></body>'
    rows = [(i, f"https://parts.example/{i}", page.format(i, "many words " * 6)) for i in range(4)]
    for i, (_, text, _) in texts(spark, rows).items():
        assert text == f"Lead {i} tells what follows. Story {i} has {'many words ' * 6}."


def test_copies_of_a_page_count_once(spark):
    one = "<body><div><p>T</p></div></body>"
    rows = [(i, "https://copies.example/x", one) for i in range(40)] + [(i, None, one) for i in range(40, 43)]
    assert {r[1] for r in texts(spark, rows).values()} == {"T"}
    page = "<body><div><p>Text {0}.</p></div><div>Imprint</div></body>"
    rows = [(i, "https://mixed.example/x", page.format(max(0, i - 30))) for i in range(33)]
    assert {r[1] for r in texts(spark, rows).values()} == {f"Text {i}." for i in range(3)}
    pages = spark.createDataFrame([("h", one)] * 40, "host string, html string").repartition(7)
    (wrapper,) = wrappers.infer(pages).collect()
    assert {n.pages for n in wrappers._unpacked(wrapper.wrapper)} == {1}
