import html
import json
import re

import duckdb

from dockline.llm.html_extract import Reader, align, article_slots, extract, parse, slots

SMALL = "/root/testdata/sf0.001"


def plain(page):
    """The article of the test tables' pages, by its own tags."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
    return " ".join(filter(None, (" ".join(html.unescape(p).split()) for p in parts)))


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {i: plain(h) for i, h in duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall()}
    got = extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def read(page):
    return Reader().read(page, "h", None)


def test_parts_that_are_no_article():
    assert read('<body class="has-sidebar"><div id="header">Site</div><div class="content"><div class="post"><h2>T</h2>'
                '<p>Hello <b>wor</b>ld &eacute; &lt;x&gt;</p><p>more text of it</p></div><div class="comments"><p>reader'
                '</p></div></div><form>f<input></form><script>if(a<b){"</p>"}</script></body>'
                ) == "T Hello world é <x> more text of it"
    assert read('<article><header>hh</header><p>one<p>two<aside>x</aside><div class="advert-box"><p>buy</p></div>'
                '<section id=comments><article class=comment><p>c</p></article></section><div role="alert">n</div>'
                '<p>three') == "one two three"
    assert read("<article>a < b &amp;amp; c<br>d&nbsp;e<ul><li>x<li>y</ul></article>") == "a < b &amp; c d e x y"
    assert read('<article><p title="a>b">q</p><!-- <p>no</p> --></article>') == "q"


def test_broken_pages():
    for page in ("", "<", "<a", "<p", "<!-- x", "<script>x", "<article>", "&", "</p></div>", "<a <a <a <a"):
        assert read(page) in ("", "<", "&")
    assert read(None) == "" and read("plain text only") == "plain text only"
    assert len(read("<article>" + "<p>word</p>" * 50_000)) == 250_000 - 1


def test_wrapper_aligns_optional_and_repeated_groups_and_slots():
    a = parse("<body><ul><li>m<li>n</ul><div class=x><p>one</p></div>same</body>")
    b = parse("<body><ul><li>m</ul><h2>new</h2><div class=x><p>two</p><p>three</p></div>same</body>")
    body = align(a, b)[4][0][4]
    assert [(n[0], n[1]) for n in body] == [("ul", 0), ("h2", 1), ("div class=x", 0), ("#", 0)]
    assert body[0][4][0][4][0][2] == 1  # li: repeated
    assert body[2][4][0][4][0][5] is None and body[3][5] == "same"  # a slot; a constant


def test_constants_of_a_host_are_not_its_article(spark):
    page = "<body><table><tr><td>Home and more links here</td></tr></table><div><p>{}</p></div></body>"
    rows = [(k, "http://H.example/x", page.format(f"article {k} has its own words in it")) for k in range(6)]
    rows += [(7, None, "<p>no host</p>"), (8, "http://h.example/y", None), (9, "rubbish", ""), (None, "", "<article>a")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"article {k} has its own words in it" for k in range(6)}, 7: "no host", 8: "", 9: "", None: "a"}
    assert extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_wrapper_travels_as_json():
    tree = parse("<body><nav>n</nav><article><p>x</p></article></body>")
    assert article_slots(json.loads(json.dumps(tree))) == {("body", "article", "p")}


def test_offsets_and_quotes():
    turkish = "İ" * 10
    assert read(f"<article><p>{turkish} one</p><p>two</p><SCRIPT>x</sCript><p>three</p></article>") == f"{turkish} one two three"
    assert read("<article><p title='a>b' href=x>q</p><p data-x = 'it\"s > it' >r</p><p title=it's>s</p></article>") == "q r s"
    assert read('<article><p title="a>b>one</p><p>two</p></article>') == "b>one two"  # a quote that is never closed
    assert read('<article><p data-class="advert" x-id=\'menu\'>one</p><KK>two</article>') == "one two"


def test_words_of_the_article_own_parts():
    assert read('<article><div class="post-header"><h1>T</h1></div><p class="long-form">a</p><section id="search-engines">'
                '<p class="form-factor">b</p></section><div class="search">no</div><div class="search-form">no</div>'
                '<div class="advert-box">no</div></article>') == "T a b"


def test_a_hint_decides_where_the_pages_agree(spark):
    page = ('<article><div class="contact-form"><p>Name and address</p></div><div class="post-header"><p>Title {0}</p></div>'
            '<p>text {0}</p></article>')
    rows = [(k, "http://h.example/x", page.format(f"number {k}")) for k in range(5)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title number {k} text number {k}" for k in range(5)}


def test_deep_pages(spark):
    deep = "<div>" * 5000
    assert read(f"<article>{deep}<p>one</p><nav>no<p>no</p></nav><p>two</p>" + "</div>" * 5000 + "<p>three") == "one two three"
    assert read(f"{deep}<nav>no</nav><article><p>one</p><aside><p>no</p></aside></article>") == "one"
    rows = [(k, "http://h.example/x", f"<article>{deep}<p>page {k}</p>{'<nav>n</nav></div>' * 5000}") for k in range(3)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"page {k}" for k in range(3)}


def test_three_templates_with_unmarked_boilerplate(spark):
    """The rarest template, seen on three pages among many, has its boilerplate left out too."""
    templates = ["<body><table><tr><td>Home and more links here</td></tr></table><div><p>{}</p></div></body>",
                 "<body><ul><li>All our offices in the world<li>write to us</ul><section><p>{}</p></section></body>",
                 "<body><dl><dd>A standing line of the third kind</dl><blockquote><p>{}</p></blockquote></body>"]
    rows = [(k, "https://h.example/x", templates[2 if k % 40 == 7 else k % 2].format(f"article {k} has its own words in it"))
            for k in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert got == {k: f"article {k} has its own words in it" for k in range(120)}
    copies = spark.createDataFrame([(k, "https://c.example/x", templates[0].format("one and the same")) for k in range(9)],
                                   "page_id long, url string, html string").repartition(5)
    assert {r.text for r in extract(copies).collect()} == {"Home and more links here one and the same"}  # one page, nine times


def test_wrappers_add_up_in_any_order():
    pages = [f"<body><p>same</p><div class=c{'x' * (k % 4)}><b>v</b>{k}</div><ul>{'<li>i' * (k % 3)}</ul></body>" for k in range(12)]
    trees = [parse(p) for p in pages]

    def fold(order):
        out = order[0]
        for t in order[1:]:
            out = align(out, t)
        return {path: (len(slot[3]), slot[5]) for path, slot in slots(out)}
    one = fold(trees)
    assert fold(trees[::-1]) == one == fold(trees + trees)
    halves = [trees[:5], trees[5:]]
    parts = []
    for h in halves:
        out = h[0]
        for t in h[1:]:
            out = align(out, t)
        parts.append(out)
    assert fold(parts) == fold(parts[::-1]) == one


def test_handed_on_wrappers():
    from dockline.llm import html_extract
    page = "<body><table><tr><td>Home and more links here</td></tr></table><div><p>{}</p></div></body>"
    folds = [[parse(page.format(f"text {k}"))] for k in range(10)]
    batch = html_extract.handed_on({str(k): f[0] for k, f in enumerate(folds)})
    assert batch.num_rows == 10 and all(0 <= s < html_extract.SALTS for s in batch.column(1).to_pylist())
    tree = folds[0][0]
    for f in folds[1:]:
        tree = align(tree, json.loads(json.dumps(f[0])))
    kept = html_extract.common(tree)
    assert article_slots(kept) == {("body", "div", "p")} and len(list(slots(kept))) == 2
    assert html_extract.common(parse(page))[4] == []  # one page is no host
