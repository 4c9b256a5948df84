"""Main text of pages: made pages whose articles are known, odd markup, and the hosts' votes."""

import random

import pytest

from rolegrain.llm import html

from .conftest import prose


def test_html(spark):
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use</div><div><div class="sidebar">side</div>
    <article><header><h1>Title &amp; x</h1></header><p>Para <b>bo</b>ld one. <p>Two&nbsp;x &#233;<ul><li>a<li>b</ul><script>var a = "</p>";</script><div class="share">tweet</div>
    <form><input>go</form></article><section class="comments"><p>reader says a lot, a lot more than the article itself</p></section></div><footer>f</footer></body></html>"""
    url = "https://a.example/1"
    pages = spark.createDataFrame([(1, url, page, 1), (2, url, page[: page.index("Two")], 1), (3, None, None, 1), (4, url, "", 1), (5, "odd", "plain <b>text</b> &am", 1), (5, "odd", "a<!-- cut", 1), (6, url, "<p>no article here, but <i>so</i>me text</p>", 1)], "page_id long, url string, html string, host int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect())
    assert [g[1] for g in got] == ["Title & x Para bold one. Two x é a b", "Title & x Para bold one.", "", "", "a", "plain text &am", "no article here, but some text"]
    assert all(n == len(t) for _, t, n in got) and html.extract(pages.where("page_id < 0")).count() == 0


def read(source: str) -> str:
    return html.Page(source).text([])


@pytest.mark.parametrize("source, text", [
    ("<p>before <a href=x title=it's>link</a> after</p><p>more text here</p>", "before link after more text here"),
    ("<p title = 'a > b' data-x=\"<p>\">one</p>two", "one two"),
    ("<p class=a=\"b>one", "one"),
    ("<p title=\"never closes>one</p><p>two", "one two"),
    ("a<br>b<b>c</b>d<img src=x>e<wbr>f", "a bcdef"),
    ("<article><h1>T</h1><div class='social-history'>history</div><div class='search-methods'>methods</div><div id=share-buttons>tweet</div><ol class=commentlist><li>c</ol></article>", "T history methods"),
    ("<article>a<svg><text>b</text></svg>c<noscript>d</noscript></article>", "a c"),
    ("x &lt;b&gt; &#x41;&#66; &nbsp; &unknown; & y", "x <b> AB &unknown; & y"),
])
def test_markup(source, text):
    assert read(source) == text


def made(r: random.Random, host: int) -> tuple[str, str]:
    """A page of a host's template and its article, by construction."""
    quote = lambda v: r.choice([f'"{v}"', f"'{v}'"])
    blocks, want = [], []
    for _ in range(r.randrange(2, 8)):
        words = prose(r.randrange(10**6), r.randrange(8, 40))
        want.append(words)
        inner = words.replace(" of ", r.choice([" <b>of</b> ", " <i title=it's>of</i>\n\t", " of<!-- no --> ", " <a href=/x?a='1'>of</a> "]))
        blocks.append(r.choice(["<p>{}</p>", "<p>{}", "<div class=" + quote("social-history") + ">{}</div>", "<h2>{}</h2>", "<ul><li>{}</ul>", "<blockquote>{}</blockquote>"]).format(inner))
    body = "".join(b + r.choice(["", "\n", f"<div class={quote('share-bar')}>Share me</div>", "<script>x='<p>no</p>'</script>", f"<aside>{prose(r.randrange(99), 5)}</aside>"]) for b in blocks)
    menu = "<nav><ul>" + "<li><a href='#'>menu item</a>" * r.randrange(1, 9) + "</ul></nav>"
    notes = f"<section id={quote('comments')}>" + f"<p>{prose(r.randrange(10**6), 120)}</p>" * 3 + "</section>"
    main = [f"<article>{body}</article>", f"<div class={quote('post-' + str(r.randrange(99)))}>{body}</div>", f"<main><div>{body}</div></main>"][host % 3]
    side = f"<div class={quote('sidebar')}><p>{prose(7, 30)}</p></div>"
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{menu}<header>site</header>{side}<div>{main}</div>{notes}<footer>f &copy;</footer></body></html>", " ".join(" ".join(want).split())


def test_made_pages(spark):
    r = random.Random(6)
    pages = [(i, f"https://h{i % 6}.example/{i}", *made(r, i % 6)) for i in range(240)]
    got = {x.page_id: x for x in html.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()}
    assert [p[0] for p in pages if got[p[0]].text != p[3]] == [] and all(x.n_chars == len(x.text) for x in got.values())


def test_hosts_vote_on_names_in_doubt(spark):
    """The same class is dropped where pages repeat its text, kept where each has its own."""
    def page(i, same):
        return f"<body><article><p>{prose(i, 40)}</p><div class='related-method'>{prose(500, 9) if same else prose(600 + i, 9)}</div></article></body>"

    rows = [(i, "https://a.example/x", page(i, True)) for i in range(6)] + [(10 + i, "https://b.example/x", page(i, False)) for i in range(6)]
    rows += [(20 + i, "https://c.example/x", page(3, True)) for i in range(4)]  # copies of one page say nothing
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose(i, 40) and got[10 + i] == f"{prose(i, 40)} {prose(600 + i, 9)}" for i in range(6))
    assert all(got[20 + i] == f"{prose(3, 40)} {prose(500, 9)}" for i in range(4))


def test_minority_templates_and_ties(spark):
    """A page whose article isn't where its host's winners point is read by itself; equal votes give one result."""
    rows = [(i, "//h.example", f"<article>{prose(i, 50)}</article>") for i in range(8)] + [(9, "//h.example", f"<article>see below</article><main>{prose(9, 90)}</main>")]
    rows += [(20, "//t.example", f"<main>{prose(20, 30)}</main>"), (21, "//t.example", f"<section>{prose(20, 30)}</section>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html.extract(df).collect()}
    assert got[9] == prose(9, 90) and got[20] == got[21] == prose(20, 30)
    assert {x.page_id: x.text for x in html.extract(df.orderBy("html")).collect()} == got


def test_deep_and_long_pages_in_linear_memory():
    n = 100_000
    assert read("<div>" * n + "text") == "text" and read("<b>" * n + "<hr>" * n + "t") == "t"
    assert len(read("<p>word" * n)) == 5 * n - 1 and read("<i>" * n + "</b>" * n + "t") == "t"
    assert read("a " * 10**6) == " ".join("a" * 10**6)
