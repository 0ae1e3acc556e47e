import html
import re
import time

import pytest

from stridelake.llm import extraction as X
from stridelake.llm.queries import op2_main_text

SF = "/root/testdata/sf0.001"


def test_query_equals_plain_version(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op2_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        want = " ".join(" ".join(html.unescape(t).split()) for t in re.split(r"<[^>]*>", article) if t.strip())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


CASES = [
    ("", ""),
    ("plain text", "plain text"),
    ("a < b & c &lt;d&gt; &eacute;&#233;&#x1F642;&nbsp;e", "a < b & c <d> éé🙂 e"),
    ("<p>one<p>two<b>bold</b>er</p> <div>three\n\t four</div>five", "one twobolder three four five"),
    ("<nav>menu</nav><header>Site</header><article><header><h1>T</h1></header><p>x</article><footer>f</footer>", "T x"),
    ("<body><div class='sidebar'>s</div><div id=cookie-notice>c</div><main><p>m<form>f</form></main><aside>a</aside>", "m"),
    ("<article><p>x<script>var a='</p><p>no'</script>y<style>p{}</style></p><!-- <p>no --></article>", "xy"),
    ("<article>a<article class='comment'>c</article></article><div class=comments>d</div>", "a"),
    ("<article>first</article><p>between</p><article>second</article>", "first second"),
    ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul>", "a b c x y"),
    ("<article><p>cut off <b>in the mid", "cut off in the mid"),
    ("<article>text</article><p>more <a href='x", "text"),
    ("<p hidden>h</p><p style='display: none'>n</p><p aria-hidden=true>i</p><p>shown</p>", "shown"),
    ("</p></div><p>stray</b> ends</p></body></html>", "stray ends"),
    ("<p>" + "<div>" * 3000 + "deep", "deep"),
    ("<title>t &amp; u</title><textarea><p>no</textarea><p>yes</p>", "yes"),
    ("<a title='x > y'>link</a> <img alt=\"<b>\">", "link"),
    ("<P CLASS='Ad'>ad</P><P>Up</P>", "Up"),
    ("<div class='adjacent reader'>kept</div>", "kept"),
    ("<br>a<br/>b<hr>c", "a b c"),
    ("1 <2 and <3> <!doctype html> <?php x ?> end", "1 <2 and <3> end"),
]


@pytest.mark.parametrize("source, want", CASES)
def test_rules(source, want):
    assert X.main_text(X.parse(source)) == want


def test_templates_of_a_site(spark):
    def page(k, host):
        return (k, f"https://{host}/p{k}", f"<body><div><span>Site motto</span><a>Home</a></div><div><p>story {k} of {host}</p><p>shared passage</p></div><div><div>Imprint</div></div></body>")

    rows = [page(k, "a.example") for k in range(40)] + [page(k, f"h{k}.example") for k in range(40, 50)]
    rows += [(100, "https://a.example/x", "<body><p>Site motto</p><article><div><span>Site motto</span><a>Home</a></div>kept</article></body>"), (101, None, "<p>no url"), (102, "https://a.example/y", None), (102, "https://a.example/y", None)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    for limit in (32 << 20, -1):
        got = [(r.page_id, r.text, r.n_chars) for r in X.extract_main_text(df, broadcast_bytes=limit).collect()]
        assert len(got) == len(rows)
        texts = dict((i, t) for i, t, _ in got)
        assert texts[7] == "story 7 of a.example" and texts[45] == "Site mottoHome story 45 of h45.example shared passage Imprint"
        assert texts[100] == "Site mottoHome kept" and texts[101] == "no url" and texts[102] == "" and all(n == len(t) for _, t, n in got)
    assert X.extract_main_text(df).columns == ["page_id", "url", "text", "n_chars", "template_chars"]
    assert X.extract_main_text(df.limit(0)).count() == 0


def test_hosts(spark):
    urls = ["https://User:pw@WWW.Example.com:80/x", "http://a.b", "//no", "", None, "ftp://h?q#f"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(X.host_of().alias("h"))
    assert [r.h for r in df.collect()] == ["www.example.com", "a.b", "", "", "", "h"]


def test_templates_within_articles(spark):
    notice, quote = "<div><p>Our readers pay for this site</p></div>", "<p>a passage that many quote</p>"

    def page(host, name, body):
        return (f"https://{host}/{name}", f"<body><article>{body}</article><p>Imprint</p></body>")

    rows = [page("a.example", k, f"<p>story number {k} has words of its own and more of them</p><b>note</b>{quote}{notice}") for k in range(12)]
    rows += [page("b.example", 0, f"<p>elsewhere</p>{quote}")]
    rows += [page("c.example", k, f"<p>a copied story with quite some words in it</p><p>read {k}</p>") for k in range(12)]
    rows += [page("d.example", k, "<p>one story</p><p>many addresses</p>") for k in range(12)]
    df = spark.createDataFrame(rows, "url string, html string")
    for limit in (32 << 20, -1):
        texts = {r.url: r.text for r in X.extract_main_text(df, broadcast_bytes=limit).collect()}
        assert texts["https://a.example/7"] == "story number 7 has words of its own and more of them note a passage that many quote"
        assert texts["https://b.example/0"] == "elsewhere a passage that many quote"
        assert texts["https://c.example/7"] == "a copied story with quite some words in it read 7"
        assert texts["https://d.example/7"] == "one story many addresses"


def test_templates_count_pages_not_shares_or_copies(spark):
    def page(host, name, section, body):
        return (f"https://{host}/{name}", f"<body><div>Menu of {section}</div><div>{body}</div></body>")

    rows = [page("hot.example", k, "news" if k < 12 else f"shelf {k}", f"story {k}") for k in range(240)]
    rows += [page("copies.example", k, "all", "<p>the only story</p>") for k in range(15)] + [page("copies.example", f"x{k}", f"x{k}", f"other {k}") for k in range(5)]
    rows += [(f"https://bare.example/{k}", f"<body><div>Menu</div><p>{'story ' + str(k) if k else ''}</p></body>") for k in range(12)]
    df = spark.createDataFrame(rows, "url string, html string")
    for limit in (32 << 20, -1):
        texts = {r.url: r.text for r in X.extract_main_text(df, broadcast_bytes=limit).collect()}
        assert texts["https://hot.example/7"] == "story 7" and texts["https://hot.example/70"] == "Menu of shelf 70 story 70"
        assert texts["https://copies.example/3"] == "Menu of all the only story" and texts["https://copies.example/x3"] == "Menu of x3 other 3"
        assert texts["https://bare.example/3"] == "story 3" and texts["https://bare.example/0"] == "Menu"


def test_templates_alone_find_the_text_of_real_pages(spark):
    """Pages of one host without any tag or class that tells an article from the rest."""
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("url LIKE '%//blog.tionsh.example.com/%'").collect()]
    bare = [(i, u, re.sub(r"<(/?)(?:article|nav|footer)>|<div class=.ad.>", lambda m: f"<{m[1] or ''}div>", h)) for i, u, h in pages]
    df = spark.createDataFrame(bare, "page_id long, url string, html string")
    got = {r.page_id: r for r in X.extract_main_text(df, min_pages=3).collect()}
    none = {r.page_id: r for r in X.extract_main_text(df, min_pages=10**9).collect()}
    want = {r.page_id: r.text for r in X.extract_main_text(spark.createDataFrame(pages, df.schema)).collect()}
    assert len(got) == len(pages) > 300
    changed = [i for i in got if got[i].text != none[i].text]
    assert len(changed) > 0.9 * len(pages) and all(got[i].template_chars > 0 for i in changed)
    assert not any(none[i].text == want[i] for i in want) and sum(got[i].text == want[i] for i in want) > 0.65 * len(want)


def test_most_of_a_page_is_no_template(spark):
    rows = [(f"https://a.example/{k}", f"<body><div>Menu {k % 2}</div><div><p>the same long story at many addresses</p></div><div>tail {k}</div></body>") for k in range(40)]
    texts = [r.text for r in X.extract_main_text(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert all("the same long story at many addresses" in t and "Menu" not in t for t in texts)


def test_deep_nesting_is_linear():
    began = time.process_time()
    for source in ("<div>" * 100_000, "<b><p>" * 50_000, "<table><tr><td>" * 30_000, "<ul><li>" * 50_000, "</i>" * 100_000, "<div>" * 50_000 + "</p>" * 50_000):
        assert X.main_text(X.parse(source + "deep")) == "deep"
    assert time.process_time() - began < 12
