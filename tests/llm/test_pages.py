"""Page extraction: the best run against trying all runs, whole articles, odd and deep markup."""

import random
import time

import pytest

from tellurion.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="x"><header><a href="/">Home</a></header><nav><ul><li><a href=1>one</a></li><li><a>two</a></li></ul></nav>
<div class="cookie-notice">We use cookies and other things here on this page</div>
<article><h1>A &amp; B</h1><p>First  para\ngraph with <b>some</b> bold words in it.<p>Second one, with enough words to count.
<div class="ad">Buy this thing now</div><p>Third&nbsp;one &lt;here&gt; is the last of them all.</p></article>
<aside>Other stories</aside><form><label>Mail</label><input></form>
<section id="comments"><p>I like it a lot and say so in many words</p></section><footer>&copy; 2020 all of us</footer></body></html>"""


ITEMS = "<ul>" + "".join(f"<li>w{i}</li>" for i in range(20)) + "</ul>"
ITEM_LINES = "\n".join(f"w{i}" for i in range(20))


def site(body):
    return f"<html><body><nav><ul><li><a>Home</a></li></ul></nav>{body}<footer>all of us</footer></body></html>"


#: name: page, text
CASES = {
    "list": (site(f"<article><p>intro</p>{ITEMS}<p>outro</p></article>"), f"intro\n{ITEM_LINES}\noutro"),
    "table": (site("<article><p>intro</p><table><tr><td>a<td>b<tr><th>c</table><p>outro</p></article>"), "intro\na\nb\nc\noutro"),
    "tables": (site("<article>" + "<table><tr><td>a<td>b</table>" * 20 + "</article>"), "\n".join("ab" * 20)),
    "section of an ambiguous class": (site('<article><p>a b</p><section class="social science"><p>c d</p></section><p>e</p></article>'), "a b\nc d\ne"),
    "class with further words": (site('<div id="content"><div class="notice-of-results"><p>one two three four five</p></div></div>'), "one two three four five"),
    "wrapper of an article": (site('<div class="sidebar-layout-ads"><article><p>one two</p></article></div><div class="sidebar">no</div>'), "one two"),
    "class that denies": (site('<div class="no-comments has-sidebar"><p>one two three four</p></div>'), "one two three four"),
    "no article": (site(f"<div><h1>Title here</h1><p>intro text of it</p>{ITEMS}<p>outro text of it</p></div><div class='comments'><p>a long comment</p></div>"), f"Title here\nintro text of it\n{ITEM_LINES}\noutro text of it"),
    "comments as articles": (site('<article><p>one two</p></article><section id="comments"><article><p>I like it very much indeed</p></article></section>'), "one two"),
    "long advert between short parts": (site('<article><p>one</p><div class="ad-box">' + "buy " * 500 + "</div><p>two</p></article>"), "one\ntwo"),
    "head left open": ("<html><head><title>T</title><meta x><p>one two<p>three", "one two\nthree"),
    "advert in a line": (site('<article><p>one <span class="ad">buy</span> two &lt; &amp;nbsp;</p><p class="ad">x y z<p>three</article>'), "one two < &nbsp;\nthree"),
    "quote left open": ('<p title="it>one two</p><p>three four</p>', "one two\nthree four"),
    "raw left open": ("<p>one two</p><script>var x = 1; <p>no</p>", "one two"),
    "only other places": ("<nav>a b c</nav><footer>d e</footer>", ""),
    "less than": ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    "custom elements": (site("<article><x-a-very-long-custom-name><p>one</p></x-a-very-long-custom-name><p>two</article>"), "one\ntwo"),
    "many breaks": (site("<article>one" + "<br>" * 3000 + "two</article>"), "one two"),
}


@pytest.fixture(scope="module")
def fitted(spark):
    return pages.fit_page_weights(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("name", CASES)
def test_whole_articles(fitted, name):
    page, want = CASES[name]
    assert pages.main_text(page, pages.PageWeights()) == want
    assert pages.main_text(page, fitted) == want


def test_best_run_is_the_best_of_all_runs():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.randint(-4, 3) for _ in range(rng.randint(0, 25))]
        runs = [(a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        a, b = pages.best_run(scores)
        assert sum(scores[a:b]) == max([sum(scores[x:y]) for x, y in runs] + [0])


def test_time_grows_with_length_alone():
    for page in ("<b><section>" * 100_000 + "x", '<a "' * 100_000, "<nav>" * 100_000 + "x" + "</p>" * 100_000, "<p>x" * 100_000):
        start = time.time()
        pages.main_text(page, pages.PageWeights())
        assert time.time() - start < 20


def test_pages(spark, fitted):
    rows = [(1, "u", PAGE), (2, "v", None), (3, None, ""), (4, "w", "<p>" * 5000), (5, "x", "just text"), (6, "y", "a <b"), (6, "y", "a <b"), (None, "z", "no id")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = {r.page_id: r for r in pages.extract_pages(d, fitted).collect()}
    want = "A & B\nFirst para graph with some bold words in it.\nSecond one, with enough words to count.\nThird one <here> is the last of them all."
    assert got[1].text == want and got[1].n_chars == len(want)
    assert [got[k].text for k in (2, 3, 4, 5, None)] == ["", "", "", "just text", "no id"]
    assert pages.extract_pages(d, fitted).count() == len(rows)
    assert pages.extract_pages(d.limit(0), pages.fit_page_weights(d.limit(0))).count() == 0


def test_marked_articles_come_out_whole(spark, fitted):
    """Every page of a table against its article as the markup has it, cut out by patterns."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        article = re.sub(r'<div class="ad">.*?</div>', "\n", article, flags=re.S).replace("<br>", " ")
        lines = re.sub(r"\s*\n\s*|\s+", " ", article)
        lines = re.split(r"</?(?:p|h1|div|ul|li|blockquote|h2|h3|table|tr|td)[^>]*>", lines)
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", line)).split()) for line in lines) if x)
        assert pages.main_text(r.html, fitted) == want


def test_weights(fitted):
    assert fitted["word"] > 0 > fitted["out word"] and fitted["in word"] > 0 > fitted["in tag"] > fitted["tag html"]
    assert fitted["other word"] < 0 and fitted["tag body"] < fitted["tag p"] < 0
