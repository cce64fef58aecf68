"""HTML extraction: written cases, template counts, odd pages."""

import pytest

from platewise.llm import html_extraction

CASES = [
    ("", ""),
    ("plain &amp; simple &#233; &copy; 2 < 3", "plain & simple é © 2 < 3"),
    ("<p>a<b>c</b>d<br>e</p><p>f <p class='x", "acd e f"),
    ("<article><h1>T</h1><p>one\n two<p><b>three<br><p>four</article><footer>no</footer>", "T one two three four"),
    ("<nav>no</nav><div class='ad'>no</div><article>yes</article><aside>no</aside>out", "yes"),
    ("<head><title>no</title></head><script>var t='</p>';</script><style>p{}</style><p>ok", "ok"),
    ("<!-- <p>no</p> --><p>ok</p><![CDATA[no]]><!DOCTYPE html>", "ok"),
    ("<div id=cookie-banner>no</div><main><header>Title</header>body<form>no<input></form></main>", "Title body"),
    ("<article>a<section class='comments'><p>no</p></section><article class=comment>no</article></article>", "a"),
    ("<header>no</header><div>loads of adjectives</div><div class='loads'>yes</div>", "loads of adjectives yes"),
    ("<ul><li>1<li>2</ul><table><tr><td>3<td>4<tr><td>5</table>", "1 2 3 4 5"),
    ("<a title='x > y' href=z>link</a>ed", "linked"),
    ("<p hidden>no</p><p aria-hidden='true'>no</p><div role=navigation>no</div>yes", "yes"),
    ("</div></p>stray</article>", "stray"),
    ("<script>never closed <p>no", ""),
    ("<p>one<script>x</script>two<img src=a>3<custom-tag>4</custom-tag><svg><path d=x></svg>5", "onetwo345"),
    ("H<img src=a>2O<br>x<wbr>y<template>no</template>z", "H2O xyz"),
    (
        '<article><h2 id="search-engines">Search engines</h2><p>They rank pages.</p><h2 class="related" id="related-work">'
        'Related work</h2><p>Old.</p><section id="social-share-of-income"><p>Income text.</p></section></article>',
        "Search engines They rank pages. Related work Old. Income text.",
    ),
    ("<article>a<div class='share-buttons'>no</div><div class='market-share'>yes</div><div id=comments>yes</div></article>", "a yes yes"),
    ("<div id=social-share-of-income>yes</div><div id=site-footer-2>no</div><div class='x-menu-y'>no</div>", "yes"),
    ("<article>a<b>b</article></b>c</b><p>d", "ab"),
    ("<ul><li><b>1<li>2</b></ul>3<dl><dt>4<dd>5<dt>6</dl>", "1 2 3 4 5 6"),
    ("<a x='never closed> <p>text</p>", "text"),
    ("before <a cut off", "before"),
    ("x <!-- never closed <p>no", "x"),
    ("a<script>no</scripted>no</script >b</textarea", "ab"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ("<div>" * 400 + "<div class=menu>no</div><nav>no</nav>deep", "deep"),
    ("<article>" + "<i>" * 60000 + "deep" + "</i>" * 60000 + "</article>", "deep"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_cases(html, text):
    root, _ = html_extraction._subtrees(html.encode(), "http://a.example/")
    assert html_extraction.text_of(root, set()) == text


HOSTILE = [
    "<a x ", '<a "', "<a '>", "<a x='>", "<a \"><b '>", "<", "</", "</b", "<b>", "</i><b>", "<b></i>", "<p><b><div>", "<li><b>", "<td>",
    "<script>", "</script", "<script></script", "<!-", "<!--", "<?", "&", "&#", "<a x", "x=", "<x " + "y" * 50, "<div class=menu>", "<table><b>",
]


@pytest.mark.parametrize("piece", HOSTILE)
@pytest.mark.parametrize("end", ["", ">", '">', "</p>"])
def test_time_grows_as_the_page(piece, end):
    """A page of 200 kB of the same piece is read in seconds."""
    import time

    page = (piece * (200_000 // len(piece)) + end).encode()
    start = time.perf_counter()
    html_extraction.text_of(html_extraction._subtrees(page, "http://a.example/")[0], set())
    assert time.perf_counter() - start < 10


def test_a_long_attribute():
    page = "<p " + "a" * 300_000 + " b" * 100_000 + ">text"
    assert html_extraction.text_of(html_extraction.parsed(page), set()) == "text"


def test_half_of_the_letters():
    """The text inside articles counts alone from half of the letters on."""
    for inside, outside, want in (("abcde", "fghij", "abcde"), ("abcd", "fghij", "abcd fghij")):
        page = html_extraction.parsed(f"<article>{inside}</article><p>{outside}</p>")
        assert html_extraction.text_of(page, set()) == want


def naive_templates(pages, least_pages, least_share):
    """For each host its subtrees that enough distinct pages have, counted one by one."""
    seen, contents = {}, {}
    for url, html in pages:
        root, keyed, host, content = html_extraction._keyed(html.encode(), url)
        if content is None:
            continue
        contents.setdefault(host, set()).add(content)
        for key, _ in keyed:
            seen.setdefault((host, key), set()).add(content)
    return {
        key for (host, key), of in seen.items()
        if len(of) >= least_pages and len(of) >= least_share * len(contents[host])
    }


def test_counts_change_pages_as_counted_one_by_one(spark):
    """Random pages of a few hosts with boxes that recur; without the counts other text is left."""
    import random

    rng = random.Random(8)
    boxes = [f"<div><p>box {i}</p><ul><li>entry {i}<li>all</ul></div>" for i in range(6)]
    pages = []
    for i in range(160):
        parts = [b for j, b in enumerate(boxes) if rng.random() < (0.2, 0.5, 0.6, 0.9, 0.4, 0.55)[j]]
        parts.insert(rng.randrange(len(parts) + 1), f"<p>text {rng.randrange(90)} <b>all</b></p>")
        pages.append((f"https://h{rng.randrange(4)}.example/{i}", "".join(parts)))
    rows = [(i, *p) for i, p in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [r["text"] for r in html_extraction.extract_text(table, rows_per_part=20).orderBy("page_id").collect()]
    gone = naive_templates(pages, html_extraction.LEAST_PAGES, html_extraction.LEAST_SHARE)
    want, without = [], []
    for url, html in pages:
        root, keyed = html_extraction._subtrees(html.encode(), url)
        want.append(html_extraction.text_of(root, {id(e) for k, e in keyed if k in gone}))
        without.append(html_extraction.text_of(root, set()))
    assert got == want
    assert sum(a != b for a, b in zip(want, without)) > 100
    off = html_extraction.extract_text(table, least_pages=10**9).orderBy("page_id").collect()
    assert [r["text"] for r in off] == without


def test_templates_by_host(spark):
    """What five pages of a host share goes, except in an article; other hosts keep it."""
    rows = []
    for i in range(6):
        rows.append((i, f"https://one.example/{i}", f"<div><span>share me</span></div><p>text {i}</p>"))
    for i in range(4):
        rows.append((10 + i, f"https://two.example/{i}", f"<div><span>share me</span></div><p>text {i}</p>"))
    for i in range(9):
        rows.append((20 + i, "http://one.example:80/a", "<div>x</div><article><p>same words</p></article>"))
    rows += [(30, None, "<p>alone</p>"), (31, "https://one.example", None), (32, "", ""), (30, None, "<p>alone</p>"), (None, None, None)]
    pages = spark.createDataFrame([r + ("own", 1) for r in rows], "page_id long, url string, html string, text string, part int")
    result = html_extraction.extract_text(pages, rows_per_part=7)
    assert result.columns == ["page_id", "url", "part", "text", "n_chars"]
    got = sorted(((r["page_id"] is None, r["page_id"] or 0), r["text"], r["n_chars"]) for r in result.collect())
    want = []
    for i, url, html in rows:
        if i is None or not html:
            text = ""
        elif i < 10:
            text = f"text {i}"
        elif i < 20:
            text = f"share me text {i - 10}"
        else:
            text = "same words" if i < 30 else "alone"
        want.append(((i is None, i or 0), text, len(text)))
    assert got == sorted(want)


def extracted(spark, htmls):
    rows = [(i, f"https://one.example/{i}", html) for i, html in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r["text"] for r in html_extraction.extract_text(pages, rows_per_part=7).orderBy("page_id").collect()]


def test_copies_are_no_template(spark):
    """Copies of a page count once, also where the element that holds the article is one."""
    wrapped = "<div><p>intro</p><article><p>the article itself</p></article></div>"
    plain = "<div><p>all of the page</p></div>"
    others = [f"<p>page {i}</p>" for i in range(5)]
    texts = extracted(spark, [wrapped] * 6 + [plain] * 6 + others)
    assert texts == ["the article itself"] * 6 + ["all of the page"] * 6 + [f"page {i}" for i in range(5)]
    shells = [f"<p>teaser {i}</p><div><p>box</p><article>the one article</article></div>" for i in range(6)]
    assert extracted(spark, shells) == ["the one article"] * 6


def test_short_elements_of_a_big_host(spark):
    """What a fifth of the pages have is no template; neither are words of a sentence."""
    pages = [
        f"<div>terms of use</div><p>see the <b>Note</b> {i}</p>"
        + ("<h2>Introduction</h2><table><tr><td>2019<td>" + str(i) + "</table>" if i % 5 == 0 else "")
        for i in range(40)
    ]
    want = [f"see the Note {i}" + (f" Introduction 2019 {i}" if i % 5 == 0 else "") for i in range(40)]
    assert extracted(spark, pages) == want


def test_elements_without_text_are_no_template(spark):
    assert extracted(spark, [f"<p>{i} un<wbr>bro<i></i>ken</p>" for i in range(6)]) == [f"{i} unbroken" for i in range(6)]


def test_articles_and_templates(spark):
    """Boxes that recur inside main go; the article counts only where it is most of the page."""
    boxed = [f"<main><ul><li>home<li>shop</ul><p>{'word ' * 9}{i}</p></main><p>out</p>" for i in range(6)]
    assert extracted(spark, boxed) == [f"{'word ' * 9}{i}" for i in range(6)]
    cards = [f"<div><p>the real text of page {i}</p></div><article><p>read on</p></article>" for i in range(6)]
    assert extracted(spark, cards) == [f"the real text of page {i}" for i in range(6)]
    assert extracted(spark, cards[:1]) == ["the real text of page 0 read on"]


def test_article_in_other_surroundings(spark):
    """An article that many pages of a host have stays, whatever is around it."""
    pages = [f"<p>seen {i}</p><article><p>{'the same words ' * 3}</p></article>" for i in range(8)]
    assert extracted(spark, pages) == [("the same words " * 3).strip()] * 8


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extraction.extract_text(pages).count() == 0


def test_articles_of_given_pages(spark):
    """The pages of the tables hold one article each."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in html_extraction.op10_html_extraction(spark, "/root/testdata/sf0.001").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r["page_id"]], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div)>", " ", inner))
        assert r["text"] == " ".join(html.unescape(plain).split())
        assert r["n_chars"] == len(r["text"])
