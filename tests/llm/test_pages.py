"""Main text of pages: templates, broken markup, style trees."""

import html
import math
import re
import time
from collections import Counter, defaultdict

import pytest

from spoolworks.llm import pages
from spoolworks.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def text_of(page, noise=None):
    return pages.main_text(pages.read_page(page)[0], noise)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<article><h1>T</h1><p>a <b>b</b>c<p>d &amp; &#233;&nbsp;f</article>", "T a bc d & é f"),
        ("<nav>menu</nav><main><p>one</p><aside>side</aside><p>two</main><footer>foot", "one two"),
        ("<div class='ad'>buy</div><div class='shadow load'>kept</div><div id=comments>c</div>", "kept"),
        ("<p>a<script>if (x < 3) document.write('<p>no</p>')</script>b</p><style>p{}</style>", "ab"),
        ("<body><header>top</header><article><header><h1>Head</h1></header>x</article></body>", "Head x"),
        ("<!-- <p>no</p> --><p>x<!-- y", "x"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<ul><li>one<li>two</ul>three<br>four<p hidden>no</p><p style='display: none'>no</p>", "one two three four"),
        ("<table><tr><td>a<td>b<tr><td>c</table><form><p>f</p></form>", "a b c"),
        ("<article>a</b></i>b<unknown>c</unknown></article></article>d", "abc"),
        ("<article><p title=\"a > b\">x</p><section role=navigation>n</section></article>", "x"),
        ("<p>" * 3000 + "deep", "deep"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<" * 2000 + "p", "<" * 1999),
        ("one <span class=ad>buy</span>two<button>b</button> <svg><text>t</text></svg>three", "one two three"),
        ('<p title="x>one</p><p>two</p>', "one two"),
        ('<article><p title="no hidden fees">a</p><p data-x="role=form class=ad">b</p></article>', "a b"),
        ("<article>a<div class='comments-policy'>b</div><p class='social history'>c</p><p class='related-work'>d</p></article>", "a b c d"),
        ("<article>a<div class=comments>b</div><div class='ad-slot top'>c</div><section id=related-posts>d</section></article>", "a"),
        ("<article>a<h2 id=legal>Legal</h2><h2 id=comments-3>Comments</h2><p>b</article>", "a Legal Comments b"),
        ("<article>a<ul class='related-work'><li><a href=x>linked</a></li><li>not linked</li></ul></article>", "a not linked"),
        ("<div id=content>main</div><article>teaser</article>", "main teaser"),
        ("<div id=content>the main text of this page</div><article>teaser</article>", "the main text of this page"),
        ("<article>the main text of this page</article><article>teaser</article>", "the main text of this page"),
        ("<div><p>" + "long text " * 20 + "</p></div><article>teaser</article>", "long text " * 20 + "teaser"),
        ("<main><h1>Title</h1><article>body</article></main><div class=entry>other</div>", "Title body other"),
    ],
)
def test_pages_by_hand(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<div>a " * 160_000,
        "<a " * 330_000 + '"',
        "<div>" * 90_000 + "</span>" * 90_000,
        "<span><article>" + "<div>" * 90_000 + "</span>" * 90_000,
        "<b>" * 100_000 + "<h1></h1>" * 70_000,
        '<a "<a" ' * 120_000 + "'",
        '<a ">"' * 160_000 + "'",
        '<p class="' * 100_000,
        "<" * 1_000_000,
    ],
)
def test_any_page_of_a_megabyte_is_read_in_one_pass(page):
    start = time.process_time()
    blocks, _ = pages.read_page(page)
    assert time.process_time() - start < 15
    assert all(len(b.paths) <= pages.DEPTH for b in blocks)
    words = Counter(w for b in blocks for w in b.text.split())
    assert words["a"] == (160_000 if page.startswith("<div>a") else 0)


def test_articles_keep_what_repeats(spark):
    def page(i):
        return (
            f"<body><article><h2>Summary</h2><p>own words {i}</p><ul><li>Yes</li></ul><h2>Method</h2><p>more words {i * 7}</p>"
            "<div class=x9><a href=/a>All stories</a> <a href=/b>Our letter</a></div></article></body>"
        )

    rows = [(i, f"https://host.example/{i}", page(i)) for i in range(60)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Summary own words {i} Yes Method more words {i * 7}" for i in range(60)}


def test_style_tree_against_plain_python(spark):
    """Importance from probabilities of texts and looks on the distinct pages of each host."""
    def page(h, i):
        notice = "<div class=x1>same on all</div>" if i % 4 else f"<div class=x1>notice {i % 3}</div>"
        quote = f"<blockquote>said {i // 10}</blockquote>" if i % 5 == h else ""
        return f"<body>{notice}<article><h2>Head</h2><p>own {i}</p>{quote}<div class=x2><a>link {i % 2}</a></div></article><div class=x3><b>{h}</b></div></body>"

    rows = [(h * 100 + i, f"http://h{h}.example/{i}", page(h, i)) for h, n in enumerate((60, 25, 8, 7)) for i in range(n)]
    rows += [(900 + i, "http://h1.example/again", page(1, i)) for i in range(9)]
    distinct = defaultdict(dict)
    for _, url, source in rows:
        blocks, shapes = pages.read_page(source)
        distinct[url.split("/")[2]][tuple(b.text for b in blocks)] = blocks, shapes
    want = set()
    for host, found in distinct.items():
        texts, looks = defaultdict(Counter), defaultdict(Counter)
        for blocks, shapes in found.values():
            for path, text in {(p, b.text) for b in blocks for p in b.paths}:
                texts[path][text] += 1
            for path, shape in shapes:
                looks[path][shape] += 1
        for path, counts in texts.items():
            if len(found) < pages.MIN_PAGES or looks[path].total() < pages.MIN_PAGES:
                continue
            content = sum(n * (1 - math.log(n) / math.log(len(found))) for n in counts.values()) / counts.total()
            seen = looks[path].total()
            variety = -sum(n / seen * math.log(n / seen) for n in looks[path].values()) / math.log(max(seen, 2))
            importance = (1 - pages.PRESENTATION) * content + pages.PRESENTATION * variety
            if importance < pages.MIN_IMPORTANCE:
                want.add((host, path, importance < pages.ARTICLE_IMPORTANCE and seen >= pages.ARTICLE_PAGES))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = pages.noise_branches(frame.select(pages.host_of("url").alias("host"), "html")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10


def test_looks_differ_by_any_child():
    looks = lambda last: set(pages.read_page("<ul>" + "<li>x</li>" * 100 + f"<{last}>y</{last}></ul>")[1])
    assert looks("li") == looks("li") and len(looks("li") - looks("div")) == 1
    assert len(set(pages.read_page("<ul><li>x</li></ul><ul><li>x</li></ul><ul></ul>")[1])) == 3


def test_style_tree_finds_unnamed_noise(spark):
    def page(i):
        links = "".join(f"<span>link {k}</span>" for k in range(4))
        return f"<body><div class=x1>{links}</div><div class=x2><p>own words of page {i} and more {i * 7}</p><p>second {i}</p></div><div class=x3>Contact us any time</div></body>"

    rows = [(i, f"https://Host.example:80/{i}", page(i)) for i in range(40)] + [(99, "https://small.example/", page(99))]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5] == "own words of page 5 and more 35 second 5"
    assert "Contact us" in got[99], "one page is no evidence"


def test_copies_of_a_page_are_one_page(spark):
    rows = [(i, "http://mirror.example/a", "<article><p>the same article</p></article>") for i in range(50)]
    assert {r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"the same article"}


def test_copies_over_many_partitions_are_one_page(spark):
    """A page copied over the whole table has as much weight in its host's style tree as any other page."""
    def page(i):
        return f"<body><article><p>own words of page {i}</p><p>more {i}</p></article></body>"

    mirrored = "<body><article><p>start of it</p><blockquote>quoted once</blockquote></article><!-- {} --></body>"
    rows = [(i, f"http://host.example/{i}", page(i)) for i in range(99)]
    rows += [(1000 + i, f"http://host.example/m{i}", mirrored.format(i % 3)) for i in range(120)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(60, "page_id")
    got = {r.page_id: r.text for r in pages.extract(frame).collect()}
    assert {got[1000 + i] for i in range(120)} == {"start of it quoted once"}
    chosen, sizes = pages._distinct_pages(frame.select(pages.host_of("url").alias("host"), "html"))
    assert [tuple(r) for r in sizes.collect()] == [("host.example", 100)]
    assert sorted(r.copies for r in chosen.collect()) == [1] * 99 + [40] * 40


def test_edges(spark):
    rows = [(1, None, None), (None, "", "<p>x"), (2, "http://h/", ""), (2, "http://h/", ""), (3, "nonsense", "<p>" + "é" * 100_000)]
    got = pages.extract(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS host", "1 AS noise")).collect()
    assert sorted((r.page_id or 0, r.url or "", len(r.text), r.n_chars) for r in got) == [(0, "", 1, 1), (1, "", 0, 0), (2, "http://h/", 0, 0), (2, "http://h/", 0, 0), (3, "nonsense", 100_000, 100_000)]
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_table(spark):
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = QUERIES["op9_html_extraction"](spark, FOLDER).collect()
    assert len(got) == len(sources)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", sources[r.page_id], re.S)[1]
        plain = html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article)))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)
