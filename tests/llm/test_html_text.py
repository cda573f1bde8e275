import html
import re
import time
import tracemalloc

import pytest

from tidemark.llm.common import read
from tidemark.llm.html_text import blocks, extract, main_text, path_scores

PROSE = "Running text of some length, with marks in it. It goes on; and on, as text does."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p", ""),
        ("plain &amp; simple", "plain & simple"),
        ("a < b", "a < b"),
        ("<article><h1>T</h1><p>a&amp;b &lt;x&gt; &nbsp; c<p>un<b>bro</b>ken<br>line</article><p>after", "T a&b <x> c unbroken line"),
        ("<article><p>one<script>var t='</p>';</script><style>p{}</style> two<!-- no --> three</article>", "one two three"),
        ("<article><p>one<div class=ad>no</div><p>two<section id='comments'><p>no</section></article>", "one two"),
        ("<article><header><h1>Title</h1></header><p>Body.</p><footer>no</footer></article>", "Title Body."),
        ("<article>a<!-- unclosed <p>b", "a"),
        ("<article>cut off &am", "cut off &am"),
        ("<article><p title=it's>x</p><p title=\"a>b\">y</p></article>", "x y"),
        ("<ARTICLE><P>big</P></ARTICLE>", "big"),
        ("<main><p>outer</p><article>inner</article></main>", "inner"),
        ("<article class=comment>no</article><article>yes</article>", "yes"),
        ("<nav><ul><li>menu</ul></nav>", ""),
        ("<article></p></b></div>x</article>", "x"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    "other",
    [
        "<nav>menu</nav>", "<header>top</header>", "<footer>foot</footer>", "<aside>side</aside>", "<div class='cookie-notice'>We use cookies.</div>",
        "<div id=sidebar>side</div>", "<div class=adverts>Buy!</div>", "<form><p>name</p></form>", "<div role=navigation>menu</div>",
        "<ul class=comments><li>first!</ul>", "<div hidden>x</div>", "<div style='display: none'>x</div>", "<ul><li><a href=a>one</a><li><a href=b>two</a></ul>",
    ],
)
@pytest.mark.parametrize("wrap", ["<div><p>{0}</p><p>{0}</p></div>", "<article><p>{0}</p><p>{0}</p></article>", "<main><p>{0}</p><p>{0}</p></main>"])
def test_what_is_not_the_article(other, wrap):
    body = wrap.format(PROSE)
    assert main_text(f"<html><body>{other}{body}{other}</body></html>") == f"{PROSE} {PROSE}"


@pytest.mark.parametrize(
    "open_tag", ["<div class='content with-sidebar'>", "<div class='layout no-sidebar'>", "<form id=aspnetForm>", "<div class=widget>", "<div id=comments-on>"]
)
@pytest.mark.parametrize("wrap", ["<article><p>{0}</p><p>{0}</p></article>", "<main><p>{0}</p><p>{0}</p></main>"])
def test_a_name_does_not_ban_what_encloses_the_article(open_tag, wrap):
    other = "<div class=sidebar>side</div><div class=cookie-notice>We use cookies.</div><section id=comments><article>first!</article></section>"
    tag = open_tag[1:].split()[0]
    other = other if wrap.startswith("<article") else other.replace("article", "p")
    assert main_text(f"<body>{open_tag}{other}{wrap.format(PROSE)}{other}</{tag}>{other}</body>") == f"{PROSE} {PROSE}"


@pytest.mark.parametrize("wrap", ["<body>{}</body>", "<article>{}</article>", "<main>{}</main>"])
@pytest.mark.parametrize("open_tag", ["<div class='elementor-widget elementor-widget-text-editor'>", "<div class=layout-no-sidebar>", "<form>"])
def test_a_part_of_a_name_does_not_ban_most_of_the_text(open_tag, wrap):
    tag = open_tag[1:].split()[0].rstrip(">")
    page = f"<div class=site-footer>foot</div>{open_tag}<p>{PROSE}</p><p>{PROSE}</p></{tag}><div class=text-widget>more</div>"
    assert main_text(wrap.format(page)) == f"{PROSE} {PROSE}"


@pytest.mark.parametrize("name", ["comments", "comments-area", "related", "related-posts"])
def test_articles_of_others_stay_banned(name):
    other = f"<section class={name}><article><p>first!</p></article></section>"
    assert main_text(f"<main><p>{PROSE}</p>{other}</main>") == PROSE
    assert main_text(f"{other}<div class=with-sidebar><main><p>{PROSE}</p></main></div>") == PROSE


def test_a_lifted_name_does_not_cut_words():
    assert main_text(f"<article><p>un<span class='text-widget'>bro{PROSE}</span>ken</article>") == f"unbro{PROSE}ken"


def test_paths_of_running_text_score_higher():
    page = f"<div><p>{PROSE}</p><p>{PROSE}</p></div><ul><li><a href=a>short</a></li><li><a href=b>link</a></li></ul>"
    found = blocks(page)
    scores = path_scores(found)
    one, other = found[0].path, found[2].path
    assert [b.path for b in found] == [one, one, other, other] and one != other
    assert scores[0] == scores[1] > 10 * scores[2]


def test_whole_table(spark):
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    rows = extract(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        article = re.search("<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        plain = re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)
        assert r["text"] == " ".join(html.unescape(plain).split())


def test_odd_rows(spark, odd, nothing):
    rows = extract(odd, "text").collect()
    assert len(rows) == odd.count() and rows[0]["_text"] == "_z"
    assert extract(nothing, "text").collect() == []


def test_very_long_page():
    assert len(main_text("<article>" + "<p>word, and word.</p>" * 50000)) == 50000 * 16 - 1


@pytest.mark.parametrize("tag", ["<div>", "<div class=menu>", "<div class=content-menu>", "<a href=x>", "<b class=share>", "<p></x><article>", "<form>"])
def test_deep_pages_take_time_and_memory_in_proportion(tag):
    """20,000 tags that are never closed, with text in each."""
    tracemalloc.start()
    began = time.monotonic()
    found = blocks((tag + "word in it, ") * 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and time.monotonic() - began < 30
    assert sum(b.text.count("word") for b in found) == 20_000
    assert isinstance(main_text((tag + "word in it, ") * 20_000), str)
