import html
import re
import time
from html.parser import HTMLParser

from treelake.llm import html_text

ARTICLE = "<p>First paragraph &amp; more,\n  spaced   out.</p><p>Short.</p><p>Third <b>bold</b> one&nbsp;here.</p>"
TEXT = "First paragraph & more, spaced out.\n\nShort.\n\nThird bold one here."
NOISE = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul>'


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_marked_article():
    body = f"<nav>{NOISE}</nav><div class='ad'>Buy this now please.</div><article>{ARTICLE}</article><footer>&copy; someone</footer>"
    assert html_text.main_text(page(body)) == TEXT
    assert html_text.main_text(page(body)[:-40]) == TEXT


def test_article_without_a_mark():
    body = (f"<div id='menu'>{NOISE}</div><header>Site name</header><div class='content'>{ARTICLE}</div><div class='sidebar'>Other posts</div>"
            "<form>Name <input></form><div id='comments'><p>Great article, thank you so much!</p></div><div class='cookie-notice'>We use cookies.</div>")
    assert html_text.main_text(page(body)) == TEXT
    assert html_text.main_text(page(f"{NOISE}<p>One real paragraph of text that is long enough to count.</p>{NOISE}")
                               ) == "One real paragraph of text that is long enough to count."


def test_parts_inside_an_article_that_do_not_belong():
    body = f"<article><p>First paragraph &amp; more, spaced out.</p><aside>Related things</aside><p>Short.</p><div class='advert'>Ad</div><p>Third <b>bold</b> one here.</p><section class='comments'><p>First!</p></section></article>"
    assert html_text.main_text(page(body)) == TEXT


def test_nothing_is_lost_inside_the_article():
    marked = "<article><p>First paragraph &amp; more, spaced out.</p><div class='promotion-history'><p>A chapter on promotions.</p></div><div class='promo-banner'>Buy</div></article>"
    assert html_text.main_text(page(marked)) == "First paragraph & more, spaced out.\n\nA chapter on promotions."
    long = "<p>A long first paragraph of an article that has no mark of its own at all.</p><p>And a second one that is as long as the first one is.</p>"
    plain = f"<nav>{NOISE}</nav><div class='content'><div>{long}</div><div><p>Short end.</p></div></div><div class='x'>Elsewhere</div><footer>End</footer>"
    assert html_text.main_text(page(plain)).endswith("first one is.\n\nShort end.")


def test_odd_input():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain text only") == "plain text only"
    assert html_text.main_text("<p>a < b and c</p><p>&lt;tag&gt; &#233; &#x1F600; &am</p>") == "a < b and c\n\n<tag> é 😀 &am"
    assert html_text.main_text("<p>one<p>two<br>three<!-- x --><script>bad") == "one\n\ntwo three"
    assert html_text.main_text("<p don't title='a>b' data-x=\"c>d\">It's <a href=x'y>here</a> now</p>") == "It's here now"
    assert html_text.main_text("<p title='hidden gems' data-hidden=1>Kept.</p><p hidden>Not.</p><p aria-hidden='true'>Nor.</p>") == "Kept."
    assert "x" * 100_000 in html_text.main_text("<div>" * 500 + "x" * 100_000)


class Article(HTMLParser):
    """The blocks of a page's ``article``, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.close()
        self.text = "\n\n".join(t for t in (" ".join(b.split()) for b in self.blocks) if t)

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def neutral(page, *tags):
    for t in tags:
        page = re.sub(rf"(</?){t}\b", r"\1div", page)
    return page.replace('class="ad"', 'class="x1"')


def test_all_given_pages_against_the_standard_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    texts = [Article(p).text for p in pages]
    assert [html_text.main_text(p) for p in pages] == texts
    # Without any mark of the article, the sums alone find it; without marks of what surrounds it, nearly always.
    assert [html_text.main_text(neutral(p, "article", "main")) for p in pages] == texts
    found = [html_text.main_text(neutral(p, "article", "main", "nav", "footer")) for p in pages]
    assert sum(a == b for a, b in zip(found, texts)) >= 0.98 * len(pages)


def test_class_words_on_what_holds_the_text():
    for kind in ("class='side-by-side'", "id='search'", "class='article-with-sidebar'"):
        assert html_text.main_text(page(f"<article><div {kind}>{ARTICLE}</div></article>")) == TEXT
    assert html_text.main_text(page(f"<article><div class='side-by-side'><p>Left and right.</p></div>{ARTICLE}</article>")) == "Left and right.\n\n" + TEXT
    linked = "<p><a href='/x'>A paragraph of the article that is one link.</a></p>"
    assert html_text.main_text(page(f"<article>{ARTICLE}{linked}</article>")) == TEXT + "\n\nA paragraph of the article that is one link."
    assert html_text.main_text(page(f"<div>{NOISE}</div><div>{ARTICLE}{linked}</div>")) == TEXT + "\n\nA paragraph of the article that is one link."


def test_surge_and_dive():
    long = "<p>" + "A sentence of some length in the body of the text. " * 6 + "</p>"
    text = html.unescape(re.sub("<.?p>", "", long)).strip()
    got = html_text.main_text(page(f"<div>Buy this now.</div><div><div>{long}</div><div><p>Short.</p></div><div>{long}</div></div><div>Thanks, great read!</div>"))
    assert got == "\n\n".join([text, "Short.", text])


def test_odd_markup_takes_linear_time():
    for odd in ("<div>" * 90_000 + "</i>" * 90_000, "<script " * 120_000, "<!" * 400_000, "<b>" * 100_000 + "</div>" * 100_000, "<a href=\"" * 90_000):
        start = time.time()
        html_text.main_text(odd)
        assert time.time() - start < 5


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", page(ARTICLE), "z"), (1, "u", page(ARTICLE), "z"), (None, None, None, None)],
                                  "page_id long, url string, html string, text string")
    got = html_text.extract(pages).toPandas().sort_values("page_id")
    assert got["text"].tolist() == [TEXT, TEXT, ""] and got["n_chars"].tolist() == [len(TEXT), len(TEXT), 0]
    assert html_text.extract(pages.limit(0)).count() == 0
