import html as escapes
import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import html_extract
from eventloom.llm.html_extract import extract_text, main_text

HEAD = '<!DOCTYPE html><html><head><title>Site, title.</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>'
LONG = "A long paragraph, with words enough, and marks; it goes on. " * 4


def page(article, before="", after=""):
    return f"{HEAD}{before}<article>{article}</article>{after}</body></html>"


BEFORE = """<header class="site-header"><p>Site name, slogan.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do.</p></div><!-- ad <p>x</p> -->
<div class="ad">Buy this, buy that, now.</div>"""
AFTER = """<aside class="sidebar"><p>Other texts, here.</p></aside>
<section id="comments"><p>First comment, which is long. It has many words, and marks.</p></section>
<form><p>Your comment, please.</p><textarea>x</textarea></form><footer>&copy; site &middot; x.</footer>"""


def test_template_parts_are_left_out():
    article = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><ul><li>item</li></ul>"
    want = "\n".join(["Title", LONG.strip(), "Short.", "item"])
    assert main_text(page(article, BEFORE, AFTER)) == want


def test_parts_inside_the_article():
    article = f"""<header><h1>Title</h1></header><p>{LONG}</p><div class="advert">Buy.</div>
<aside>Aside.</aside><div class="comments"><p>{LONG}</p></div><p>End</p><footer>Tags</footer>"""
    assert main_text(page(article)) == "\n".join(["Title", LONG.strip(), "End"])


def test_without_an_article_element():
    body = f"""<div id="top"><div class="menu"><p>Home</p></div></div>
<div class="content"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>Short</p></div><div class="footer">x</div>"""
    want = "\n".join(["Title", LONG.strip(), LONG.strip(), "Short"])
    assert main_text(HEAD + body) == want


def test_missing_end_tags_and_inline_elements():
    article = "<h1>T &amp; t<p><b>One<br>two <i>th</i>ree &lt;x&gt;.<p>Next&nbsp;\n line &#233;.<br><p>Last"
    assert main_text(HEAD + "<article>" + article) == "T & t\nOne two three <x>.\nNext line é.\nLast"


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("<p></p>", ""),
        ("plain text", "plain text"),
        ("a < b and c", "a < b and c"),
        ("<p>cut <a href=", "cut"),
        ("<p>x</p><!-- open", "x"),
        ("<script>no", ""),
        ('<p title="a>b">x</p>', "x"),
        ("<p a=\"un>x</p>", "x"),
        ("</div></p>x", "x"),
        ("<P>UP</P>", "UP"),
    ],
)
def test_odd_pages(html, want):
    assert main_text(html) == want


def test_very_long_page_and_deep_nesting():
    assert main_text("<p>" + "x" * 1_000_000 + "</p>") == "x" * 1_000_000
    assert main_text("<div>" * 300 + "deep" + "</div>" * 300) == "deep"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .,<>&\"'é \n", min_size=1, max_size=40), max_size=8))
def test_paragraphs_come_back(paragraphs):
    body = "".join(f"<p>{escapes.escape(p)}</p>" for p in paragraphs)
    want = "\n".join(t for t in (" ".join(p.split()) for p in paragraphs) if t)
    assert main_text(page(body, BEFORE, AFTER)) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/=\"'!-&; apdivlscrt", max_size=120))
def test_any_markup_is_read(text):
    assert isinstance(main_text(text), str)


def test_rows(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, "u", "<p>é x</p>", 1, "a"), (1, "u", "<p>é x</p>", 1, "a"), (None, None, None, 2, None)]
    got = extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "u", "é x", 3), (1, "u", "é x", 3), (None, None, "", 0)]
    assert extract_text(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("tag", ["div class='overflow-hidden'", "div style='overflow:hidden'", "div data-hidden='x' title='a hidden b'"])
def test_only_hidden_parts_are_hidden(tag):
    name = tag.split()[0]
    assert main_text(f"{HEAD}<{tag}><article><p>{LONG}</p></article></{name}>") == LONG.strip()


@pytest.mark.parametrize("tag", ["body class='overflow-hidden'", "article hidden", "main style='display:none'"])
def test_the_page_and_the_article_are_never_hidden(tag):
    assert main_text(f"<html><{tag}><p>{LONG}</p>") == LONG.strip()


@pytest.mark.parametrize("mark", ["hidden", "hidden=''", "aria-hidden=true", "style='color:red; display : none'", "style='VISIBILITY:hidden!important'"])
def test_hidden_parts_are_left_out(mark):
    assert main_text(page(f"<p>{LONG}</p><div {mark}><p>Unseen, {LONG}</p></div>")) == LONG.strip()


@pytest.mark.parametrize("tag", ["div class='layout-sidebar'", "form action=x", "div id='page-modal'"])
def test_paths_overrule_the_name_of_a_wrapper(tag):
    name = tag.split()[0]
    want = f"Title\n{LONG.strip()}\n{LONG.strip()}"
    text = f"<h1>Title</h1><p>{LONG}</p><div class='sidebar'><p>Other texts, here.</p></div><p>{LONG}</p>"
    assert main_text(f"{HEAD}<{tag}>{text}</{name}><div class='footer'>x</div>") == want
    assert main_text(f"{HEAD}<{tag}><article>{text}</article></{name}>") == want


def test_paths_overrule_the_name_of_many_parts():
    part = f"<div class='elementor-widget-container'><p>{LONG}</p></div>"
    assert main_text(f"{HEAD}<div class='post'>{part * 3}</div>") == "\n".join([LONG.strip()] * 3)


def test_names_count_beside_an_article():
    after = f"<section id='comments'>{f'<p>{LONG}</p>' * 9}</section>"
    assert main_text(page(f"<p>{LONG}</p>", after=after)) == LONG.strip()


@pytest.mark.parametrize("middle", ["section", "blockquote", "article"])
def test_content_around_the_largest_part_stays(middle):
    parts = [f"<p>{LONG}</p>", f"<{middle}>{f'<p>{LONG}</p>' * 9}</{middle}>", f"<p>{LONG}</p>"]
    assert main_text(f"{HEAD}<div class=content>{''.join(parts)}</div>") == "\n".join([LONG.strip()] * 11)


def test_all_of_several_articles():
    short, long = f"<article><p>{LONG}</p></article>", f"<article>{f'<p>{LONG}</p>' * 9}</article>"
    body = f"<div class='list'>{short}{long}{short}</div>"
    assert main_text(HEAD + body) == "\n".join([LONG.strip()] * 11)


def test_short_blocks_between_content():
    items, want = "<ul>" + "<li>x</li>" * 7 + "</ul>", [LONG.strip(), *["x"] * 7]
    body = f"<div class=content><p>{LONG}</p>{items}<section>{f'<p>{LONG}</p>' * 9}</section></div>"
    assert main_text(HEAD + body) == "\n".join(want + [LONG.strip()] * 9)
    parts = f"<div><p>{LONG}</p></div>{items}<div><p>{LONG}</p></div>"
    assert main_text(HEAD + parts) == "\n".join([LONG.strip()] * 2)


DEEP = 100_000


@pytest.mark.parametrize(
    "html,first",
    [
        ("<div>a b. " * DEEP, "a b."),
        ("<div>" * DEEP + "</span2>x" * DEEP, "x"),
        ("<div>" * DEEP + "<li>y" * DEEP, "y"),
        ("<article>" + "<div>" * DEEP + "</section>z" * DEEP, "z"),
        ("<td>" * DEEP + "t", "t"),
        (f"<p>{LONG}" + "<div class=sidebar>" * DEEP + "t", LONG.strip()),
        (f"<div><p>{LONG}</p><ul><li>x</li></ul>" * (DEEP // 10), LONG.strip()),
    ],
)
def test_time_grows_with_the_page(html, first):
    began = time.process_time()
    assert main_text(html).split("\n")[0] == first
    assert time.process_time() - began < 20


def test_many_words_in_many_rows():
    cells = "".join(f"<tr><td>{i}, one.<td>two" for i in range(30_000))
    assert main_text(f"{HEAD}<article><table>{cells}</table></article>").count("\n") == 59_999


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.text(alphabet="ab .,;!?", min_size=1, max_size=60)), max_size=20))
def test_path_scores_by_brute_force(blocks):
    def ratio(path):
        own = [t for p, t in blocks if p == path]
        marks = sum(c in ".,;:!?" for t in own for c in t)
        return math.log1p(sum(map(len, own)) / len(own)) * (1 + math.log1p(marks / len(own)))

    smooth = []
    for i in range(len(blocks)):
        near = [(w, blocks[j][0]) for j in range(len(blocks)) for far, w in enumerate((1, 0.5, 0.25)) if abs(i - j) == far]
        smooth.append(sum(w * ratio(p) for w, p in near) / sum(w for w, _ in near))
    want = {q: [s for s, (p, _) in zip(smooth, blocks) if p == q] for q, _ in blocks}
    got = html_extract.path_scores(blocks)
    assert got == pytest.approx({p: sum(s) / len(s) for p, s in want.items()})


def test_ratios_choose_where_names_say_nothing(monkeypatch):
    """Menus of a page without telling names; without ratios they come along."""
    links = "<div class=a>" + "<span>One</span>" * 3 + "</div><div class=b><ul>" + "<li>Two</li>" * 8 + "</ul></div>"
    body = f"<div class=c><div class=d>{f'<p>{LONG}</p>' * 5}</div></div>"
    html = f"{HEAD}{links}{body}</body>"
    want = "\n".join([LONG.strip()] * 5)
    assert main_text(html) == want
    monkeypatch.setattr(html_extract, "path_scores", lambda blocks: {p: 1.0 for p, _ in blocks})
    assert len(main_text(html)) > len(want) + 20
