"""Main text of pages with and without semantic elements."""

import time

import numpy as np
import pytest

from corvane.llm.html_text import content_lines, extract_text, main_text

LONG = "This is a paragraph of the article that is long enough to be told from a menu, isn't it."

PAGES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>Home</a></nav>"
                f"<div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p><b>{LONG}<br><p>Of.</p>"
                f"<script>var t='</p>'</script></article><footer>&copy; me</footer></body></html>",
                f"Head & more\n{LONG}\nOf."),
    "divs": (f"<body><div id='menu'><ul><li><a>A</a><li><a>B</a></ul></div><div class=post><h2>T</h2>"
             f"<p>{LONG}</p><p>{LONG} &eacute;</p></div><div class='comments'><p>{LONG}</p></div>"
             f"<div class='cookie-notice'>We use cookies</div><form><p>mail</p></form></body>",
             f"T\n{LONG}\n{LONG} é"),
    "main": (f"<main><header><nav>x</nav><h1>Title</h1></header><p>{LONG}<p>Two\n  lines\t here"
             f"<section id='comments'><p>bad</p></section></main><aside>side</aside>",
             f"Title\n{LONG}\nTwo lines here"),
    "cut": (f"<article><p>{LONG}</p><p>AT&am", f"{LONG}\nAT&am"),
    "plain": ("no markup &lt; at all", "no markup < at all"),
    "list": (f"<article><ul><li>{LONG}</li><li>two</li></ul><table><tr><td>a<td>b</table></article>",
             f"{LONG}\ntwo\na\nb"),
    "comment": (f"<article><p>{LONG}</p><article class='comment'><p>{LONG}</p></article></article>", LONG),
    "none": ("<html><body><nav>menu</nav></body></html>", ""), "empty": ("", ""), "null": (None, ""),
    "stray": (f"</div></p><article></section><p>{LONG}</p></article>", LONG),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert main_text(PAGES[name][0]) == PAGES[name][1]


def test_long_page_is_kept_whole():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(3000))
    assert main_text(f"<article>{body}</article>").count("\n") == 2999


STORY = "".join(f"<p>{LONG} {i}</p>" for i in range(4))
TOLD = "\n".join(f"{LONG} {i}" for i in range(4))


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><body>{STORY}</body></html>",
    f"<html><head><title>T</title><p hidden>x</p>{STORY}",
    f"<html><head><title>T</title>{STORY}</html>",
    f"<body><div class='has-sidebar'><article>{STORY}</article></div></body>",
    f"<body><div class='no-sidebar'>{STORY}</div></body>",
    f"<body><div class='page with-menu'><div class='sidebar'><p>{LONG}</p></div><main>{STORY}</main></div>",
    f"<body><div class='navigation'><ul class='menu'><li>a</ul><article>{STORY}</article></div></body>",
    f"<body><form action=x><nav>menu</nav><div>{STORY}</div></form></body>",
    f"<main><article class='post no-comments'>{STORY}</article></main>",
])
def test_marks_around_the_page_do_not_empty_it(page):
    assert main_text(page) == TOLD


@pytest.mark.parametrize("name", ["comments", "comment-list", "cookie consent", "sidebar"])
def test_long_marked_text_beside_an_article_stays_out(name):
    assert main_text(f"<article><p>{LONG}</p></article><div class='{name}'>{STORY}</div>") == LONG


@pytest.mark.parametrize("name", [
    "user-comments", "article-comments", "story__comments", "reader-comments", "fb-comments", "commentsList",
    "comment-thread", "article-sidebar", "left-sidebar", "sidebar-left", "cookieBanner", "google-ads",
    "related-posts", "site-notice", "x y-comments z"])
def test_marked_parts_inside_an_article_stay_out(name):
    page = f"<article>{STORY}<div class='{name}'><p>{LONG} no</p><p>{LONG} no</p></div><p>{LONG} end</p></article>"
    assert main_text(page) == f"{TOLD}\n{LONG} end"


@pytest.mark.parametrize("name", [
    "has-sidebar", "comments-open", "no-related-posts", "with-ads", "ad-free", "hasComments", "story-body",
    "commentary", "download", "adsorption", "noticeable", "-", "12"])
def test_other_names_inside_an_article_stay(name):
    assert main_text(f"<article class='{name}'><div class='{name}'>{STORY}</div></article>") == TOLD


def told(first, last):
    return "\n".join(f"{LONG} {i}" for i in range(first, last))


MENU = "<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul>"


def story(first, last):
    return "".join(f"<p>{LONG} {i}</p>" for i in range(first, last))


@pytest.mark.parametrize("page, want", [
    (f"<body><article>{story(0, 6)}</article><article>{story(6, 10)}</article></body>", told(0, 10)),
    (f"<body><main><div>{story(0, 6)}</div></main><article><p>{LONG} 6</p></article></body>", told(0, 6)),
    (f"<body><nav>{MENU}</nav><div>{story(0, 6)}</div><article>{story(6, 8)}</article></body>", told(0, 8)),
    (f"<body><div>{MENU}</div><div>{story(0, 7)}</div><div class='ad'>buy</div><div>{story(7, 10)}</div>"
     f"<div>{MENU}</div></body>", told(0, 10)),
    (f"<body><div><div>{story(0, 6)}</div><div>{story(6, 10)}</div></div><div><a>x</a></div></body>",
     told(0, 10)),
    (f"<body><div>{story(0, 4)}</div><h2>Two</h2><div>{story(4, 7)}</div><div>{story(7, 10)}</div></body>",
     f"{told(0, 4)}\nTwo\n{told(4, 10)}"),
])
def test_all_parts_with_content_lines_stay(page, want):
    assert main_text(page) == want


def test_lines_split_by_ratio():
    ratios = np.array([2, 3, 2, 80, 90, 75, 85, 2, 1], float)
    assert content_lines(ratios, 0.5).tolist() == [False] * 3 + [True] * 4 + [False] * 2
    assert content_lines(np.zeros(0)).tolist() == []


def test_extract(spark):
    rows = [(i, f"u{n}", h, "x") for i, (n, (h, _)) in enumerate(PAGES.items())]
    pages = spark.createDataFrame([*rows, rows[0], (None, None, None, None)],
                                  "page_id long, url string, html string, n_chars string")
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) + 2
    want = [t for _, t in PAGES.values()]
    for r in found:
        text = "" if r["page_id"] is None else want[r["page_id"]]
        assert (r["text"], r["n_chars"]) == (text, len(text))
    assert extract_text(pages.limit(0)).count() == 0


def test_deep_pages_take_time_in_proportion():
    def seconds(n, part):
        page, begin = part * n, time.process_time()
        text = main_text(page)
        return time.process_time() - begin, text

    for part in ("<div>some words of text ", "<section><article>words in it</b>", "<td><a>one cell of it"):
        seconds(200, part)
        (short, few), (long, many) = seconds(2_000, part), seconds(16_000, part)
        assert long < 16 * short + 0.3
        assert few and len(many) >= 7 * len(few)
