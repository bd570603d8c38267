"""Extraction: articles, boilerplate, damaged markup, plain pages."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataspark.llm.extraction import extract, main_text

P = "A sentence of some length, with commas, that an article has; more of it follows here."
WRAP = (
    "<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header>"
    "<nav><ul><li><a href=/x>Menu one</a></li></ul></nav><div class='sidebar widget'><p>" + P + "</p></div><!-- <p>" + P + "</p> -->{}"
    "<form><p>" + P + "</p></form><section id='comments'><p>" + P + "</p></section><div class=\"cookie-notice\">" + P + "</div>"
    "<aside>" + P + "</aside><footer>&copy; x</footer></body></html>"
)


@pytest.mark.parametrize("holder", ["article", "main", "div class='content'", "div id=post-body"])
def test_page_around_an_article(holder):
    body = f"<h1>Title &amp; more</h1><p>{P}\n  <b>bold&nbsp;{P}<br>next</b><p>Second &#233; {P}<ul><li>item one<li>item two</ul><p>{P}"
    page = WRAP.format(f"<{holder}>{body}</{holder.split()[0]}>")
    assert main_text(page).split("\n") == ["Title & more", f"{P} bold {P} next", f"Second é {P}", "item one", "item two", P]


def test_boilerplate_within_the_article_goes():
    page = f"<article><p>{P}</p><div class='share-links'>Share</div><p>x</p><div class=ad><p>{P}</p></div><figure><figcaption>Cap</figcaption></figure></article>"
    assert main_text(page).split("\n") == [P, "x", "Cap"]


def test_damaged_and_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x") == ""
    assert main_text("just text") == "just text"
    assert main_text("<p>a < b &amp; c<p>d <i>e") == "a < b & c\nd e"
    assert main_text(f"<p>{P}</p><p title=\"x>y\">{P}</p><p title=\"un{P}") == f"{P}\n{P}"
    deep = "<div>" * 2000 + P + "</div>" * 2000
    assert main_text(deep) == P
    assert main_text(f"<article><p>{P}" * 3) == "\n".join([P] * 3)


def test_tables_and_lists_of_definitions():
    page = "<main><table><tr><th>k<th>v<tr><td>a<td>b</table><dl><dt>t<dd>u</dl><pre>x\n y</pre></main>"
    assert main_text(page).split("\n") == ["k", "v", "a", "b", "t", "u", "x y"]


@given(st.text(alphabet="<>/pabi =\"'&;!-", max_size=60))
def test_never_raises_and_has_no_empty_lines(page):
    out = main_text(page)
    assert out == "" or all(line.strip() == line and line for line in out.split("\n"))


def test_rows(spark):
    long = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<p>h\U0001F600i</p>"), (1, "u", "<p>h\U0001F600i</p>"), (None, None, None), (3, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("z")})
    out = extract(pages).collect()
    assert [(r["page_id"], r["n_chars"]) for r in out] == [(1, 3), (1, 3), (None, 0), (3, 20_000 * (len(P) + 1) - 1)]
    assert extract(pages.limit(0)).count() == 0


ARTICLE = f"<h1>Title</h1><p>{P}</p><p class=legal>{P}</p><ul><li>one item</li></ul><p>{P}</p>"
WANTED = f"Title\n{P}\n{P}\none item\n{P}"
WRAPPERS = [
    "div class='content has-sidebar'", "div class='container no-sidebar'", "div class='main-content share-enabled'", "div class=page-header-offset",
    "div class=content-with-sidebar", "div id=page-header-wrap", "form id=aspnetForm method=post", "div class='search-layout'", "div class='sidebar-form'",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_names_of_wrappers_lose_nothing(wrapper):
    tag = wrapper.split()[0]
    assert main_text(f"<body><nav>menu</nav><{wrapper}><article>{ARTICLE}</article></{tag}><footer>f</footer></body>") == WANTED
    assert main_text(f"<body><nav>menu</nav><{wrapper}><article>{ARTICLE}</article><div class=sidebar><p>{P}</p></div></{tag}></body>") == WANTED


def test_long_comments_and_lone_boilerplate_stay_out():
    page = f"<body><article><h1>Title</h1><p>{P}</p></article><section id=comments>" + f"<p>{P}</p>" * 40 + "</section></body>"
    assert main_text(page) == f"Title\n{P}"
    assert main_text(page.replace("article>", "div>")) == f"Title\n{P}"
    for alone in (f"<div class=ad>{P}</div>", f"<div class=footer>{P}</div>", f"<form><p>{P}</p></form>", f"<div class=cookie-notice><p>{P}</p></div>"):
        assert main_text(f"<body><nav>x</nav>{alone}</body>") == ""


def test_embedded_elements_without_end_lose_no_text():
    for odd in ("<svg/>", "<math />", "<object data=x>", "<svg><g/></svg>", "<svg><svg><text>no</text></svg><text>no</text></svg>", "<video src=x>"):
        assert main_text(f"<article><p>{P}</p>{odd}<p>{P}</p></article>") == f"{P}\n{P}"
    assert main_text("<svg>" * 20_000 + f"<p>{P}</p>") == P


def test_generated_pages_give_their_article_back():
    """Against the text that each page is made of, inline markup and references resolved."""
    import html
    import random

    rng = random.Random(12)
    inline = ["<b>{}</b>", "<a href='/x?a=1&amp;b=2'>{}</a>", "<em>{}</em>", "{}<br>", "<span class=x>{}</span>", "{}"]
    junk = ["<nav><ul><li><a href=/a>Menu {}</a></ul></nav>", "<div class='ad'>{}</div>", "<aside><p>{}</p></aside>", "<footer>{}</footer>",
            "<script>var a='<p>{}</p>'</script>", "<style>p{{}} /* {} */</style>", "<div id=comments><p>{}</p></div>", "<form><input><p>{}</p></form>", "<!-- {} -->"]

    def sentence():
        words = ["".join(rng.choice("abcdeéü<&\"") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(12, 40))]
        return " ".join(words) + ", and more."

    def marked(text):
        """Markup of a text, and the text that it shows."""
        parts, shown = [], []
        for word in text.split(" "):
            form = rng.choice(inline)
            parts.append(form.format(html.escape(word) if rng.random() < 0.8 else "".join(f"&#{ord(c)};" for c in word)))
            shown.append(word)
        return rng.choice([" ", "\n  ", "\t"]).join(parts), " ".join(shown)

    for _ in range(150):
        body, wanted = "", []
        for _ in range(rng.randint(2, 7)):
            markup, shown = marked(sentence())
            body += f"<p>{markup}</p>" if rng.random() < 0.7 else f"<p>{markup}"
            wanted.append(shown)
            if rng.random() < 0.2:
                body += "</p>" + rng.choice(junk[4:6]).format("no") + rng.choice(junk[1:3]).format(sentence().replace("<", "").replace("&", ""))
        around = [rng.choice(junk).format(sentence().replace("<", "").replace("&", "")) for _ in range(4)]
        holder = rng.choice(["article", "main", "div class=content"])
        page = f"<html><body>{around[0]}{around[1]}<{holder}>{body}</{holder.split()[0]}>{around[2]}{around[3]}</body></html>"
        assert main_text(page).split("\n") == wanted, page
