import html
import random
import re
import time

import pytest

from inkweave.llm import html_text as ht

P1, P2 = "The first paragraph, with commas, says quite a lot about things.", "The second one goes on: it has more to say, and it says it."
ARTICLE = f"<h1>A title</h1><p>{P1}</p><p>Short.</p><p>{P2} &amp; <a href='/x'>a link</a>,\n  and\t<b>more</b>.</p>"
TEXT = f"A title\n{P1}\nShort.\n{P2} & a link, and more."
NOISE = "<nav><ul><li><a href='/'>Home, sweet home</a></li></ul></nav>", "<footer><p>Imprint, terms, and so on and on, at length, with commas.</p></footer>"
PAGES = [
    f"<html><head><title>T</title><style>p{{x:y}}</style><script>var a='</p>'; if (a<b) c()</script></head><body>{NOISE[0]}<article>{ARTICLE}</article>{NOISE[1]}</body></html>",
    f"<body><header><h2>Site, the</h2></header>{NOISE[0]}<div id=content>{ARTICLE}</div><aside>See also, this, that, and the other, for more.</aside>{NOISE[1]}",
    f"<main><div class='post'>{ARTICLE}</div><section class='comments'><p>Nice one, I say, really, very nice, and so on, I mean it, truly.</p></section></main>",
    f"<article>{ARTICLE}<div class='share-buttons'>Share, like, follow</div><form><p>Name, mail, text</p></form></article><article class='comment'><p>{P1 * 3}</p></article>",
    f"<div class='cookie-notice'>We use cookies, as all do, sadly, and so on.</div><div class='main with-sidebar'><div>{ARTICLE}</div></div><div class=sidebar><p>{P1}</p></div>",
    f"<article><header>{ARTICLE}</header></article><!-- <p>hidden, text</p> --><noscript><p>Turn it on, please, now.</p></noscript>",
    "<article>" + ARTICLE.replace("</p>", "") + "</article>",
]


@pytest.mark.parametrize("page", PAGES)
def test_articles(page):
    assert ht.main_text(page) == TEXT


def test_odd_pages():
    for page in (None, "", "   ", "<", "<p", "<<<>>>", "</p></p>", "<!-- never closed", "<script>never closed", "<nav>x</nav>", "&lt;", "<a" + " x" * 9000):
        assert isinstance(ht.main_text(page), str)
    assert ht.main_text("<p>just &lt;text&gt;, here.</p>") == "just <text>, here."
    assert ht.main_text("<article>" + "<p>word, and word.</p>" * 5000 + "</article>").count("\n") == 4999
    assert ht.main_text("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."


def test_broken_markup_takes_linear_time():
    for page in ("<a " * 400_000, '<a "x" ' * 150_000 + '">', "<!" * 300_000, "<script>" + "</script " * 200_000, "a<" * 300_000 + ">", "<a '" * 200_000, "<div>x, y" * 20_000, "<b>x" * 20_000, "<p><object>" + "<b>" * 40_000 + "<div></div>" * 40_000, "<table><p>" + "<b>" * 40_000 + "<p></div>" * 40_000):
        began = time.process_time()
        ht.main_text(page)
        assert time.process_time() - began < 4


def plain_page(r):
    """A page without article or main, its menu, advert and comments untagged and unnamed; and its article's text."""
    words = lambda n: " ".join(r.choice("the of and thing water people measure through between country".split()) for _ in range(n))
    para = lambda: f"{words(r.randint(20, 60)).capitalize()}, {words(r.randint(5, 25))}. {words(12).capitalize()}."
    menu = "".join(f"<span><a href=/{k}>{words(2)}</a></span>" for k in range(r.randint(4, 9)))
    if r.random() < 0.5:
        menu = "<ul>" + "".join(f"<li><a href=/{k}>{words(2)}</a></li>" for k in range(r.randint(4, 9))) + "</ul>"
    comments = "".join(f"<div><b>{words(1)}</b><span>{words(r.randint(3, 9))}.</span></div>" for _ in range(r.randint(2, 5)))
    blocks = [("h1", words(6))]
    for _ in range(r.randint(3, 9)):
        blocks += [("h2", words(4))] * (r.random() < 0.2) + [("p", words(3) + ".")] * (r.random() < 0.2) + [("p", para())] + [("li", words(4))] * (3 * (r.random() < 0.2))
    blocks.append(("p", para()))
    inner = re.sub("((?:<li>[^<]*</li>)+)", r"<ul>\1</ul>", "".join(f"<{t}>{b}</{t}>" for t, b in blocks))
    page = f"<html><body><div>{menu}</div><div>{words(6).capitalize()}.</div><div><div>{inner}</div></div><div>{comments}</div><div><span>Imprint</span> <a href=/x>{words(2)}</a></div></body></html>"
    return page, "\n".join(b for _, b in blocks)


def test_ratios_select_the_nodes(monkeypatch):
    r = random.Random(1)
    pages = [plain_page(r) for _ in range(200)]
    right = sum(ht.main_text(p) == want for p, want in pages)
    assert right >= 190
    monkeypatch.setattr(ht, "content_keys", lambda nodes: {e.key for e, _, _ in nodes})
    assert sum(ht.main_text(p) == want for p, want in pages) <= 20


def test_articles_without_article():
    long = " ".join([P1] * 8)
    for page, want in [
        (f"<body><div id=post><h1>A title</h1><p>{P1}</p><div class=body><p>{long}</p></div><p>{P2}</p></div></body>", f"A title\n{P1}\n{long}\n{P2}"),
        (f"<div><p>{P1}</p><ul>{f'<li>{P2}</li>' * 9}</ul><p>{P2}</p></div>", "\n".join([P1, *[P2] * 9, P2])),
        ("".join(f"<article><p>{P1}</p><p>{P2}</p></article>" for _ in range(4)), "\n".join([P1, P2] * 4)),
        (f"<div><h2>Head</h2><p>{P1}</p><table><tr><td>a</td><td>b</td></tr></table><p>{P2}</p></div>", f"Head\n{P1}\na\nb\n{P2}"),
    ]:
        assert ht.main_text(page) == want


LONG = "".join(f"<p>{P1} {P2} {P1}</p>" for _ in range(8))
LONG_TEXT = "\n".join([f"{P1} {P2} {P1}"] * 8)
TEASER = "<article class=card><h3>Next, please</h3><p>A short line, to be clicked.</p></article>"
COMMENTS = "".join(f"<article class='comment-body'><p>{P2} {P1} {P2} {P1}</p></article>" for _ in range(12))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class=post><h1>Title</h1>{LONG}</div>{TEASER}", f"Title\n{LONG_TEXT}"),
        (f"<main><h1>Title</h1>{LONG}{TEASER}</main>", f"Title\n{LONG_TEXT}"),
        (f"<div class=post><h1>Title</h1>{LONG}</div><div>{COMMENTS}</div>", f"Title\n{LONG_TEXT}"),
        (f"<div class=post><h1>Title</h1>{LONG}</div><div>{TEASER * 5}</div>{COMMENTS}", f"Title\n{LONG_TEXT}"),
        (f"<article><h1>Title</h1>{LONG}</article>{TEASER * 3}", f"Title\n{LONG_TEXT}"),
        (f"{TEASER * 3}<article><h1>Title</h1>{LONG}</article>", f"Title\n{LONG_TEXT}"),
        (f"<article><h1>Title</h1>{LONG}{COMMENTS}</article>", f"Title\n{LONG_TEXT}"),
        (f"<article><h1>Title</h1>{LONG}<section id=comments><h2>12 comments</h2>{COMMENTS.replace('article', 'div')}</section></article>", f"Title\n{LONG_TEXT}"),
        (f"<main><article><h1>Title</h1>{LONG}</article><section>{TEASER * 4}</section></main>", f"Title\n{LONG_TEXT}"),
        (f"<article><main><h1>Title</h1>{LONG}</main></article>{TEASER}", f"Title\n{LONG_TEXT}"),
        (f"<main><div class=post><h1>Title</h1>{LONG}</div><div class=related-posts>{TEASER * 4}</div></main>", f"Title\n{LONG_TEXT}"),
        (f"<main><article>{LONG}</article><article>{LONG}</article></main>", f"{LONG_TEXT}\n{LONG_TEXT}"),
        (f"<main>{TEASER}</main><div class=post>{LONG}</div>", LONG_TEXT),
        (f"<article>{LONG}<div class=promotion-history><p>{P1} {P2}</p></div></article>", f"{LONG_TEXT}\n{P1} {P2}"),
        (f"<article>{LONG}<section class=search-algorithms><p>{P1} {P2}</p></section></article>", f"{LONG_TEXT}\n{P1} {P2}"),
        (f"<article>{LONG}<div class=promo-box><p>{P1} {P2}</p></div></article>", LONG_TEXT),
        (f"<article>{LONG}</article><div class=ad-slot><p>{P1 * 4}</p></div>", LONG_TEXT),
        (f"<div class='page has-sidebar no-comments'>{LONG}</div><div class=widget-area><p>{P1}</p></div>", LONG_TEXT),
        (f"<div id=comments><h1>Title</h1>{LONG}</div>", f"Title\n{LONG_TEXT}"),
        (f"<div class=notice-page><h1>Title</h1>{LONG}</div><p>Imprint</p>", f"Title\n{LONG_TEXT}"),
        (f"<div class=post><h1>Title</h1>{LONG}</div><ol class=commentlist>{'<li class=comment><p>' + P2 * 5 + '</p></li>' * 9}</ol>", f"Title\n{LONG_TEXT}"),
        (f"<main><h1>Title</h1><article>{LONG}</article><div class=newsletter-signup><p>{P1} {P1}</p></div></main>", LONG_TEXT),
        (f"<article>{P1}<p>{P2}</p></article>" + f"<article class=teaser><p>{P1}</p></article>" * 20, f"{P1}\n{P2}"),
    ],
)
def test_teasers_comments_and_nested_articles(page, want):
    assert ht.main_text(f"<html><body>{NOISE[0]}{page}{NOISE[1]}</body></html>") == want


def test_ratios_pick_text_over_links():
    nodes = ht.text_nodes(f"<body><ul>{'<li><a>one</a></li>' * 9}</ul><div><p>{P1}</p><p>{P2}</p></div></body>")
    assert ht.content_paths(nodes) == {"/body/div/p"}


def test_rows(spark):
    rows = [(1, "u", PAGES[0]), (1, "u", PAGES[0]), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as id", "3 as n_chars")
    got = sorted((r["id"] or 0, r["text"], r["n_chars"]) for r in ht.extract_text(df).collect())
    assert got == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0)]
    assert ht.extract_text(df.limit(0)).count() == 0


def test_given_pages(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        m = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", m[1]))
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    got = {r["page_id"]: r["text"] for r in ht.op1_html_tag_paths(spark, sf).collect()}
    assert got == want
