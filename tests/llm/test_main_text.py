"""Main text: all pages against their article element, and made-up layouts."""

import html
import re
import time

import pytest

from shelftally.llm.main_text import extract, main_text

SF = "/root/testdata/sf0.01"
PROSE = "Some words, then more words, and a clause that goes on for a while, so that it counts as prose."


def article_of(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(b for b in blocks if b)


def test_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: (r["url"], article_of(r["html"])) for r in pages.collect()}
    got = {r["page_id"]: (r["url"], r["text"]) for r in extract(pages).collect()}
    assert got == want


def test_defined_cases(spark):
    rows = [(1, "u", None, "clash"), (1, "u", None, "clash"), (None, None, f"<p>{PROSE}", "x"), (3, "v", "", "x"), (4, "v", "<nav>menu</nav>", "x")]
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()), key=repr)
    assert got == [(0, None, PROSE, len(PROSE)), (1, "u", "", 0), (1, "u", "", 0), (3, "v", "", 0), (4, "v", "", 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "noise",
    [
        "<nav><p>{}</p></nav>", "<div class='sidebar'>{}</div>", "<div id=comments><p>{}</p></div>", "<form><p>{}</p></form>",
        "<aside>{}</aside>", "<footer><p>{}</p></footer>", "<div class='cookie-notice'><p>{}</p></div>", "<!-- {} -->",
        "<script>var a = '<p>{}</p>';</script>", "<style>p {{ }} {}</style>", "<div role=navigation>{}</div>", "<div hidden>{}</div>",
        "<div style='display: none'>{}</div>", "<div class='ad-slot'>{}</div>", "<noscript>{}</noscript>", "<header><p>{}</p></header>",
        "<ul><li><a href=x>{}</a></ul>", "<section class=commentList>{}</section>",
    ],
)
def test_noise_around_and_inside(noise):
    other = noise.format("Buy this, or that, or those, and do it now, before it is too late, dear reader.")
    page = f"<html><body>{other}<div class=content><h2>Title</h2><p>{PROSE}</p>{other if 'href' not in noise and '<header' not in noise else ''}<p>End.</p></div>{other}</body></html>"
    assert main_text(page) == f"Title\n{PROSE}\nEnd."


@pytest.mark.parametrize(
    "wrapper",
    [
        "<div class='content with-sidebar'>{}</div>", "<div id='page' class='site has-sidebar'>{}</div>", "<div class='with-comments'>{}</div>",
        "<article class='post category-social tag-newsletter'>{}</article>", "<article class='post has-comments'>{}</article>",
        "<div class='category-social'>{}</div>", "<div class=promo><h1>T</h1>{}</div>",
    ],
)
def test_wrappers_with_names_of_other_things(wrapper):
    body = wrapper.format(f"<p>{PROSE}</p><div class=comments>{PROSE[:40]}</div><p>End.</p>")
    want = ("T\n" if "<h1>" in wrapper else "") + f"{PROSE}\nEnd."
    assert main_text(f"<body><nav>menu</nav>{body}<div class=sidebar>{PROSE[:40]}</div></body>") == want
    assert main_text(f"<body><div class=content><p>{PROSE}</p></div><div class='comment-content'>{PROSE * 4}</div></body>") == PROSE


def test_siblings_and_parts_of_an_article():
    page = f"<body><div><h1>Head</h1><div><p>{PROSE}</p><p>{PROSE}</p></div><div><p>{PROSE}</p></div><p><a href=y>more</a></p></div></body>"
    assert main_text(page) == "\n".join(["Head", PROSE, PROSE, PROSE])
    page = f"<main><section><h2>A</h2><p>{PROSE}</p></section><section><p>Short.</p></section></main><div class=related>{PROSE}</div>"
    assert main_text(page) == f"A\n{PROSE}\nShort."
    assert main_text(f"<article><header><h1>T</h1><p>by X</p></header><p>{PROSE}</article>") == f"T\n{PROSE}"


def test_parts_beside_the_best_container():
    long = "<p>" + PROSE * 4 + "</p>"
    links = "<ul><li><a href=x>more of this</a></ul>"
    page = f"<body>{links}<div class=content><section>{long * 10}</section><section><h2>B</h2><p>A last section of about sixty characters without any comma</p></section></div>{links}</body>"
    assert main_text(page) == "\n".join([PROSE * 4] * 10 + ["B", "A last section of about sixty characters without any comma"])
    page = f"<body><div><div>{long * 3}</div><h2>More</h2><ul><li>one<li>two</ul><table><tr><td>1<td>2</table><p>The end.</p>{links}</div></body>"
    assert main_text(page) == "\n".join([PROSE * 4] * 3 + ["More", "one", "two", "1", "2", "The end."])
    page = f"<body><div><div><div>{long * 5}</div></div><div><div>{long * 2}</div><p>Short.</p></div></div>{links}</body>"
    assert main_text(page) == "\n".join([PROSE * 4] * 7 + ["Short."])
    assert main_text(f"<body><article>{long}</article><p>Not of it.</p></body>") == PROSE * 4


def test_markup_that_is_not_well_formed():
    assert main_text("<p>a &amp; b &lt;c&gt; &eacute;&#33;<p>x\n\t y <b>z<br>w") == "a & b <c> é!\nx y z w"
    assert main_text("<body><p>one</b></p></i>two</div></span><p>1 < 2") == "one\ntwo\n1 < 2"
    assert main_text('<p title="a > b">text</p><p title="open>rest') == "text\nrest"
    assert main_text("<script>never closed <p>x</p>") == ""
    deep = "<div>" * 3000 + PROSE + "</div>" * 3000
    assert main_text(deep) == PROSE
    assert main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()


QUAY = "The harbour was empty, the boats had left before dawn, and nobody on the quay could say when they would be back. " * 3
ARTICLE = f"<h1>Harbour</h1><p>{QUAY}</p><p>{QUAY}</p>"


@pytest.mark.parametrize(
    "extra",
    [
        "<ol class=commentlist><li>Ann: I was there, it was cold.<li>Bob: So was I, colder.</ol>",
        "<section class=discussion><p>Ann, Monday: I was there, it was cold.</p><p>Bob: So was I.</p></section>",
        "<section class=reactions><p>Ann, Monday: I was there, it was cold.</p></section>",
        "<div><h2>12 Comments</h2><p>Ann, Monday: I was there, it was cold.</p><div><p>Bob: So was I, colder.</p></div></div>",
        "<h3>Leave a comment</h3><p>Ann, Monday: I was there, it was cold.</p>",
        "<ins class=adsbygoogle>Cheap boats, call now</ins>",
        "<div class=adbox><p>Cheap boats, call now</p></div>",
        "<div class='ad-slot'><p>Cheap boats, call now</p></div>",
        "<h2>More stories</h2><ul><li><a href=a>One more story</a><li><a href=b>Another story</a><li><a href=c>A third story</a></ul>",
    ],
)
@pytest.mark.parametrize("page", ["<body><article>{}</article></body>", "<main><article>{}</article></main>", "<div class=content>{}</div>"])
def test_comments_adverts_and_link_lists_inside_an_article(page, extra):
    want = "\n".join(["Harbour", QUAY.strip(), QUAY.strip()])
    assert main_text(page.format(ARTICLE + extra)) == want


def test_link_list_beside_the_article():
    more = "<section><h2>More stories</h2><ul>" + "".join(f"<li><a href={i}>Story number {i}</a>" for i in range(6)) + "</ul></section>"
    assert main_text(f"<main><article>{ARTICLE}</article>{more}</main>") == main_text(f"<main><article>{ARTICLE}</article></main>")


@pytest.mark.parametrize(
    "part",
    ["<h2>Discussion</h2><p>Our results differ, by little.</p>", "<p class=commentary>He said so, twice.</p>", "<ul><li>Rope<li>Anchor, <a href=x>see</a></ul>",
     "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>", "<div class=address><p>Quay 7, Harbour</p></div>"],
)
def test_parts_that_only_look_like_them_stay(part):
    text = main_text(f"<article>{ARTICLE}{part}</article>")
    assert text.count("\n") > 2 and len(text) > len(main_text(f"<article>{ARTICLE}</article>"))


HOSTILE = {
    "open tags": "<a " * 300_000, "quotes": '<a b="' * 150_000, "inline": "<b>" * 150_000 + "</i>" * 120_000,
    "headers": "<div><header>" * 60_000, "items": "<div>" * 90_000 + "<li></li>" * 60_000, "comments": "<!--" * 250_000,
    "declarations": "<!" * 500_000, "scripts": "<script>" * 120_000, "lists": "<li><ul>" * 90_000 + "<li></li>" * 20_000,
    "paragraphs": "<p>x" * 200_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_megabytes_of_broken_markup_take_seconds(name):
    start = time.perf_counter()
    main_text(HOSTILE[name])
    main_text(f"<article>{ARTICLE}</article>{HOSTILE[name]}")
    assert time.perf_counter() - start < 60
