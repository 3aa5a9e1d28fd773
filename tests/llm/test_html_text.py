import html
import re

from tablecare.llm import html_text

from .helpers import LONG, SMALL

WEIGHTS = html_text.fit_weights(html_text.labelled_by_hand())


def test_table_pages_give_their_article(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:h1|p)>", body)]
        want = "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_boilerplate_goes_and_blocks_stay():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href="a">A</a></li><li><a href="b">B</a></li></ul></nav><div class="cookie-banner">We use cookies, agree to it all.</div>
<div class="content"><h1>The &quot;title&quot;</h1><p>First   paragraph
with <a href="x">a link</a> and <b>bold</b>&nbsp;words &lt;here&gt; in it.<br>After a break.</p><div class="ad">Buy this now and save a lot of money today</div>
<p>Second paragraph has as many words as the first one had.<script>var x = "<p>no</p>";</script></p><ul><li>point one of three</li><li>point two</li></ul></div>
<aside class="sidebar"><p>Other things that do not belong to it at all, many words of it.</p></aside>
<section id="comments"><p>Great article, I liked it so much that I wrote this.</p></section><form><p>Subscribe now to the letter we send</p></form>
<footer>All rights reserved</footer></body></html>"""
    assert html_text.extract(page, WEIGHTS) == (
        'The "title"\nFirst paragraph with a link and bold words <here> in it. After a break.\n'
        "Second paragraph has as many words as the first one had.\npoint one of three\npoint two")


def test_best_run():
    assert html_text.best_run([-1, 2, -1, 3, -5, 4]) == (1, 4) and html_text.best_run([-1, 0]) == (0, 0) and html_text.best_run([]) == (0, 0)


def test_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>", "x"), (4, "u", "just some plain text", "x"), (4, "u", "just some plain text", "x"),
            (5, "u", f"<article><p>{LONG}</p></article>", "x"), (6, "u", "<div <p a='>' \"> broken <b", "x"), (7, "u", "<!-- only a comment", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_pages(pages).orderBy("page_id").collect()
    assert [r["text"] for r in got][:5] == ["", "", "", "just some plain text", "just some plain text"]
    assert got[5]["text"] == LONG and got[7]["text"] == ""
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def shown(page):
    return " ".join("".join(x or " " for _, _, x in html_text.tokens(page)).split())


def test_raw_and_skipped_elements_do_not_swallow_the_page():
    rest = "<p>three</p></article>"
    for inside, want in (('<svg-icon name="x"></svg-icon> two', "two"), ("<button-group>a</button-group> two", "a two"), ("<video-player></video-player>two", "two"),
                         ('<svg width="1"/> two', "two"), ("<math/> two", "two"), ("<button>press", ""), ("<object data='x'>", ""), ("<titles>two</titles>", "two"),
                         ("<svg><g><svg></svg><path d=''/><title>t</title></g>x</svg>two", "two"), ("<select><option>a<option>b</select> two", "two"),
                         ("<video><p>no video</p></video> two", "two"), ("<style>p { }</style foo> two", "two"), ("<BUTTON>x</Button>two", "two"), ("</svg>two", "two")):
        page = f"<article><p>one {inside}</p>{rest}"
        assert shown(page) == " ".join(f"one {want} three".split()), page
    assert shown("<body><button>x<div>a</div><p>b</p></body>") == "a b" and shown("<p>a</p><script>b<p>c</p>") == "a"
    assert shown("<p>a <svg>b") == "a" and shown("<button>" * 20_000 + "<p>a</p>") == "a" and shown("<svg><b>" * 20_000 + "</svg>") == ""
