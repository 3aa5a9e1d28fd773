"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tags and of words with their place (paragraph, link, list, heading,
boilerplate element). Every token has a weight learnt from labelled pages: words score by how
much more often such words stand inside the article than outside, tags score below zero and the
more so the rarer they are inside, most of all those of elements that hold blocks. One linear scan finds the contiguous run with the largest
sum; its words, less those of menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, are the text.

The labelled pages are a bounded sample of the table's pages that mark their article by an
``article`` or ``main`` element, and a few built-in pages with the article marked by hand that
stand for other layouts.

Blocks: character references decoded, white space inside a block one space, trimmed, empty
blocks left out, joined in page order by one line feed. ``br`` is white space.

Defined results: a null or empty page, or one without a positive run, has an empty text;
repeated pages are extracted each; unclosed elements end where an enclosing one ends, and those
whose content is passed over at the next block already.
"""

from __future__ import annotations

import bisect
import html as htmllib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, hashed_sample, texts

#: Pages of the table used for fitting, at most.
SAMPLE = 500

#: Elements that hold no tags and run to the end of the page if they are not closed.
_RAW = "script|style|noscript|textarea|iframe|title"
#: Elements whose content is passed over.
SKIPPED = frozenset("template svg object select button math canvas audio video".split())
_TAG = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I)
_MARK = re.compile(r"\b(class|id|role|hidden|aria-hidden|aria-label|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split())
BOX = frozenset(
    "article aside blockquote body center details dialog div dl fieldset figure footer form head header html main menu nav ol search "
    "section table ul".split())
#: Elements that never hold the article, and elements that are never taken for boilerplate by their class.
BOILER = frozenset("nav aside footer header form menu head dialog search".split())
CONTENT = frozenset("html body main article".split())
#: Parts of class, id and role names that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promoted promotion sidebar aside rail "
    "widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer colophon copyright comment "
    "comments commentlist respond reply replies discussion disqus cookie cookies consent gdpr notice notices alert alerts popup modal "
    "overlay newsletter subscribe subscription signup login register search share sharing social related recommended recommendations "
    "pagination pager toolbar hidden disclaimer form complementary contentinfo dialog paywall teaser outbrain taboola".split())
NEGATED = frozenset("with has no without".split())
PLACES = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "p", "pre": "p", "blockquote": "p", "li": "list", "dt": "list", "dd": "list",
          "td": "cell", "th": "cell", "figcaption": "caption", "caption": "caption"}

#: Boilerplate inside the article is left out of the text, so it costs only a little to pass over.
SKIP, SKIP_WEIGHT = "<boilerplate>", -4.0

#: Labelled by hand; the article stands between the two marks.
LABELLED = [
    """<html><head><title>t</title></head><body><div id="header"><a href="/">Home</a> <a href="/b">News</a> <a href="/c">About us</a></div>
<div id="content">[[<h2>Heading of the text</h2><p>First paragraph with a number of plain words that tell something, <a href="x">a link</a> too.</p>
<p>Second paragraph goes on with more words and <em>some stress</em> as texts do.</p><ul><li>one point of a list</li><li>another point</li></ul>
<p>The last paragraph ends it here.</p>]]</div><div class="sidebar"><h3>Popular</h3><ul><li><a href="1">Read this</a></li><li><a href="2">And that</a></li></ul></div>
<div id="footer">All rights reserved <a href="i">Imprint</a></div></body></html>""",
    """<html><body><table><tr><td><a href="1">One</a></td><td><a href="2">Two</a></td><td><a href="3">Three</a></td></tr></table>
<div><span>Login</span> <a href="x">Sign up</a></div>[[<h1>A title</h1><div>Plain text in a division, with enough words to count as a text of its own right.</div>
<div>Another division with more of the same, long enough as well to be the main part.</div>]]<div><a href="p">Previous</a> <a href="n">Next</a></div>
<div>Posted in <a href="c">things</a> by <a href="u">someone</a></div></body></html>""",
    """<html><body><ul class="menu"><li><a href="a">Start</a></li><li><a href="b">Shop</a></li></ul><div class="cookie-notice">We use cookies to give you the best
experience on our site.</div><main>[[<h1>Story</h1><p>It was a day like others, and the words went on for a while until they stopped.</p><blockquote>Quoted words stand
inside of it.</blockquote><p>More words follow after the quotation.</p>]]</main><section class="comments"><h3>2 comments</h3><p>I like this very much, thank you.</p>
<p>So do I, it is a great one.</p></section><form><label>Name</label><input></form><footer>Contact us</footer></body></html>""",
]


def _boiler(name: str, attrs: str) -> bool:
    if name in CONTENT:
        return False
    if name in BOILER:
        return True
    if not attrs or not attrs.strip():
        return False
    for m in _MARK.finditer(attrs):
        k, v = m[1].lower(), (m[2] or "").strip("\"'")
        if k == "hidden" or (k == "aria-hidden" and v.lower() == "true"):
            return True
        if k == "style":
            if "display:none" in v.replace(" ", "").lower():
                return True
            continue
        if k in ("class", "id", "role"):
            for word in v.split():
                parts = {p.lower() for p in _PART.findall(word)}
                if parts & MARKS and not parts & NEGATED:
                    return True
    return False


def skipped_elements(tags: list[tuple[str, bool, bool]]) -> dict[int, tuple[int, bool]]:
    """Where the elements of SKIPPED end, by the place of their start tag: the place of a tag, and whether it still
    belongs to the element. ``tags`` are (name, end tag, self-closed), the name empty if it is no element's.

    One without an end tag inside its parent ends at the next block's tag, at the latest at its parent's end."""
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    opened, unclosed = Counter(), []
    for i, (name, close, closed) in enumerate(tags):
        if not name or name in VOID or (closed and not close):
            continue
        if not close:
            stack.append((name, i))
            opened[name] += 1
        elif opened[name]:
            while True:
                last, k = stack.pop()
                opened[last] -= 1
                if last == name:
                    break
                if last in SKIPPED:
                    unclosed.append((k, i))
            if name in SKIPPED:
                ends[k] = i, True
    unclosed += [(k, len(tags)) for name, k in stack if name in SKIPPED]
    if unclosed:
        blocks = [i for i, t in enumerate(tags) if t[0] in BLOCK]
        for k, i in unclosed:
            at = bisect.bisect_right(blocks, k)
            ends[k] = min(i, blocks[at] if at < len(blocks) else i), False
    return ends


def tokens(page: str) -> list[tuple[str, int, str | None]]:
    """(kind, words, text) in page order. Tags have no words; a text of None ends a block."""
    out: list[tuple[str, int, str | None]] = []
    boxes: list[tuple[str, bool]] = []
    boiler, link, place, pos = 0, False, "box", 0

    def run(piece: str) -> None:
        if not piece or piece.isspace():
            if piece:
                out.append(("", 0, " "))
            return
        text = htmllib.unescape(piece) if "&" in piece else piece
        out.append(("w:boiler" if boiler else "w:link" if link else "w:" + place, len(text.split()), text))

    found = list(_TAG.finditer(page))
    tags = [((m[3] or m[6] or "").lower(), bool(m[2] or m[5]), (m[4] or m[7] or "").endswith("/")) for m in found]
    skipped = skipped_elements(tags) if any(t[0] in SKIPPED for t in tags) else {}
    until = -1  # tags before this place stand in an element passed over
    for i, m in enumerate(found):
        if i < until:
            continue
        run(page[pos:m.start()])
        pos = m.end()
        if i in skipped:
            end, own = skipped[i]
            out.append(("", 0, " "))
            until = end + own
            pos = found[end].end() if own else found[end].start() if end < len(found) else len(page)
            continue
        if tags[i][0] in SKIPPED:
            out.append(("", 0, " "))
            continue
        name, close, attrs = (m[3], m[2], m[4]) if m[3] else (m[6], m[5], m[7])
        if not name:
            if m[1]:
                out.append(("", 0, " "))
            continue
        name = name.lower()
        block, before = name in BLOCK, boiler
        if block:
            link = False
        if name == "a":
            link = not close
        elif name == "br":
            out.append(("<br", 0, " "))
            continue
        mark = ""
        if close:
            for k in range(len(boxes) - 1, -1, -1):
                if boxes[k][0] == name:
                    boiler -= sum(b for _, b in boxes[k:])
                    del boxes[k:]
                    break
            if block:
                place = "box"
        else:
            if block and boxes and boxes[-1][0] in ("p", "li") and boxes[-1][1] and (boxes[-1][0] == "p" or name == "li"):
                boiler -= 1
                boxes.pop()
            bad = _boiler(name, attrs)
            if name not in VOID and not attrs.endswith("/") and (bad or name in BOX):
                boxes.append((name, bad))
                boiler += bad
            mark = "!" if bad else ""
            if block:
                place = PLACES.get(name, "box")
        if boiler and not (mark and boiler == 1) or (close and before):
            kind = ""  # inside boilerplate, which counts once, by its start
        else:
            kind = SKIP if mark else ("</" if close else "<") + name
        out.append((kind, 0, None if block else ""))
    run(page[pos:])
    return out


def fit_weights(labelled: list[tuple[list, int, int]]) -> dict[str, float]:
    """Weight per kind of token, from token lists with the article at [start, end)."""
    inside, outside = Counter(), Counter()
    for toks, start, end in labelled:
        for i, (kind, words, _) in enumerate(toks):
            if kind:
                (inside if start <= i < end else outside)[kind] += words or 1
    weights = {}
    for kind in {*inside, *outside}:
        odds = math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))
        if kind.startswith("w:"):
            weights[kind] = max(-1.0, min(1.0, odds))
        else:
            hard = kind.lstrip("</") in BOX
            weights[kind] = -0.05 + (2.0 if hard else 0.1) * max(-4.0, min(0.0, odds))
    return weights | {"w:boiler": 0.0, SKIP: SKIP_WEIGHT}


def labelled_by_hand() -> list[tuple[list, int, int]]:
    out = []
    for page in LABELLED:
        a, b = page.index("[["), page.index("]]")
        head, body = tokens(page[:a]), tokens(page[:a] + page[a + 2:b])
        whole = tokens(page[:a] + page[a + 2:b] + page[b + 2:])
        out += [(whole, len(head), len(body))] * 50
    return out


def labelled_by_markup(page: str) -> tuple[list, int, int] | None:
    """A page's tokens and its article, if exactly one element marks it."""
    toks = tokens(page)
    for name in ("article", "main"):
        starts = [i for i, t in enumerate(toks) if t[0] == "<" + name]
        ends = [i for i, t in enumerate(toks) if t[0] == "</" + name]
        if len(starts) == 1 and len(ends) == 1 and starts[0] < ends[0]:
            return toks, starts[0] + 1, ends[0]
    return None


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest positive sum, the first of equals; (0, 0) if none."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str, weights: dict[str, float]) -> str:
    toks = tokens(page)
    word, tag = weights.get("w:box", 0.5), -0.5
    scores = [(weights.get(k, word) * n if n else weights.get(k, tag) if k else 0.0) for k, n, _ in toks]
    start, end = best_run(scores)
    blocks, block = [], []
    for kind, _, text in toks[start:end]:
        if text is None:
            blocks.append("".join(block))
            block = []
        elif kind != "w:boiler" and text:
            block.append(text)
    blocks.append("".join(block))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def fit(pages: DataFrame, html: str = "html", key: str = "page_id", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` pages that mark their article, in order of a hash of their key."""
    marked = pages.where(F.lower(html).contains("</article") | F.lower(html).contains("</main"))
    rows = hashed_sample(marked.select(key, html), sample, key, html)
    found = [labelled_by_markup(r[html]) for r in rows]
    return fit_weights([x for x in found if x] + labelled_by_hand())


def extract_pages(pages: DataFrame, html: str = "html", key: str = "page_id", sample: int = SAMPLE) -> DataFrame:
    """``pages`` without the markup: the other columns, ``text`` and ``n_chars`` (code points)."""
    weights = fit(pages, html, key, sample)

    def make():
        def f(batch):
            out = [extract(x, weights) if x else "" for part in texts(batch, html) for x in part]
            return [out, [len(x) for x in out]]
        return f

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return arrow_map(pages, fields, make, [c for c in pages.columns if c != html])
