"""Main text of raw web pages.

Method: two passes over the blocks of a page.  The first pass decides by a block's own share of stop words, its length and the share of
its letters inside links: good, near good, short or bad.  The second pass gives blocks that are short or near good the label of the
nearest decided block before and after them (near good: one good neighbour is enough; short: both, or one at an end of the text).

What the page itself says about its parts comes first.  Parts named as navigation, header, footer, aside, form, dialog, script or style by their
element, role or class are bad whatever they say, and where a page marks its articles or main part, the rest is bad (of a main part around
articles the rules decide; of an article's header its headings stay).  Inside a marked part only links can make a block bad, so that short lines, headings and texts in languages without a list of stop
words stay.  Without a marked part the rules alone decide; on a page without any share of stop words, length and links do.

Pages are cut into blocks one by one; both passes run over all blocks of a batch at once in numpy.  Nothing is exchanged.

Nulls: a null page is an empty one; a null or repeated page_id or url is passed on.  Pages without text blocks give an empty text.  A tag that is never closed ends with
its page; an unclosed comment, script or style takes the rest.  Other columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.words import chunks

LOW, HIGH = 0.3, 0.32  # shares of stop words
SHORT, LONG = 70, 200  # characters
LINKS = 0.2  # share of characters inside links

#: Frequent words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """the and of to in is that it for was on are as with be at by this from or an not have has but they you which were we he she his her
    der die das und ist nicht ein eine einen dem den des mit von zu auf für sich auch als es im er sie wir aus bei nach wie oder
    le la les un une et est en que qui dans pour pas sur par au aux du de ce il elle on nous vous avec son sa ses plus mais ou
    el los las y es por con para una del se no lo su al como más pero sus o este esta
    di che non per il sono della nel gli dei delle alla
    os não uma com dos ao pelo
    het een van niet zijn aan voor ook""".split()
)

BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements whose content is never text.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "svg", "math", "select", "canvas", "audio", "video", "noframes", "noembed", "xmp")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"body", "html", "head", "caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Siblings that end an open element of the same kind: element, those that it ends, and the ancestors where the search stops.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Parts that are never main text, by element, by ARIA role and by words of class and id.
BAD_ELEMENTS = frozenset("nav footer aside form dialog menu button label fieldset head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tablist".split())
BAD_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements adsense adslot sponsor sponsored sponsors promo promos promoted promotion
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar sidebar sidebars aside footer foot masthead
    comment comments respond replies disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription
    signup login social share sharing related recommended recommendations widget widgets copyright legal disclaimer banner skip""".split()
)
HEADER_WORDS = frozenset(["header"])
MAIN_WORDS = frozenset("article content main post entry story body text".split())
#: Words of class and id that say nothing bad beside a word for main text, and words that only tell of another part.
WEAK_WORDS = frozenset("widget widgets share sharing social notice notices banner legal skip alert login header subscription".split())
TELLING_WORDS = frozenset("has with no without".split())

_TAG = re.compile(r"""<!--(?:(?:>|->)|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>|<[!?/][^>]*(?:>|\Z)""", re.S)
_BROKEN = re.compile("<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|\Z)""", re.I)
_WORD_EDGE = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_COPYRIGHT = re.compile("©|\\(c\\)|copyright", re.I)
_WORD = re.compile(r"[^\W\d_]+")

OPEN, BAD, MAIN, ARTICLE, TITLE = range(5)  # what is known of a place in the page; TITLE: the header of an article


def _place(tag: str, attributes: str, now: int, in_main: bool) -> tuple[int, bool]:
    """Of the content of an element: its state, and whether it lies in a marked main part."""
    if now == BAD or tag in BAD_ELEMENTS:
        return BAD, in_main
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes and not attributes.isspace() else {}
    role = found.get("role", "").strip().lower()
    names = {w.lower() for w in _WORD_EDGE.split(found.get("class", "") + " " + found.get("id", ""))} - {""}
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return BAD, in_main
    if tag == "article" or role == "article":
        marked = ARTICLE
    elif tag == "main" or role == "main":
        marked = max(now, MAIN)
    else:
        marked = TITLE if tag == "header" else now
    if role in BAD_ROLES or (tag == "header" and now not in (ARTICLE, TITLE)):
        return BAD, in_main
    against = names & (BAD_WORDS if in_main else BAD_WORDS | HEADER_WORDS)
    if against and tag not in ("html", "body", "main") and not names & TELLING_WORDS and not (names & MAIN_WORDS and against <= WEAK_WORDS):
        return BAD, in_main
    return marked, in_main or marked != OPEN


class Blocks:
    """The text blocks of pages, with what the first pass looks at."""

    def __init__(self):
        self.page, self.text, self.linked, self.state, self.heading = [], [], [], [], []

    def add(self, page: int, parts: list[str], linked: int, state: int, heading: bool) -> None:
        text = " ".join("".join(parts).split())
        if text:
            self.page.append(page)
            self.text.append(text)
            self.linked.append(min(linked, len(text)))
            self.state.append(state)
            self.heading.append(heading)

    def cut(self, page: int, source: str) -> None:
        """Append the blocks of one page."""
        stack: list[tuple[str, int, bool]] = []  # open elements with the state of what lies in them
        state, in_main, links, linked, at = OPEN, False, 0, 0, 0
        parts: list[str] = []
        heading = False
        opened: Counter = Counter()

        def close(k: int) -> None:
            nonlocal state, in_main, links
            for t, _, _ in stack[k:]:
                opened[t] -= 1
            links = opened["a"]
            del stack[k:]
            _, state, in_main = stack[-1] if stack else ("", OPEN, False)

        def flush() -> None:
            nonlocal linked
            if parts:
                self.add(page, parts, linked, state, heading)
                parts.clear()
            linked = 0

        def said(raw: str) -> None:
            nonlocal linked
            if raw and state != BAD:
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if links:
                    linked += len(" ".join(text.split()))

        last = source.rfind(">") + 1  # no tag ends behind it
        while (m := _TAG.search(source, at, last)) is not None:
            said(source[at : m.start()])
            at = m.end()
            closing, tag, attributes = m[1], m[2], m[3]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    said(m[0][9:].removesuffix("]]>"))
                elif m[0].startswith("<!--") and not m[0].endswith(("->", "!>", "<!-->")):
                    at = len(source)
                continue
            tag = tag.lower()
            if tag == "br":
                parts.append(" ")
                continue
            if tag in BLOCK:
                flush()
            if closing:
                for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag not in BLOCK and stack[k][0] in BLOCK:
                        break  # an inline element is not closed across a block
                heading = any(opened[h] for h in HEADINGS)
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag != "a":
                continue
            if tag in BLOCK and stack and stack[-1][0] == "head":
                close(len(stack) - 1)
            if tag == "a":
                if links:
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "a"))
                end = _LINK.search(source, at)
                if not end or not end[1]:
                    continue  # never closed: no telling where the link ends
            if tag in CLOSES_P and opened["p"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            if tag in SIBLINGS:
                ends, stop = SIBLINGS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in stop:
                        break
                    if stack[k][0] in ends and (tag != "tr" or stack[k][0] == "tr"):
                        close(k)
                        break
            new = _place(tag, attributes, state, in_main)
            if tag not in BLOCK and tag != "a" and new == (state, in_main):
                continue  # an inline element that changes nothing
            state, in_main = new
            stack.append((tag, state, in_main))
            opened[tag] += 1
            links = opened["a"]
            heading = any(opened[h] for h in HEADINGS)
        rest = source[at:]
        cut = _BROKEN.search(rest)
        said(rest[: cut.start()] if cut else rest)
        flush()

    def kept(self) -> np.ndarray:
        """Both passes over all blocks; True for main text."""
        n = len(self.text)
        if not n:
            return np.zeros(0, bool)
        page, state, heading = np.array(self.page, np.int64), np.array(self.state, np.int8), np.array(self.heading, bool)
        length = np.fromiter(map(len, self.text), np.int64, n)
        words = [_WORD.findall(t.lower()) for t in self.text]
        stops = np.fromiter((sum(w in STOP_WORDS for w in ws) for ws in words), np.float64, n) / np.maximum(1, np.fromiter(map(len, words), np.int64, n))
        in_links = np.array(self.linked, np.int64) / np.maximum(1, length)
        legal = np.fromiter((length[k] < LONG and _COPYRIGHT.search(t) is not None for k, t in enumerate(self.text)), bool, n)
        articles = np.bincount(page, weights=state >= ARTICLE) > 0
        marked = articles | (np.bincount(page, weights=state == MAIN) > 0)
        # pass 1: by itself
        bad = ((in_links > LINKS) & ~heading) | legal
        short, near = length < SHORT, (stops >= LOW) & (stops < HIGH)
        good = ~bad & ~short & (stops >= HIGH) & (length > LONG)
        near |= ~short & (stops >= HIGH)
        spoken = np.bincount(page, weights=good | (near & ~short & ~bad)) > 0  # pages whose language the list covers
        good |= ~spoken[page] & ~bad & (length > LONG)
        near |= ~spoken[page] & ~bad & ~short
        bad |= ~short & ~near & ~good
        # what the page says of its parts: links alone count against a block of a marked part
        own = (state >= ARTICLE) | ((state == MAIN) & ~articles[page])
        good = np.where(own, (in_links <= 0.5) & (state != TITLE) | heading, good)
        bad = np.where(own, ~good, bad | (marked[page] & (state != MAIN)))
        good &= ~bad
        # pass 2: by the nearest decided neighbours in the same page
        return good | (~good & ~bad & _inherits(page, good, bad, short | heading))


def _inherits(page: np.ndarray, good: np.ndarray, bad: np.ndarray, strict: np.ndarray) -> np.ndarray:
    """Of undecided blocks, by the nearest decided block before and behind them; ``strict`` ones need good ones on all sides there are, others on one."""
    n = len(page)
    at, decided = np.arange(n), good | bad
    before = np.maximum.accumulate(np.where(decided, at, -1))
    behind = np.minimum.accumulate(np.where(decided, at, n)[::-1])[::-1]
    has_before, has_behind = before >= 0, behind < n
    before, behind = np.maximum(before, 0), np.minimum(behind, max(0, n - 1))
    has_before &= page[before] == page
    has_behind &= page[behind] == page
    good_before, good_behind = has_before & good[before], has_behind & good[behind]
    alone = ~has_before & ~has_behind  # nothing was decided on this page: short texts are all there is
    both = (good_before | ~has_before) & (good_behind | ~has_behind)
    return np.where(strict, both, good_before | good_behind | alone)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html", most=1 << 20):
        blocks = Blocks()
        for k in range(batch.num_rows):
            blocks.cut(k, batch["html"][k].as_py() or "")
        kept = np.flatnonzero(blocks.kept())
        texts: list[list[str]] = [[] for _ in range(batch.num_rows)]
        for k in kept:
            texts[blocks.page[k]].append(blocks.text[k])
        out = ["\n".join(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks of the article, one line each) and n_chars of every page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
