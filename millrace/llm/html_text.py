"""Operator 4: main text of web pages by block rules in two passes.

A forgiving tag scanner cuts a page into blocks and leaves out elements that are furniture by their tag (nav, footer, aside, form,
script, style) or hidden. Pass one decides each block from its stop-word density, length and link density: long blocks
of running text are content, blocks of links are furniture; short blocks that say too little stay open. Two kinds of
evidence overrule running text: a class, id or role that names furniture (comments, notices, adverts), and standing outside
of article or main where the page has one; but if nothing is left as content, names are not believed, and then
places neither. In pass two an open block takes the label of its nearest decided neighbours under the same evidence.

Cases: a null, empty or text-less page gives an empty text; a page without any decided block keeps all its blocks;
unclosed, stray and crossed tags are mended as browsers do; pages of any length are read whole; repeated rows are
each extracted; other columns pass by; an empty table gives no rows.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
RAW = {"script", "style", "title", "textarea", "iframe", "noframes", "xmp"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = set("nav footer aside form head template noscript button select option datalist svg math canvas dialog menu object applet audio video map".split())
HEADINGS = {f"h{k}" for k in range(1, 7)}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body"}
PARAGRAPH_SCOPE = SCOPE | {"td", "th", "li"}
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription sidebar aside rail widget widgets related recommended recommendations share sharing social comment comments disqus respond reply "
    "replies discussion footer nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar login signin signup search copyright legal "
    "disclaimer masthead colophon hidden".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
STOPS = frozenset(
    "the of and to in a is that it was for on with as be at by this from or are an not have had his her they you we which their has will but all can been were there "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "le la les de des et en un une du dans qui que est pour il par sur pas plus au avec ce ne se sont aux cette ou son sa être ont mais comme "
    "el los las y que en un por con no una su para al lo del se es más como pero sus o este sí ha ser".split()
)
LONG, SHORT, STOP_SHARE, LINK_SHARE = 20, 8, 0.08, 0.5
RIGHTS = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.I)


@dataclass
class Block:
    tag: str
    article: bool
    named: bool  # within an element whose class, id or role names furniture
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(htmllib.unescape("".join(self.parts)).split())


def furniture(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is furniture by its tag or hidden, and whether its class, id or role says so."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True, False
    if not attributes or tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False, False
    named = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
        if name == "role" and value in ROLES:
            named = True
        if name in ("class", "id"):
            parts = re.split(r"[^a-z]+", value)
            named |= bool(NAMES.intersection(parts)) or "header" in parts and not inside and not {"article", "post", "entry", "story"}.intersection(parts)
    return False, named


def blocks_of(page: str) -> list[Block]:
    """The page's blocks outside of furniture, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture from here on, named so from here on
    open_tags: Counter[str] = Counter()
    owners: list[str] = []  # block tags of the stack
    skipping = links = doubts = 0
    inside = 0
    block: Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal block
        if skipping or not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(owners[-1] if owners else "", bool(inside), bool(doubts))
            out.append(block)
        block.parts.append(text)
        if links:
            block.linked += len(text.split())

    def pop() -> str:
        nonlocal skipping, links, doubts, inside, block
        tag, gone, named = stack.pop()
        open_tags[tag] -= 1
        skipping -= gone
        doubts -= named
        links -= tag == "a"
        inside -= tag in ("article", "main")
        if tag in BLOCK:
            owners.pop()
            block = None
        return tag

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        slash, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if slash:
            if tag in VOID:
                if tag == "br":
                    add(" ")
                continue
            if open_tags[tag]:
                while pop() != tag:
                    pass
            elif tag in BLOCK:
                block = None
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                block = None
            continue
        if tag in BLOCK:
            if open_tags["p"]:
                # A paragraph ends at a block, unless something between gives it a scope of its own.
                k = len(stack) - 1
                while stack[k][0] != "p" and stack[k][0] not in PARAGRAPH_SCOPE:
                    k -= 1
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
            closes = CLOSES.get(tag)
            if closes:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closes:
                        while len(stack) > k:
                            pop()
                        if tag != "tr" or stack and stack[-1][0] not in closes:
                            break
                    elif stack[k][0] in SCOPE:
                        break
            block = None
        if rest.endswith("/"):
            continue
        if tag == "body":
            while open_tags["head"]:
                pop()
        gone, named = furniture(tag, rest, inside > 0)
        stack.append((tag, gone, named))
        open_tags[tag] += 1
        if tag in BLOCK:
            owners.append(tag)
        skipping += gone
        doubts += named
        links += tag == "a"
        inside += tag in ("article", "main")
    return out


def label(words: list[str], linked: int, text: str, article: bool = False) -> tuple[bool | None, str]:
    """Pass one: content, furniture, or open; and the rule that says so."""
    n = len(words)
    stops = sum(w.strip(".,;:!?\"'()").lower() in STOPS for w in words) / n
    if linked > LINK_SHARE * n and not (n >= LONG and stops >= STOP_SHARE and linked < n):
        return False, "links"
    if n < LONG and not article and RIGHTS.search(text):
        return False, "rights"
    if n >= LONG and stops >= STOP_SHARE:
        return True, "stop words"
    if n >= 3 * LONG:
        return True, "length"
    if n >= SHORT and stops >= 2 * STOP_SHARE and text[-1:] in ".!?…\"”»":
        return True, "sentence"
    return None, "open"


def inherited(marks: list[bool | None], headings: list[bool]) -> list[bool | None]:
    """Pass two: an open block takes the label of the nearest decided one; content wins ties; a heading goes with what follows."""
    n = len(marks)
    before, after = [-1] * n, [n] * n
    for k in range(n):
        before[k] = k if marks[k] is not None else before[k - 1] if k else -1
    for k in range(n - 1, -1, -1):
        after[k] = k if marks[k] is not None else after[k + 1] if k + 1 < n else n
    out = list(marks)
    for k in range(n):
        if marks[k] is None:
            a, b = before[k], after[k]
            if b < n and (headings[k] or a < 0 or b - k < k - a):
                out[k] = marks[b]
            elif a >= 0 and (b == n or k - a < b - k):
                out[k] = marks[a]
            elif a >= 0:
                out[k] = marks[a] or marks[b]
    return out


def decided(page: str | None) -> list[tuple[str, bool, str]]:
    """(text, kept, rule) for each block of a page."""
    held = [(b, t) for b in blocks_of(page or "") if (t := b.text())]
    found = [label(t.split(), b.linked, t, b.article) for b, t in held]
    articles = any(b.article for b, _ in held)
    # What overrules the text's own label, and less and less of it where nothing would be left.
    for against in (lambda b: b.named or articles and not b.article, lambda b: articles and not b.article, lambda b: False):
        over = [against(b) for b, _ in held]
        marks = [None if no else mark for (mark, _), no in zip(found, over, strict=True)]
        # Blocks that are overruled take no part in what their neighbours inherit.
        inner = [k for k, no in enumerate(over) if not no]
        labels = inherited([marks[k] for k in inner], [held[k][0].tag in HEADINGS for k in inner])
        kept = [False] * len(held)
        for k, x in zip(inner, labels, strict=True):
            kept[k] = x is not False
        if any(kept):
            break
    return [(t, keep, "evidence" if no else "inherited" if rule == "open" else rule) for (_, t), keep, no, (_, rule) in zip(held, kept, over, found, strict=True)] if held else []


def main_text(page: str | None) -> str:
    """The main text: blocks joined by an empty line."""
    return "\n\n".join(t for t, keep, _ in decided(page) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, url, text, n_chars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
