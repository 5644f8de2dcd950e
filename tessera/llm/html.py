"""Pages as trees of labelled blocks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from html import unescape

#: Element names of HTML by what they do here.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SILENT = RAW | frozenset("head svg math canvas audio video object select datalist button".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog label".split())
#: Words in class, id and role that name what is not the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar aside footer breadcrumb breadcrumbs comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations teaser widget widgets pagination pager copyright complementary contentinfo dialog masthead topbar toolbar hidden".split()
)
#: Longer ones count inside a word too, as in postComments or cookieBar.
NOISE_STEMS = ("sidebar", "advert", "cookie", "newsletter", "breadcrumb", "sponsor", "paywall", "disclaimer")
NOISE_ENDS = ("comment", "comments", "banner", "popup", "navbar", "footer")
#: What is noise outside the article only: an article may have a header of its own.
OUTER_TAGS, OUTER_WORDS = frozenset(["header"]), frozenset(["header", "head", "top"])
#: An element's start ends open ones of these names, up to one of the bounds.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_DIGITS = re.compile(r"[^a-z]+")


@dataclass
class Node:
    label: str
    parent: int
    key: int  # hash of the labels from the root
    noise: bool  # named as noise itself or inside of what is
    article: bool
    named: bool  # itself named as noise


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]  # node, text


def _key(parent: int, label: str) -> int:
    data = f"{parent} {label}".encode()
    return zlib.crc32(data) << 31 | zlib.crc32(data[::-1]) >> 1


def parse(html: str) -> Page:
    """The page's nodes (block elements and those named as noise) and its texts in order. Comments, scripts, styles and
    form controls have no text; a block's white space is one space; br is white space."""
    nodes = [Node("", -1, 0, False, False, False)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # element, node
    opened: Counter[str] = Counter()  # elements of the stack, so that what isn't there is not looked for
    pending: list[tuple[int, str]] = []
    silent = 0

    def flush() -> None:
        texts: dict[int, list[str]] = {}
        for n, t in pending:
            texts.setdefault(n, []).append(t)
        for n, parts in texts.items():
            if text := " ".join("".join(parts).split()):
                blocks.append((n, text))
        pending.clear()

    def close(to: int) -> None:
        nonlocal silent
        for tag, _ in stack[to:]:
            silent -= tag in SILENT
            opened[tag] -= 1
        del stack[to:]

    def end_open(names: set[str], bounds: set[str]) -> None:
        if not any(opened[x] for x in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                close(i)
                return
            if stack[i][0] in bounds:
                return

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if not silent and (text := html[at : m.start() if m else len(html)]):
            pending.append((stack[-1][1] if stack else 0, unescape(text) if "&" in text else text))
        if not m:
            break
        at = m.end()
        if m[1] is not None and not silent:
            pending.append((stack[-1][1] if stack else 0, m[1]))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            for i in () if not opened[tag] else range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in BLOCKS:
                        flush()
                        close(i)
                    elif any(t in BLOCKS for t, _ in stack[i + 1 :]):
                        silent -= tag in SILENT
                        opened[tag] -= 1
                        del stack[i]  # an inline element that ends beyond a block's start
                    else:
                        close(i)
                    break
            continue
        if tag in BLOCKS:
            flush()
            if tag in IMPLIED:
                end_open(*IMPLIED[tag])
            end_open({"p"}, {"table", "td", "th", "li", "div", "section", "article", "body"} if tag != "p" else {"table", "td", "th"})
        elif tag == "br":
            pending.append((stack[-1][1] if stack else 0, " "))
        if tag in VOID:
            continue
        parent = stack[-1][1] if stack else 0
        given = {a.lower(): (x or y or z) for a, x, y, z in _ATTRIBUTE.findall(m[4])} if m[4].strip(" /") else {}
        names = [w for a in ("class", "id", "role") for w in _DIGITS.sub(" ", given.get(a, "").lower()).split()]
        up = nodes[parent]
        inside = up.article or tag in ("article", "main") or given.get("role", "").lower() in ("main", "article")
        own = tag in NOISE_TAGS or not NOISE_WORDS.isdisjoint(names) or any(w.endswith(NOISE_ENDS) or any(x in w for x in NOISE_STEMS) for w in names) or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        own = own or not up.article and (tag in OUTER_TAGS or tag not in ("body", "html", "main", "article") and not OUTER_WORDS.isdisjoint(names))
        own = own and tag not in ("html", "body")
        node = parent
        if tag in BLOCKS or own:
            label = " ".join([tag, *sorted(set(names))])
            nodes.append(Node(label, parent, _key(up.key, label), up.noise or own, inside, own))
            node = len(nodes) - 1
        stack.append((tag, node))
        opened[tag] += 1
        silent += tag in SILENT
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = end.start() if end else len(html)
    flush()
    return Page(nodes, blocks)
