"""HTML as a stream of tokens with roles: start and end tags of a closed tree, and the texts between.

A token's role is a 64-bit number of its path: the elements around it, each with its class, id and
role words (digits count as one sign). Containers that look alike under one parent are told apart by
their number there, up to ALIKE; so a page laid out in bare boxes still has roles. End tags that HTML implies, and those missing at the end of
a page, are put in, so starts and ends always pair up.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from xxhash import xxh64_intdigest

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[^a-z]+")

# HTML's own lists of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label link mark meta meter q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
CONTAINERS = frozenset("div section table ul ol dl fieldset form details".split())
ALIKE = 8
P_SCOPE = frozenset("button td th caption table object".split())

# Labels of what an element is for.
BESIDE_TAGS = frozenset("nav footer aside form button select menu dialog svg head template object canvas audio video".split())
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement banner promo promotion sponsor sponsored sidebar side aside menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription popup modal overlay comment comments respond reply replies discussion disqus share sharing social related "
    "recommended recommendations widget widgets pager pagination login signup search copyright contentinfo complementary".split()
)
SPARING = frozenset("with has no without is".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("articlebody main".split())
NOT_ARTICLE = frozenset("ad advert comment comments reply related promo sponsored".split())

START, END, TEXT, BREAK = range(4)
MAIN, ASIDE, HINTED, LINK, HEADER = 1, 2, 4, 8, 16


class Token(NamedTuple):
    kind: int
    role: int  # of the tag; for a text the path it stands in
    flags: int  # of the path the token leaves the reader in
    text: str  # a text as written; the name of a tag


def _set_apart(names: str, tag: str) -> bool:
    """The element's names say that it stands beside the main text."""
    for name in names.split():
        if tag == "article":
            if name in NOT_ARTICLE:
                return True
            continue
        parts = [p for p in PARTS.split(name) if p]
        if parts and not SPARING.intersection(parts) and (parts[0] in BESIDE or parts[-1] in BESIDE):
            return True
    return False


@lru_cache(maxsize=100_000)
def _element(parent: int, flags: int, tag: str, names: str, hidden: bool, number: int) -> tuple[int, int]:
    """Role and flags of an element."""
    role = xxh64_intdigest(f"{tag} {number} {names}", parent)
    if tag in BESIDE_TAGS:
        flags |= ASIDE
    if tag in MAIN_TAGS or MAIN_WORDS.intersection(names.split()):
        flags |= MAIN
    if tag == "header" and not flags & MAIN:
        flags |= HEADER
    if tag == "a":
        flags |= LINK
    if tag not in ("html", "body", "main") and (hidden or names and _set_apart(names, tag)):
        flags |= HINTED
    return role, flags


def _named(attributes: str) -> tuple[str, bool]:
    if "=" not in attributes:
        return "", "hidden" in attributes.lower().split()
    found = NAMES.findall(attributes)
    names = " ".join(sorted({w for f in found for w in DIGITS.sub("#", "".join(f).lower()).split()})) if found else ""
    return names, bool(HIDDEN.search(attributes))


def _plain_link(tag: str, attributes: str) -> bool:
    """<a href="..">, by far the commonest tag with an attribute, names nothing."""
    return tag == "a" and attributes.count("=") == 1 and attributes.startswith(' href="') and attributes.endswith('"')


def tokens(html: str) -> list[Token]:
    """The page's tokens in order. Scripts, styles, titles and the like, comments and markup are left out."""
    made: list[Token] = []
    stack: list[tuple[str, int, int, dict]] = [("", 0, 0, {})]

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            tag, role, *_ = stack.pop()
            made.append(Token(END, role ^ 1, stack[-1][2], tag))

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        while start >= 0 and not (found := TAG.match(html, start)):
            start = html.find("<", start + 1)
        if start != at:
            made.append(Token(TEXT, stack[-1][1], stack[-1][2], html[at:start] if start > 0 else html[at:]))
        if start < 0:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            depth = len(stack) - 1 if stack[-1][0] == tag else next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                close(depth)
            elif tag in ("br", "p"):
                made.append(Token(BREAK, 0, stack[-1][2], tag))
            continue
        if tag in ENDS_P or tag in CLOSES:
            shut, scope = CLOSES.get(tag, ((), ()))
            if tag in ENDS_P:
                shut, scope = {"p"}, P_SCOPE
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in scope:
                    break
                if stack[k][0] in shut:
                    close(k)
                    break
        if tag in VOID:
            if tag not in INLINE:
                made.append(Token(BREAK, 0, stack[-1][2], tag))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else size
            continue
        names, hidden = ("", False) if not found[3] or _plain_link(tag, found[3]) else _named(found[3])
        number = 0
        if tag in CONTAINERS:
            alike = stack[-1][3]
            number = alike[tag, names] = min(alike.get((tag, names), 0) + 1, ALIKE)
        role, flags = _element(stack[-1][1], stack[-1][2], tag, names, hidden, number)
        if found[3].endswith("/") and flags & ASIDE and tag not in ("nav", "footer", "aside", "form"):
            continue  # a drawing that closes itself
        stack.append((tag, role, flags, {}))
        made.append(Token(START, role, flags, tag))
    close(1)
    return made
