"""Blocks of HTML pages: a tolerant parser that keeps what extraction needs of a page's tree.

Nodes are elements that form blocks, and others that have a class, id or role.  Texts are segments of blocks: what stands in a block without an element in between that
forms a block itself.  The rules for tags left open or closed twice follow the HTML standard where they change which block a text is in.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an element of these holds is raw text up to its end tag; only that of xmp is shown.
RAW = frozenset("script style iframe noembed noframes noscript title textarea xmp".split())
#: What isn't text of the page.
HIDDEN = frozenset("head template svg math object canvas audio video select datalist button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var".split())
#: Other elements end an open head.
IN_HEAD = frozenset("html head title meta link script style base noscript template".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements beyond which no end tag reaches.
WALLS = frozenset("table td th caption object template button".split())
#: An element ends the open ones of the second set, up to one of the third.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: Elements that are open at a time; deeper ones lie side by side.
DEEPEST = 400

_MARK = re.compile(r"<(?:(/?)([A-Za-z][^\s/>\x00]*)|(!--)|[!?/])")
_NAME = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?")
_VALUE = re.compile(r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([\"'])|([^\s>]*+))")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_KEPT = frozenset("class id role hidden aria-hidden style itemprop type".split())


@dataclass
class Page:
    """tag, parent and attributes of each node (0 is the page itself); and of each segment its node, its block, its text as it stands, and how much of it is in links."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[dict[str, str] | None] = field(default_factory=lambda: [None])
    nodes: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    #: Nodes, by number, that hold something to fill in.
    controls: list[int] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page()
    # open elements: tag, node, whether it forms a block, whether its text is shown
    stack: list[tuple[str, int, bool, bool]] = [("html", 0, True, True)]
    open_: dict[str, int] = {}
    block, held, in_links = 0, [], 0

    def flush() -> None:
        nonlocal in_links
        if held:
            text = "".join(held)
            if not text.isspace():
                page.nodes.append(stack[-1][1])
                page.blocks.append(block)
                page.texts.append(text)
                page.linked.append(in_links)
            elif page.blocks and page.blocks[-1] == block:
                page.texts[-1] += " "
            held.clear()
        in_links = 0

    def pop(to: int) -> None:
        """Close what is open from this place of the stack on."""
        nonlocal block
        while len(stack) > to:
            tag, node, forms, _ = stack[-1]
            if forms or node != stack[-2][1]:
                flush()
            stack.pop()
            open_[tag] -= 1
            block += forms

    def close(tags: frozenset[str] | set[str], walls: frozenset[str] | set[str]) -> None:
        if any(open_.get(t) for t in tags):
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] in tags:
                    pop(at)
                    return
                if stack[at][0] in walls:
                    return

    at, end = 0, len(source)
    while at < end:
        mark = _MARK.search(source, at)
        to = mark.start() if mark else end
        if to > at and stack[-1][0] == "head" and not source[at:to].isspace():
            pop(len(stack) - 1)
        if to > at and stack[-1][3]:
            text = source[at:to]
            text = html.unescape(text) if "&" in text else text
            held.append(text)
            if open_.get("a"):
                in_links += len(text)
        if mark is None:
            break
        at = mark.end()
        name = mark[2]
        if name is None:
            if mark[3]:
                if source.startswith((">", "->"), at):
                    at = source.index(">", at) + 1
                    continue
                ended = _COMMENT_END.search(source, at)
            else:
                ended = re.compile(">").search(source, at)
            at = ended.end() if ended else end
            continue
        name = name.lower()
        attributes: dict[str, str] = {}
        while True:
            found = _NAME.match(source, at)
            at = found.end()
            if found[1] is None:
                break
            value = _VALUE.match(source, at)
            if value:
                at = value.end()
                if value[3]:
                    at = end
                    break
            key = found[1].lower()
            if key in _KEPT and key not in attributes:
                attributes[key] = (value[1] or value[2] or value[4] or "") if value else ""
        if at >= end:
            break
        at += 1
        if mark[1]:
            if name == "br":
                held.append(" ")
            elif name in HEADINGS:
                close(HEADINGS, WALLS)
            elif name in INLINE and open_.get(name):
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place][0] == name:
                        if any(s[2] for s in stack[place + 1 :]):
                            # a block that began inside stays open
                            del stack[place]
                            open_[name] -= 1
                        else:
                            pop(place)
                        break
            elif name not in ("html", "body") and open_.get(name):
                close({name}, WALLS - {name})
            continue
        if name not in IN_HEAD and open_.get("head"):
            close({"head"}, WALLS)
        if name in ("html", "body"):
            if page.attributes[0] is None and attributes:
                page.attributes[0] = attributes
            continue
        if name in ENDS_P and open_.get("p"):
            close({"p"}, WALLS)
        if name in HEADINGS and stack[-1][0] in HEADINGS:
            pop(len(stack) - 1)
        if name in SIBLINGS:
            close(*SIBLINGS[name])
        if name == "a" and open_.get("a"):
            close({"a"}, WALLS | ENDS_P)
        if name in VOID:
            if name == "br":
                held.append(" ")
            elif name == "hr":
                flush()
                block += 1
            elif name == "input":
                page.controls.append(stack[-1][1])
            continue
        if name in RAW:
            ended = _RAW_END[name].search(source, at)
            if name == "xmp" and stack[-1][3]:
                flush()
                block += 1
                held.append(source[at : ended.start() if ended else end])
                flush()
                block += 1
            if name == "textarea":
                page.controls.append(stack[-1][1])
            if ended is None:
                break
            at = ended.start()
            continue
        forms = name not in INLINE
        if forms:
            flush()
            block += 1
        node = stack[-1][1]
        if forms or attributes.keys() & {"class", "id", "role", "hidden"}:
            if not forms:
                flush()
            page.tags.append(name)
            page.parents.append(node)
            page.attributes.append(attributes or None)
            node = len(page.tags) - 1
        if name in ("select", "button"):
            page.controls.append(stack[-1][1])
        if len(stack) < DEEPEST:
            stack.append((name, node, forms, stack[-1][3] and name not in HIDDEN))
            open_[name] = open_.get(name, 0) + 1
    flush()
    return page


def joined(page: Page, keep: list[bool]) -> str:
    """The kept segments: white space inside a block is one space, blocks are trimmed and joined by one space in page order."""
    out, last = [], None
    for block, text, k in zip(page.blocks, page.texts, keep, strict=True):
        if k:
            if block == last:
                out[-1] += text
            else:
                out.append(text)
            last = block
    return " ".join(t for t in (" ".join(o.split()) for o in out) if t)
