"""Leaf blocks of HTML pages: runs of text between block elements, with their ancestors."""

import html
import re
from dataclasses import dataclass, field

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
#: Elements whose content is not read, and how deep elements nest before they become siblings, as in browsers.
_UNSEEN = frozenset("script style textarea title noscript template svg iframe select".split())
DEPTH = 512
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
#: Elements that end a run of text, and elements without an end tag.
BLOCK = frozenset(
    "html head body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article "
    "header footer nav aside main form fieldset legend blockquote pre figure figcaption address details summary hr "
    "center button dialog menu".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements a start tag ends, up to the nearest of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}


@dataclass(slots=True)
class Block:
    text: str
    tags: tuple[str, ...]  # from the outermost element to the innermost block element
    words: tuple[tuple[str, ...], ...]  # words of class, id and role of each of them
    linked: int  # characters inside links
    hidden: bool = False
    marks: dict = field(default_factory=dict)


def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    words, hidden = [], False
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            words += _PART.findall(value)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", ""):
            hidden = True
    return tuple(words), hidden


def _tags(page: str):
    """(start, end, closing, name, attributes) of every tag; name is empty for comments and elements that are not seen.

    One pass: a quote that is never closed makes every tag up to it end at its next ``>``, whatever its quotes say, so
    nothing is looked through twice.
    """
    at, lenient, unclosed = page.find("<"), -1, {}
    last = {c: page.rfind(c) for c in ">\"'"}
    while at >= 0:
        end = None
        found = _NAME.match(page, at + 1)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            end = len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at + 1) + 1 or len(page)
        if end is not None:
            yield at, end, "", "", ""
        elif found and last[">"] > at:
            name, head, end = found[2].lower(), found.end(), None
            if at > lenient:
                place = head
                while end is None:
                    stop = _STOP.search(page, place)
                    if not stop:
                        lenient = len(page)
                        break
                    if stop[0] == ">":
                        end = stop.start()
                    elif stop.start() >= last[stop[0]]:
                        lenient = stop.start()
                        break
                    else:
                        place = page.find(stop[0], stop.end()) + 1
            if end is None:
                end = page.find(">", head)
            if end >= 0:
                raw, end = page[head:end], end + 1
                if name in _UNSEEN and not found[1]:
                    end = _after(page, name, end, unclosed)
                    name = ""
                yield at, end, found[1], name, raw
        at = page.find("<", at + 1 if end is None or end < 0 else end)


def _after(page: str, name: str, start: int, unclosed: dict) -> int:
    """Where an element whose content is not read ends: behind its end tag, or with the page."""
    if name in unclosed:
        return len(page)
    found = re.compile(rf"</{name}\s*>", re.I).search(page, start)
    if not found:
        unclosed[name] = True
    return found.end() if found else len(page)


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; scripts, styles, comments and other unseen elements are left out.

    Malformed pages are read as browsers do in the common cases: a block element ends an open paragraph, list items
    and cells end their predecessors, an end tag closes what is open inside it and is ignored if nothing matches. An
    element within ``DEPTH`` others takes the place of the innermost of them. The time taken grows with the page's length.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple, bool]] = []  # tag, words, hidden
    texts: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            texts.clear()
            if text:
                blocks = [x for x in stack if x[0] in BLOCK]
                out.append(
                    Block(text, tuple(x[0] for x in blocks), tuple(x[1] for x in blocks), linked, any(x[2] for x in stack))
                )
        linked = 0

    def close(down_to: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[down_to:])
        del stack[down_to:]

    for start, end, closing, tag, raw in _tags(page):
        if start > at:
            piece = page[at:start]
            texts.append(piece)
            if links:
                linked += len(piece.strip())
        at = end
        if not tag:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(x[0] in BLOCK for x in stack[k:]):
                        flush()
                    close(k)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            ends, within = _ENDS.get(tag, ({"p"}, {"td", "th", "button", "table"}))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in within:
                    break
                if stack[k][0] in ends or stack[k][0] == "p":
                    close(k)
                    if tag not in _ENDS:
                        break
        if tag not in VOID and not raw.endswith("/"):
            words, hidden = _attributes(raw) if raw else ((), False)
            if len(stack) >= DEPTH:
                close(DEPTH - 1)
            stack.append((tag, words, hidden))
            links += tag == "a"
    if at < len(page):
        texts.append(page[at:])
    flush()
    return out
