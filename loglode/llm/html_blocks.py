"""The text blocks of a page in order, each with the elements around it."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

# Elements of the HTML standard by how they lay out text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of the second begins.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}

#: Elements whose inside is no text.
RAW = frozenset("script style template noscript".split())
#: Of the elements around a block its path names the outermost and the innermost ones, and of each the first words.
LEVELS, NAMES_EACH = 32, 16

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_RAW_END = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in RAW}
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    path: tuple[str, ...]  # of each open element its name and the words of its class, id and role
    text: str
    linked: int  # characters inside links


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): texts, opening and closing tags in order; comments and the inside of RAW elements left out.

    The page is read once from left to right. A tag ends at the first > outside quotes; where quotes leave a tag without
    an end, they count for nothing from there on. What the end of the page cuts off is dropped.
    """
    at, quotes, size = 0, True, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark != at:
            yield "text", "", page[at : mark if mark >= 0 else size]
            at = mark if mark >= 0 else size
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        tag = _OPEN.match(page, at)
        if tag is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
            yield "text", "", "<"
            at += 1
            continue
        start = tag.end() if tag else at + 1
        whole = _QUOTED.match(page, start) if tag and quotes else None
        if whole:
            end = whole.end()
        else:
            quotes = quotes and tag is None
            end = page.find(">", start) + 1
            if not end:
                return
        at = end
        if tag:
            name = tag[2].lower()
            if name in RAW and not tag[1]:
                close = _RAW_END[name].search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else size
            else:
                yield ("end" if tag[1] else "start"), name, page[start : end - 1]


def blocks(page: str | None) -> list[Block]:
    """Texts between the bounds of block elements: references decoded, white space as one space, empty ones left out.

    Comments, scripts, styles and tags are no text; an element left open ends with its parent, a tag cut off by the end
    of the page is dropped. Classes of the html and body elements tell of the page, not of a part, and are left out. The
    time grows with the length of the page, whatever its markup.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked, link = 0, 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                around = stack if len(stack) <= 2 * LEVELS else stack[:LEVELS] + stack[-LEVELS:]
                out.append(Block(tuple(w for _, words in around for w in words), text, linked))
            pieces.clear()
        linked = 0

    for kind, tag, rest in tokens(page or ""):
        if kind == "text":
            pieces.append(rest)
            linked += len(rest) if link else 0
            continue
        if tag in INLINE:
            if tag == "a":
                link = int(kind == "start")
            elif tag == "br":
                pieces.append("\n")
            continue
        close()
        link = 0
        if kind == "end":
            while opened[tag]:
                name, _ = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
        elif tag not in VOID:
            while stack and tag in ENDED_BY.get(stack[-1][0], ()):
                opened[stack.pop()[0]] -= 1
            words = [tag]
            for name in _NAMES.finditer(rest) if tag not in ("html", "body") else ():
                words += _PART.findall((name[2] or name[3] or name[4] or "").lower())
            stack.append((tag, tuple(words[: NAMES_EACH + 1])))
            opened[tag] += 1
    close()
    return out
