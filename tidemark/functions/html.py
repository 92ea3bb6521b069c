"""Link targets in raw HTML, read as browsers do: whatever is malformed still means something."""

from __future__ import annotations

import html
from collections.abc import Iterator
from urllib.parse import urljoin

SPACES = " \t\n\r\f"
#: Elements whose content is text up to their own end tag.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")


def tags(page: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Start tags with their attributes, the first of a name. Comments, declarations, end tags and
    the content of ``RAW`` elements hold none. A tag that the page's end cuts off is none."""
    at, n = 0, len(page)
    while (at := page.find("<", at)) >= 0:
        nxt = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            # the shortest comments end in their own opening
            end = at + 4 if page.startswith((">", "->"), at + 4) else page.find("-->", at + 4)
            if end < 0:
                return
            at = page.find(">", end) + 1
        elif nxt in ("!", "?", "/"):
            end = page.find(">", at)
            if end < 0:
                return
            at = end + 1
        elif nxt.isascii() and nxt.isalpha():
            name, found, at = start_tag(page, at + 1, n)
            if at < 0:
                return
            yield name, found
            if name in RAW:
                at = end_of_raw(page, name, at)
        else:
            at += 1


def end_of_raw(page: str, name: str, at: int) -> int:
    low = "</" + name
    while (at := page.find("</", at)) >= 0:
        if page[at : at + len(low)].lower() == low and page[at + len(low) : at + len(low) + 1] in (*SPACES, "/", ">"):
            return at
        at += 2
    return len(page)


def start_tag(page: str, at: int, n: int) -> tuple[str, dict[str, str], int]:
    """The tag's name, its attributes and where the page goes on; -1 where it ends inside the tag."""
    begin = at
    while at < n and page[at] not in SPACES and page[at] not in "/>":
        at += 1
    name, found = page[begin:at].lower(), {}
    while True:
        while at < n and (page[at] in SPACES or page[at] == "/"):
            at += 1
        if at >= n:
            return name, found, -1
        if page[at] == ">":
            return name, found, at + 1
        begin = at
        at += 1  # an equals sign may begin a name
        while at < n and page[at] not in SPACES and page[at] not in "/>=":
            at += 1
        key = page[begin:at].lower()
        while at < n and page[at] in SPACES:
            at += 1
        value = ""
        if at < n and page[at] == "=":
            at += 1
            while at < n and page[at] in SPACES:
                at += 1
            if at < n and page[at] in "\"'":
                end = page.find(page[at], at + 1)
                if end < 0:
                    return name, found, -1
                value, at = page[at + 1 : end], end + 1
            else:
                begin = at
                while at < n and page[at] not in SPACES and page[at] != ">":
                    at += 1
                value = page[begin:at]
        found.setdefault(key, html.unescape(value))


def links(page: str, url: str) -> list[tuple[str, str | None]]:
    """(as written, resolved) for the target of each ``a`` and ``area`` in the page, in order. Targets are
    resolved against the page's first ``base`` and its URL; one that is no URL resolves to null."""
    base, out = url, []
    given = False
    for name, attributes in tags(page):
        if "href" not in attributes:
            continue
        href = attributes["href"].strip(SPACES)
        if name == "base" and not given:
            given, base = True, resolved(url, href) or url
        elif name in ("a", "area"):
            out.append((href, resolved(base, href)))
    return out


def resolved(base: str, href: str) -> str | None:
    try:
        return urljoin(base, "".join(c for c in href if c not in "\t\n\r"))
    except ValueError:
        return None
