"""Tags of a page, read forward once: whatever a page leaves open, no part of it is read again and again."""

from __future__ import annotations

import re
from typing import NamedTuple

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"(?i)</{tag}\s*>") for tag in ("script", "style")}


class Tag(NamedTuple):
    start: int
    end: int
    name: str           # lower case; empty for comments, declarations, scripts and styles, which are read with their content
    closing: bool
    attributes: str


def next_tag(html: str, at: int) -> Tag | None:
    """The next tag or other markup from ``at`` on; None if the rest is text.

    A comment ends with ``-->`` or ``--!>``; ``<!-->`` and ``<!--->`` are empty ones; without an end it goes on to the
    end of the page, like a script or style.  A ``>`` inside a quoted value (behind ``=``) doesn't end a tag; a quote
    that never closes is an ordinary character.  A ``<`` that begins no markup is text.
    """
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            for empty in ("<!-->", "<!--->"):
                if html.startswith(empty, start):
                    return Tag(start, start + len(empty), "", False, "")
            end = _COMMENT_END.search(html, start + 4)
            return Tag(start, end.end() if end else len(html), "", False, "")
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            return Tag(start, end + 1, "", False, "") if end >= 0 else None
        found = _NAME.match(html, start)
        if found is None:
            at = start + 1
            continue
        end = _tag_end(html, found.end())
        if end < 0:
            return None
        name, attributes = found[2].lower(), html[found.end():end - 1]
        if name in _RAW_END and not found[1]:
            close = _RAW_END[name].search(html, end)
            return Tag(start, close.end() if close else len(html), "", False, "")
        return Tag(start, end, name, bool(found[1]), attributes)
    return None


def _tag_end(html: str, at: int) -> int:
    """Behind the ``>`` of a tag whose name ends at ``at``; -1 without one."""
    low = at
    while stop := _STOP.search(html, at):
        at = stop.end()
        if stop[0] == ">":
            return at
        before = stop.start() - 1
        while before >= low and html[before].isspace():
            before -= 1
        low = stop.start()
        if before >= 0 and html[before] == "=":
            close = html.find(stop[0], at)
            if close >= 0:
                at = low = close + 1
    return -1
