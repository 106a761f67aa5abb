"""A conservative Markdown formatter: list markers, trailing space, blank lines, the last newline.

The header and everything inside code, HTML and other verbatim blocks stays as
it is.  Formatting twice changes nothing more.
"""

from __future__ import annotations

import re

from . import blocks
from .frontmatter import BOM

_item = re.compile(r"^(\s*)([-+*])( {2,4})(?=\S)")


class Unformattable(ValueError):
    """A text whose header does not end."""


def _prefix(source: str) -> int:
    """Where the body starts: after the header and the blank lines that follow it."""
    if not (source.lstrip(BOM).startswith("---\n") or source.startswith("---\r\n")):
        return 0
    at = 0
    for n, line in enumerate(source.splitlines(keepends=True)):
        at += len(line)
        if n and line.rstrip("\r\n") == "---":
            while source[at : at + 1] in ("\n", "\r"):
                at += 1
            return at
    raise Unformattable("unterminated frontmatter")


def format_markdown(source: str) -> str | None:
    """The formatted text, or None if it is formatted already."""
    start = _prefix(source)
    body = source[start:].replace("\r\n", "\n")
    # verbatim blocks by whole lines, in order; walked once beside the lines
    kept = sorted((body.rfind("\n", 0, b.start) + 1, b.end) for b in blocks.scan(body) if b.kind in ("fence", "code", "html"))
    out: list[str] = []
    at, blank, now = 0, True, 0
    for line in body.split("\n"):
        while now < len(kept) and kept[now][1] <= at:
            now += 1
        inside = now < len(kept) and kept[now][0] <= at
        at += len(line) + 1
        if inside:
            out.append(line)
            blank = False
            continue
        hard = re.search(r"\S {2,}$", line) is not None
        text = line.rstrip() + ("  " if hard and at <= len(body) and body[at : at + 1] not in ("", "\n") else "")
        text = _item.sub(lambda m: f"{m.group(1)}- " if m.group(2) == "-" else f"{m.group(1)}{m.group(2)} ", text)
        if not text.strip():
            if not blank:
                out.append("")
            blank = True
        else:
            out.append(text)
            blank = False
    result = "\n".join(out).rstrip("\n")
    result = source[:start] + (result + "\n" if result.strip() else "")
    return None if result == source or not source[start:].strip() else result
