"""A CommonMark scanner for what the engine needs: headings, links and where text may be cut.

Blocks are found line by line with a stack of containers (quotes and list
items); leaf blocks are fences, indented code, HTML, headings of both kinds,
breaks and paragraphs.  Inline scanning knows code spans, escapes, raw HTML,
autolinks, links, images and wiki links.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_fence = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_atx = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_setext = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_break = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_bullet = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_quote = re.compile(r" {0,3}> ?")
# The block-level names that open an HTML block.
HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol "
    "optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_html_raw = re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.I)
_html_raw_end = re.compile(r"</(?:script|pre|style|textarea)>", re.I)
_html_block = re.compile(rf" {{0,3}}</?(?:{'|'.join(HTML_NAMES)})(?:[ \t]|/?>|$)", re.I)
_attributes = r"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*"
_tag = re.compile(rf"<(?:[A-Za-z][A-Za-z0-9-]*{_attributes}\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*|!--.*?--|\?.*?\?|![A-Za-z][^>]*|!\[CDATA\[.*?\]\])>", re.S)
_html_any = re.compile(rf" {{0,3}}<(?:[A-Za-z][A-Za-z0-9-]*{_attributes}\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>[ \t]*$")
_autolink = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
_punctuation = re.compile(r"\\([!-/:-@\[-`{-~])")
_reference = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$", re.M)


@dataclass
class Block:
    """A leaf block: kind, its lines' text, and the range of the source it covers."""

    kind: str
    start: int
    end: int
    text: str = ""
    level: int = 0


@dataclass
class _Item:
    indent: int  # columns a line needs to belong to a list item; -1: a quote
    blank: bool = False


@dataclass
class _Open:
    kind: str
    start: int
    lines: list[str] = field(default_factory=list)
    end: int = 0
    mark: str = ""
    closing: re.Pattern | None = None


def _columns(line: str) -> int:
    """Columns of leading white space; a tab reaches the next multiple of four."""
    n = 0
    for ch in line:
        if ch == " ":
            n += 1
        elif ch == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _strip(line: str, columns: int) -> str:
    """The line without so many columns of leading white space."""
    n = 0
    for i, ch in enumerate(line):
        if n >= columns or ch not in " \t":
            return " " * (n - columns) + line[i:] if n > columns else line[i:]
        n += 1 if ch == " " else 4 - n % 4
    return " " * max(0, n - columns)


def scan(text: str) -> list[Block]:
    """The leaf blocks of a text in order."""
    out: list[Block] = []
    stack: list[_Item] = []
    open_: _Open | None = None
    at = 0

    def close() -> None:
        nonlocal open_
        if open_ is not None:
            out.append(Block(open_.kind, open_.start, open_.end, "\n".join(open_.lines)))
            open_ = None

    for raw in re.findall(r"[^\n]*\n|[^\n]+", text):
        start, at = at, at + len(raw)
        line = raw.rstrip("\r\n")
        end = start + len(line)
        rest, matched = line, 0
        for item in stack:  # how far the line continues the open containers
            if item.indent < 0:
                m = _quote.match(rest)
                if not m:
                    break
                rest = rest[m.end() :]
            elif not rest.strip():
                pass
            elif _columns(rest) >= item.indent:
                rest = _strip(rest, item.indent)
            else:
                break
            matched += 1
        blank = not rest.strip()
        if open_ and open_.kind in ("fence", "html", "code") and matched == len(stack):
            if open_.kind == "fence":
                m = _fence.match(rest)
                open_.end = end
                if m and m.group(1)[0] == open_.mark[0] and len(m.group(1)) >= len(open_.mark) and not m.group(2).strip():
                    close()
                else:
                    open_.lines.append(rest)
                continue
            if open_.kind == "html":
                if open_.closing is None and blank:
                    close()
                else:
                    open_.lines.append(rest)
                    open_.end = end
                    if open_.closing is not None and open_.closing.search(rest):
                        close()
                    continue
            elif blank or _columns(rest) >= 4:
                open_.lines.append(_strip(rest, 4))
                if not blank:
                    open_.end = end
                continue
            else:
                close()
        if matched < len(stack):
            starts = blank or _fence.match(rest) or _atx.match(rest) or _break.match(rest) or _quote.match(rest) or _bullet.match(rest) or _html_start(rest, True)
            if open_ and open_.kind == "paragraph" and not starts:  # a lazy line
                open_.lines.append(rest.strip())
                open_.end = end
                continue
            close()
            del stack[matched:]
        # new containers
        while not blank and _columns(rest) < 4 and not (open_ and open_.kind not in ("paragraph",)):
            m = _quote.match(rest)
            if m:
                close()
                stack.append(_Item(-1))
                rest = rest[m.end() :]
                blank = not rest.strip()
                continue
            m = _bullet.match(rest)
            if m and not _break.match(rest):
                after = rest[m.end() :]
                empty = not after.strip()
                if open_ and (empty or (m.group(2)[:-1].isdigit() and m.group(2)[:-1] != "1")):
                    break  # such an item cannot interrupt a paragraph
                close()
                pad = _columns(after)
                width = len(m.group(1)) + len(m.group(2))
                inner = 1 if empty or pad > 4 else pad
                stack.append(_Item(width + inner))
                rest = "" if empty else _strip(after, inner)
                blank = not rest.strip()
                continue
            break
        if blank:
            if open_ and open_.kind == "paragraph":
                close()
            continue
        paragraph = open_ is not None and open_.kind == "paragraph"
        own = end - len(rest.lstrip())
        if not paragraph and _columns(rest) >= 4:
            close()
            open_ = _Open("code", own, [_strip(rest, 4)], end)
            continue
        m = _fence.match(rest)
        if m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
            close()
            open_ = _Open("fence", own, [], end, m.group(1))
            continue
        m = _atx.match(rest)
        if m:
            close()
            title = (m.group(2) or "").strip()
            out.append(Block("heading", own, end, "" if re.fullmatch("#+", title) else title, len(m.group(1))))
            continue
        m = _setext.match(rest)
        if m and paragraph and matched == len(stack):
            body = "\n".join(open_.lines)
            remaining = _reference.sub("", body).strip()
            if remaining:
                out.append(Block("heading", open_.start, end, remaining, 1 if m.group(1)[0] == "=" else 2))
                open_ = None
                continue
        if _break.match(rest):
            close()
            out.append(Block("break", own, end, rest))
            continue
        closing = _html_start(rest, paragraph)
        if closing:
            close()
            open_ = _Open("html", own, [rest], end, "", closing if isinstance(closing, re.Pattern) else None)
            if open_.closing is not None and open_.closing.search(rest):
                close()
            continue
        if paragraph:
            open_.lines.append(rest.strip())
            open_.end = end
        else:
            close()
            open_ = _Open("paragraph", own, [rest.strip()], end)
    close()
    return out


def _html_start(line: str, in_paragraph: bool) -> re.Pattern | bool:
    """What ends an HTML block that this line opens: a pattern, or True for a blank line."""
    bare = line.lstrip(" ")
    if not bare.startswith("<") or _columns(line) > 3:
        return False
    if _html_raw.match(line):
        return _html_raw_end
    for opening, ending in (("<!--", "-->"), ("<?", r"\?>"), ("<![CDATA[", r"\]\]>")):
        if bare.startswith(opening):
            return re.compile(ending)
    if re.match(r"<![A-Za-z]", bare):
        return re.compile(">")
    return bool(_html_block.match(line) or (not in_paragraph and _html_any.match(line)))


def references(text: str) -> dict[str, str]:
    """Link reference definitions, by folded label; the first counts."""
    out: dict[str, str] = {}
    for block in scan(text):
        if block.kind == "paragraph":
            for m in _reference.finditer(block.text):
                out.setdefault(" ".join(m.group(1).split()).casefold(), unescape(m.group(2).strip("<>")))
    return out


def unescape(text: str) -> str:
    return html.unescape(_punctuation.sub(r"\1", text))


def _destination(text: str, at: int) -> tuple[str, int] | None:
    """A link's destination from just inside its parenthesis, and the place after the closing one."""
    m = re.compile(r"\s*").match(text, at)
    at = m.end()
    if text[at : at + 1] == "<":
        m = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(text, at)
        if not m:
            return None
        target, at = m.group(1), m.end()
    else:
        start, depth = at, 0
        while at < len(text) and not text[at].isspace():
            if text[at] == "\\":
                at += 1
            elif text[at] == "(":
                depth += 1
            elif text[at] == ")":
                if not depth:
                    break
                depth -= 1
            at += 1
        target = text[start:at]
        if depth:
            return None
    m = re.compile(r"(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S).match(text, at)
    return (unescape(target), m.end()) if m else None


@dataclass
class Inline:
    """A piece of inline content: text, code or link (with its target); links come before their text."""

    kind: str
    text: str
    wiki: bool = False


def inlines(text: str, known: dict[str, str] | None = None, wiki: bool = False) -> list[Inline]:
    known = known or {}
    out: list[Inline] = []
    buffer: list[str] = []
    brackets: list[tuple[int, int, bool, bool]] = []  # place in out, place in text, image, active

    def flush() -> None:
        if buffer:
            out.append(Inline("text", html.unescape("".join(buffer))))
            buffer.clear()

    at = 0
    while at < len(text):
        ch = text[at]
        if ch == "\\" and re.match(_punctuation, text[at : at + 2]):
            flush()
            out.append(Inline("text", text[at + 1]))
            at += 2
        elif ch == "`":
            run = re.compile("`+").match(text, at).group()
            m = re.compile(rf"(?<!`){run}(?!`)").search(text, at + len(run))
            if m:
                flush()
                code = text[at + len(run) : m.start()].replace("\n", " ")
                if code.strip() and code[0] == code[-1] == " ":
                    code = code[1:-1]
                out.append(Inline("code", code))
                at = m.end()
            else:
                buffer.append(run)
                at += len(run)
        elif ch == "<" and (m := _autolink.match(text, at)):
            flush()
            out += [Inline("link", m.group(1)), Inline("text", m.group(1))]
            at = m.end()
        elif ch == "<" and (m := _tag.match(text, at)):
            flush()
            at = m.end()
        elif wiki and text.startswith("[[", at) and (m := re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]").match(text, at)):
            flush()
            out += [Inline("link", m.group(1), True), Inline("text", m.group(2) or m.group(1))]
            at = m.end()
        elif ch == "[" or text.startswith("![", at):
            flush()
            image = ch == "!"
            brackets.append((len(out), at + 1 + image, image, True))
            at += 1 + image
        elif ch == "]" and brackets:
            flush()
            place, start, image, active = brackets.pop()
            found = None
            if active:
                if text[at + 1 : at + 2] == "(":
                    found = _destination(text, at + 2)
                if found is None:
                    m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, at + 1)
                    label = m.group(1) if m and m.group(1).strip() else text[start:at]
                    target = known.get(" ".join(label.split()).casefold())
                    if target is not None:
                        found = (target, m.end() if m else at + 1)
            if found is None:
                out.insert(place, Inline("text", "![" if image else "["))
                buffer.append("]")
                at += 1
            else:
                if not image:
                    out.insert(place, Inline("link", found[0]))
                    brackets = [(p, s, i, a and i) for p, s, i, a in brackets]  # links do not nest
                at = found[1]
        elif ch == "\n":
            flush()
            at += 1
        else:
            m = re.compile(r"[^\\`<\[\]!\n]+|[\s\S]").match(text, at)
            buffer.append(m.group())
            at = m.end()
    flush()
    for place, _, image, _ in reversed(brackets):
        out.insert(place, Inline("text", "![" if image else "["))
    return _without_emphasis(out)


_emphasis = re.compile(r"(?<![\w*])(\*{1,3})(?=[^\s*])(.+?)(?<=[^\s*])\1(?!\*)|(?<![\w_])(_{1,3})(?=[^\s_])(.+?)(?<=[^\s_])\3(?![\w_])")


def _without_emphasis(parts: list[Inline]) -> list[Inline]:
    for p in parts:
        if p.kind == "text" and ("*" in p.text or "_" in p.text):
            previous = None
            while previous != p.text:
                previous = p.text
                p.text = _emphasis.sub(lambda m: m.group(2) if m.group(1) else m.group(4), p.text)
    return parts


def plain(text: str, known: dict[str, str] | None = None) -> str:
    """The text and code of inline content, joined."""
    return "".join(p.text for p in inlines(text, known) if p.kind != "link")
