"""Tags and texts of HTML without a parser for each row.

Most markup is regular: plain tags whose attributes are quoted, comments, one document type, closed scripts and styles.
Such markup is cut at its angle brackets, and each distinct tag is read once by a worker. Anything else, from a stray
bracket to a quote that isn't closed, is reported as irregular; callers then use the parser of the standard library,
whose results regular markup gives, too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

START, BOTH, END, TEXT, RAW = range(5)
_TAG = re.compile(r'(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+[A-Za-z][A-Za-z-]*(?:="[^"]*")?)*)[ \t\n\r\f]*(/?)')
_ATTRIBUTE = re.compile(r'([A-Za-z][A-Za-z-]*)(?:="([^"]*)")?')
_SKIPPED = re.compile(r"!--(?:[^>]*--)?|![Dd][Oo][Cc][Tt][Yy][Pp][Ee][^>]*")
_REFERENCE = re.compile(r"&(?!(?:[A-Za-z][-.A-Za-z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)")
#: Elements whose content is text up to their own end tag.
_CLOSED = {name: re.compile(rf"/[ \t\n\r\f]*{name}[ \t\n\r\f]*>", re.IGNORECASE) for name in ("script", "style")}
#: What a tag is, by its text: (kind, name in lower case), nothing for comments, False for irregular ones.
_KNOWN: dict[str, tuple[int, str] | None | bool] = {}
KNOWN = 50_000


def _read(tag: str) -> tuple[int, str] | None | bool:
    if tag[:1] == "!":
        # "<!-->" and "<!--->" are other comments than they seem
        return None if _SKIPPED.fullmatch(tag) and (not tag.startswith("!--") or len(tag) >= 5) else False
    found = _TAG.fullmatch(tag)
    if not found or (found[1] and (found[3] or found[4])):
        return False
    return (END if found[1] else BOTH if found[4] else START, found[2].lower())


def tokens(markup: str) -> list[tuple[int, str, str]] | None:
    """(kind, name, source) of the tags and texts in order; RAW is the text of scripts and styles. Nothing if it is irregular."""
    first, *rest = markup.split("<")
    out = [(TEXT, "", first)] if first else []
    if len(_KNOWN) > KNOWN:
        _KNOWN.clear()
    pieces = iter(rest)
    for piece in pieces:
        tag, bracket, text = piece.partition(">")
        if not bracket:
            return None
        known = _KNOWN.get(tag, 0)
        if known == 0:
            known = _KNOWN[tag] = _read(tag)
        if known is False:
            return None
        if known is not None:
            kind, name = known
            out.append((kind, name, tag))
            if kind == START and name in _CLOSED:
                inside = text
                for piece in pieces:
                    if end := _CLOSED[name].match(piece):
                        break
                    inside += "<" + piece
                else:
                    return None
                if inside:
                    out.append((RAW, "", inside))
                out.append((END, name, piece[: end.end() - 1]))
                text = piece[end.end() :]
        if text:
            out.append((TEXT, "", text))
    return out


def attribute(tag: str, name: str) -> str | None:
    """The last value of an attribute of a regular tag."""
    found = None
    for key, value in _ATTRIBUTE.findall(tag, re.match(r"[A-Za-z0-9]*", tag).end()):
        if key.lower() == name:
            found = html.unescape(value)
    return found


def referenced(text: str) -> bool:
    """Whether each ampersand begins a reference that ends with a semicolon."""
    return "&" not in text or not _REFERENCE.search(text)


def texts(found: list[tuple[int, str, str]], drop: frozenset[str]) -> Iterator[str]:
    """The texts outside the elements to drop, references resolved; alternative texts of images count as text."""
    depth = 0
    for kind, name, source in found:
        if kind == TEXT:
            if not depth:
                yield html.unescape(source) if "&" in source else source
        elif kind == RAW:
            if not depth:
                yield source
        elif name in drop:
            if kind == START:
                depth += 1
            elif kind == END and depth:
                depth -= 1
        elif name == "img" and kind != END and not depth and (alt := attribute(source, "alt")):
            yield f" {alt} "
