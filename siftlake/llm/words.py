"""Words of a text as they are compared: letters and digits only."""

from __future__ import annotations

import html
import re
import unicodedata

#: Well-formed markup only: comments, declarations, and tags whose attributes have values or are HTML's that need none; any other ``<`` is punctuation.
_ATTRIBUTE = r"""\s+(?:[A-Za-z_:@][\w:.@-]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>`]+)|(?:allowfullscreen|async|autofocus|autoplay|checked|compact|controls|default|defer|disabled|hidden|ismap|itemscope|loop|multiple|muted|nomodule|noshade|novalidate|nowrap|open|readonly|required|reversed|selected)(?=[\s/>]))"""
_TAG = re.compile(rf"<(?:!--.*?--|!doctype\b[^<>]{{0,256}}|\?[A-Za-z][\w-]*(?:{_ATTRIBUTE})*\s*\?|/[A-Za-z][\w:.-]*\s*|[A-Za-z][\w:.-]*(?:{_ATTRIBUTE})*\s*/?)>", re.S | re.I)
_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|tbody|thead|h[1-6]|hr|pre|blockquote|section|article|dd|dt|dl)\b", re.I)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|(.))", re.S)
_WORD = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


class _Invisible(dict):
    """Translation that drops format and other invisible characters, learnt as they come."""

    def __missing__(self, code: int):
        c = chr(code)
        gone = unicodedata.category(c) == "Cf" or code == 0x034F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x115F, 0x1160, 0x3164, 0xFFA0)
        self[code] = None if gone else c
        return self[code]


_DROP = _Invisible()


def _unescape(m: re.Match) -> str:
    number = m.group(1) or m.group(2) or m.group(3)
    if number:
        code = int(number, 16)
        return chr(code) if code < 0x110000 else " "
    c = m.group(4)
    return " " if c in "nrtbfv0" else c


def _tag(m: re.Match) -> str:
    return " " if _BLOCK_TAG.match(m.group()) else ""


def plain(text: str) -> str:
    """Text without tags, entities, escapes, invisible characters, letter case and differences of compatibility form."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
        if any(0xD800 <= ord(c) < 0xE000 for c in text):
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if "<" in text:
        text = _TAG.sub(_tag, text)
    if "&" in text:
        for _ in range(2):
            text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
        if "<" in text:
            text = _TAG.sub(_tag, text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DROP).casefold()
        return unicodedata.normalize("NFKC", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    """Words of a text in order; none for null."""
    return _WORD.findall(plain(text)) if text else []
