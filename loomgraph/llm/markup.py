"""Plain words of texts with wiki or HTML markup."""

from __future__ import annotations

import html
import re

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REF = re.compile(r"<ref\b[^>]*?/>|<ref\b[^>]*>.*?</ref\s*>", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_OUTER = re.compile(r"\[(?:https?:|mailto:|//)\S*\s*([^\[\]]*)\]")
_QUOTES = re.compile(r"'{2,}")
_PIECE = re.compile(r"[^\W_]+")

#: A template with more words than this is taken to hold text (a quotation, say), a shorter one to be an annotation.
ANNOTATION_WORDS = 8


def _template(m: re.Match) -> str:
    inner = m[0][2:-2]
    return f" {inner} " if len(_PIECE.findall(inner)) > ANNOTATION_WORDS else ""


def plain(text: str) -> str:
    """``text`` without comments, references, tags, annotations, link targets and emphasis; links leave their labels."""
    if "<" in text:
        text = _TAG.sub("", _REF.sub("", _COMMENT.sub("", text)))
    for _ in range(6):
        if "{{" not in text:
            break
        after = _TEMPLATE.sub(_template, text)
        if after == text:
            break
        text = after
    if "[" in text:
        text = _OUTER.sub(r"\1", _LINK.sub(r"\1", text))
    if "''" in text:
        text = _QUOTES.sub("", text)
    return html.unescape(text) if "&" in text else text


def words(text: str | None) -> list[str]:
    """The words of the plain text: the longest runs of letters and digits, without regard to case."""
    return _PIECE.findall(plain(text).casefold()) if text else []
