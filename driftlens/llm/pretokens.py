"""Texts as pieces between spaces and line feeds, each of which splits into pre-tokens on its own.

The pattern that splits text before merges looks at white space and at what
follows it. In a text whose white space is single spaces and single line feeds,
none beside another, a piece that starts at a space (or after a line feed)
splits the same way alone as in the text. Pieces repeat, so what has been
found for one can be remembered. Other texts are split as a whole.
"""

from __future__ import annotations

import regex

#: White space other than space and line feed.
_OTHER = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def is_plain(text: str) -> bool:
    """Whether all white space stands alone and is a space or a line feed."""
    return not ("  " in text or "\n " in text or " \n" in text or "\n\n" in text or any(c in text for c in _OTHER))


def is_word(piece: str) -> bool:
    """Whether the piece is a space, or none, and Latin letters: one pre-token, without asking the pattern."""
    body = piece[1:] if piece[:1] == " " else piece
    return body.isalpha() and (body.isascii() or max(body) < "\u0250")


def pieces(text: str, pattern: regex.Pattern) -> list[str]:
    """Strings that make up the text and split on their own as they do in it."""
    if not is_plain(text):
        return pattern.findall(text)
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        first, *rest = line.split(" ")
        out.append(first)
        out += [" " + p for p in rest]
    return out
