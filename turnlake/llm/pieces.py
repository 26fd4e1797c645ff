"""Splitting texts by a tokenizer's pattern."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

PROPERTIES = (r"\p{L}", r"\p{N}", r"\s", r"\S")


def latin1_pattern(pattern: str) -> str | None:
    """The pattern for the standard library's engine, right for characters up to U+00FF.

    Its classes list the characters that ``regex`` counts as letters, numbers and white space.
    None if the pattern holds other escapes.
    """
    lists = {
        p: "".join(re.escape(chr(c)) for c in range(256) if regex.match(p, chr(c)))
        for p in PROPERTIES
    }
    out, inside, at = [], False, 0
    while at < len(pattern):
        found = next((p for p in PROPERTIES if pattern.startswith(p, at)), None)
        if found == r"\S":
            if inside:
                return None
            out.append(f"[^{lists[chr(92) + 's']}]")
        elif found:
            out.append(lists[found] if inside else f"[{lists[found]}]")
        elif pattern[at] == "\\":
            return None
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
        at += len(found or " ")
    return "".join(out)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches in a text. Texts of Latin-1 characters only take the faster engine."""
    every = regex.compile(pattern).findall
    plain = latin1_pattern(pattern)
    if plain is None:
        return every
    quick = re.compile(plain).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return quick(text)

    return split
