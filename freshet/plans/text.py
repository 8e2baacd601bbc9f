"""SQL text in pieces."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|[A-Za-z_]\w*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|<>|<=|>=|!=|\|\||:\w+|.""", re.S)


def tokens(sql: str) -> list[str]:
    """Words, literals and signs; white space and comments become one space."""
    out = [" " if t.isspace() or t[:2] in ("--", "/*") else t for t in _TOKEN.findall(sql)]
    return [t for i, t in enumerate(out) if t != " " or (i and out[i - 1] != " ")]


def split(toks: list[str], at: str = ",") -> list[list[str]]:
    """The parts between the at signs that stand in no bracket, without white space at their ends."""
    parts, depth = [[]], 0
    for t in toks:
        depth += (t == "(") - (t == ")")
        if t == at and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [trimmed(p) for p in parts]


def trimmed(toks: list[str]) -> list[str]:
    words = [i for i, t in enumerate(toks) if t != " "]
    return toks[words[0] : words[-1] + 1] if words else []


def closing(toks: list[str], i: int) -> int:
    """Where the bracket that opens at i closes."""
    depth = 0
    for j in range(i, len(toks)):
        depth += (toks[j] == "(") - (toks[j] == ")")
        if depth == 0:
            return j
    raise ValueError("a bracket is not closed")
