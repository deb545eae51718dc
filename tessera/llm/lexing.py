"""Lexers: tokens of the eight languages and JSON, with line ends and offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class LexError(Exception):
    def __init__(self, at: int, cause: str):
        super().__init__(cause)
        self.at, self.cause = at, cause


@dataclass
class Tokens:
    kinds: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)

    def add(self, kind: str, value: str, broken: bool, at: int) -> None:
        self.kinds.append(kind)
        self.values.append(value)
        self.breaks.append(broken)
        self.offsets.append(at)


CONFLICT = re.compile(r"(?m)^(?:<{7}(?: .*)?$|={7}$|>{7}(?: .*)?$|\|{7}(?: .*)?$)")


def close_of(text: str, at: int, inside: str = "{", outside: str = "}", comments: bool = True) -> int:
    """The offset after the bracket that closes one opened just before ``at``, past strings and comments."""
    depth = 1
    scan = re.compile(r"""["'`{}\\]|//|/\*""") if comments else re.compile(r"""["'`{}\\]""")
    while m := scan.search(text, at):
        c = m.group(0)
        at = m.end()
        if c == inside:
            depth += 1
        elif c == outside:
            depth -= 1
            if not depth:
                return at
        elif c == "\\":
            at += 1
        elif c == "//":
            at = text.find("\n", at)
            if at < 0:
                break
        elif c == "/*":
            at = text.find("*/", at) + 2
            if at < 2:
                break
        elif c == "`":
            at = template_end(text, at, "`", "${")
        else:
            end = re.compile(rf"(?:[^{c}\\\n]|\\.)*{c}").match(text, at)
            if end:
                at = end.end()
            elif c == '"':
                break
    raise LexError(at, "unclosed interpolation")


def template_end(text: str, at: int, quote: str, opening: str) -> int:
    """The offset after a template literal whose text begins at ``at``; interpolations may hold templates."""
    scan = re.compile(rf"\\|{re.escape(quote)}|{re.escape(opening)}")
    start = at
    while m := scan.search(text, at):
        at = m.end()
        if m.group(0) == "\\":
            at += 1
        elif m.group(0) == quote:
            return at
        else:
            at = close_of(text, at)
    raise LexError(start, "unterminated template")


class Lexer:
    """A lexer from a list of ``(kind, pattern)``; ``special`` finds the end of what no pattern can describe."""

    def __init__(self, patterns: list[tuple[str, str]], keywords: set[str], special: dict | None = None):
        self.scan = re.compile("|".join(f"(?P<{k}>{p})" for k, p in patterns), re.S)
        self.keywords, self.special = frozenset(keywords), special or {}

    def __call__(self, text: str) -> Tokens:
        tokens, at, broken, n = Tokens(), 0, True, len(text)
        match, keywords, special = self.scan.match, self.keywords, self.special
        kinds, values, breaks, offsets = tokens.kinds, tokens.values, tokens.breaks, tokens.offsets
        while at < n:
            m = match(text, at)
            if m is None:
                raise LexError(at, "unexpected character")
            kind, value, end = m.lastgroup, m.group(), m.end()
            if kind == "SKIP":
                if not broken and ("\n" in value):
                    broken = True
                at = end
                continue
            if kind == "BAD":
                raise LexError(at, "unterminated literal or comment")
            if kind in special:
                kind, end = special[kind](text, at, end, tokens)
                value = text[at:end]
            if kind == "NAME":
                if value in keywords:
                    kind = value
            elif kind == "OP":
                kind = value
            kinds.append(kind)
            values.append(value)
            breaks.append(broken)
            offsets.append(at)
            broken = False
            at = end
        tokens.add("EOF", "", True, n)
        return tokens


NAME = r"[^\W\d]\w*"
SPACE = r"[ \t\r\n\f\v﻿   ]+"
C_COMMENT = r"//[^\n]*|/\*(?:(?!\*/).)*\*/"
NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.eE])|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?|\d[\d_]*(?:\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*)?)"
