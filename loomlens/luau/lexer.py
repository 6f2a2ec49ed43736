"""Tokens of Luau with their lines; comments are kept apart."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = frozenset("and break do else elseif end false for function if in local nil not or repeat return then true until while".split())
_OPS = re.compile(r"\.\.\.|\.\.=|//=|[+\-*/%^]=|\.\.|//|==|~=|!=|<=|>=|->|::|[-+*/%^#<>=(){}\[\];:,.?|&@!]")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?")
_SPACE = re.compile(r"[ \t\r\n\f\v]+")
_LONG = re.compile(r"\[(=*)\[")


class LuauError(ValueError):
    pass


@dataclass(slots=True)
class Token:
    kind: str  # name, keyword, number, string, istring, op, eof
    text: str
    line: int
    end_line: int


@dataclass(slots=True)
class Comment:
    text: str
    line: int
    single: bool


def tokenize(source: str) -> tuple[list[Token], list[Comment]]:
    tokens, comments, at, line, n = [], [], 0, 1, len(source)
    braces: list[int] = []  # open braces inside each interpolated string
    if source.startswith("#!"):
        at = source.find("\n") if "\n" in source else n

    def add(kind: str, end: int) -> None:
        nonlocal at, line
        text = source[at:end]
        last = line + text.count("\n")
        tokens.append(Token(kind, text, line, last))
        at, line = end, last

    def interpolated(start: int) -> None:
        i = start
        while True:
            if i >= n:
                raise LuauError(f"line {line}: unfinished interpolated string")
            c = source[i]
            if c == "\\":
                i += 2
            elif c == "`":
                add("istring", i + 1)
                return
            elif c == "{":
                braces.append(0)
                add("istring", i + 1)
                return
            else:
                i += 1

    while True:
        if m := _SPACE.match(source, at):
            line += m[0].count("\n")
            at = m.end()
        if at >= n:
            break
        c = source[at]
        if source.startswith("--", at):
            if m := _LONG.match(source, at + 2):
                close = f"]{m[1]}]"
                end = source.find(close, m.end())
                if end < 0:
                    raise LuauError(f"line {line}: unfinished comment")
                end += len(close)
                comments.append(Comment(source[at:end], line, False))
            else:
                end = source.find("\n", at)
                end = n if end < 0 else end
                comments.append(Comment(source[at + 2 : end].rstrip("\r"), line, True))
            line += source.count("\n", at, end)
            at = end
        elif m := _NAME.match(source, at):
            add("keyword" if m[0] in KEYWORDS else "name", m.end())
        elif c.isdigit() or (c == "." and at + 1 < n and source[at + 1].isdigit()):
            add("number", _NUMBER.match(source, at).end())
        elif c in "\"'":
            i = at + 1
            while True:
                if i >= n or source[i] == "\n":
                    raise LuauError(f"line {line}: unfinished string")
                if source[i] == "\\":
                    i += 2
                    if source[i - 1 : i] == "z":
                        while i < n and source[i].isspace():
                            i += 1
                elif source[i] == c:
                    break
                else:
                    i += 1
            add("string", i + 1)
        elif m := _LONG.match(source, at):
            end = source.find(f"]{m[1]}]", m.end())
            if end < 0:
                raise LuauError(f"line {line}: unfinished string")
            add("string", end + len(m[1]) + 2)
        elif c == "`":
            interpolated(at + 1)
        elif c == "}" and braces and braces[-1] == 0:
            braces.pop()
            interpolated(at + 1)
        elif m := _OPS.match(source, at):
            if braces and c == "{":
                braces[-1] += 1
            elif braces and c == "}":
                braces[-1] -= 1
            add("op", m.end())
        else:
            raise LuauError(f"line {line}: unexpected {c!r}")
    tokens.append(Token("eof", "", line, line))
    return tokens, comments


def unquote(text: str) -> str:
    """The inside of a literal, escapes as written."""
    if m := _LONG.match(text):
        return text[m.end() : -len(m[1]) - 2]
    return text[1:-1]
