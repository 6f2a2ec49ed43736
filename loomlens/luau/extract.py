"""One pass over each file: typed rows for every later operator. A file is parsed once."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .lexer import LuauError, unquote
from .parser import N, parse

SCHEMA = (
    "path string, lines int, error string, "
    "functions array<struct<seq:int,name:string,line:int,end_line:int,lines:int,parameters:int,cyclomatic:int,cognitive:int>>, "
    "requires array<struct<seq:int,kind:string,specifier:string,line:int>>, "
    "exports array<struct<seq:int,name:string,line:int>>, "
    "local_decls array<struct<name:string,line:int>>, local_reads array<string>, "
    "type_decls array<struct<name:string,line:int>>, type_refs array<string>, "
    "key_refs array<struct<specifier:string,key:string,line:int>>, "
    "tokens array<struct<text:string,line:int,end_line:int>>, "
    "markers array<struct<line:int,kind:string,level:string,reason:string,text:string>>, "
    "flags array<struct<line:int,kind:string,name:string,detail:string>>"
)

NUMBER, STRING = "\1number", "\2string"
#: Tools whose suppression comments count, unless a configuration names others.
PREFIXES = ("loomlens", "lint")
_MARKER = re.compile(r"(.+?)-ignore(-file|-next-line|(?=\s|\Z))(.*)", re.S)


def functions(block: list[N]) -> list[dict]:
    """Every function, outer ones first, with nested ones scored on their own."""
    out: list[dict] = []

    def add(name: str, body: N) -> None:
        cc, cog = [1], [0]
        row = {"seq": len(out), "name": name, "line": body.line, "end_line": body.end, "lines": body.end - body.line + 1, "parameters": body.count}
        out.append(row)

        def flat(*es: N | None) -> None:
            for e in es:
                if e is not None:
                    expr(e, 0)

        def expr(e: N, nest: int) -> None:
            k = e.kind
            if k == "binary":
                if e.op in ("and", "or"):
                    cc[0] += 1
                    cog[0] += 1
                expr(e.a, nest)
                expr(e.b, nest)
            elif k in ("unary", "paren", "cast"):
                expr(e.e, nest)
            elif k == "ifexpr":
                cc[0] += 1 + len(e.others)
                cog[0] += (1 + nest) * (1 + len(e.others))
                expr(e.cond, nest)
                expr(e.yes, nest + 1)
                for c, v in e.others:
                    expr(c, nest)
                    expr(v, nest + 1)
                expr(e.no, nest + 1)
            elif k == "table":
                for form, key, v, _ in e.fields:
                    if form == "expr":
                        expr(key, nest)
                    expr(v, nest)
            elif k == "interpolated":
                for p in e.parts:
                    expr(p, nest)
            elif k in ("call", "access"):
                if e.prefix.kind == "paren":
                    expr(e.prefix.e, nest)
                for form, x, args, _ in e.suffixes:
                    if form == "index":
                        expr(x, nest)
                    elif args is not None:
                        for v in args.values:
                            expr(v, nest)

        def run(stats: list[N], nest: int) -> None:
            for s in stats:
                k = s.kind
                if k == "const":
                    s = s.inner
                    k = s.kind
                if k == "local":
                    for v in s.values:
                        expr(v, nest)
                elif k == "assign":
                    for v in (*s.left, *s.right):
                        expr(v, nest)
                elif k == "compound":
                    expr(s.left, nest)
                    expr(s.right, nest)
                elif k == "callstat":
                    expr(s.call, nest)
                elif k == "return":
                    for v in s.values:
                        expr(v, nest)
                elif k == "do":
                    run(s.body, nest)
                elif k == "if":
                    cc[0] += 1 + len(s.others)
                    cog[0] += (1 + nest) * (1 + len(s.others)) + (s.last is not None)
                    expr(s.cond, nest)
                    run(s.body, nest + 1)
                    for c, b in s.others:
                        expr(c, nest)
                        run(b, nest + 1)
                    run(s.last or [], nest + 1)
                elif k in ("while", "repeat", "fornum", "forin"):
                    cc[0] += 1
                    cog[0] += 1 + nest
                    for v in [s.cond] if "cond" in s.d else s.values:
                        expr(v, nest)
                    run(s.body, nest + 1)

        run(body.block, 0)
        row["cyclomatic"], row["cognitive"] = cc[0], cog[0]
        inside(body.block, name)

    def join(outer: str, name: str) -> str:
        return f"{outer}/{name}" if outer else name

    def values(e: N, outer: str) -> None:
        k = e.kind
        if k == "anonymous":
            add(join(outer, "<anonymous>"), e.body)
        elif k == "binary":
            values(e.a, outer)
            values(e.b, outer)
        elif k in ("unary", "paren", "cast"):
            values(e.e, outer)
        elif k == "ifexpr":
            for x in (e.cond, e.yes, *[y for pair in e.others for y in pair], e.no):
                values(x, outer)
        elif k == "table":
            for form, key, v, _ in e.fields:
                if form == "expr":
                    values(key, outer)
                values(v, outer)
        elif k == "interpolated":
            for p in e.parts:
                values(p, outer)
        elif k in ("call", "access"):
            if e.prefix.kind == "paren":
                values(e.prefix.e, outer)
            for form, x, args, _ in e.suffixes:
                if form == "index":
                    values(x, outer)
                elif args is not None:
                    for v in args.values:
                        values(v, outer)

    def inside(stats: list[N], outer: str) -> None:
        for s in stats:
            k = s.kind
            if k == "const":
                s = s.inner
                k = s.kind
            if k == "localfunction":
                add(join(outer, s.name.text), s.body)
            elif k == "function":
                add(join(outer, s.name), s.body)
            elif k in ("local", "return"):
                for v in s.values:
                    values(v, outer)
            elif k == "assign":
                for v in s.right:
                    values(v, outer)
            elif k == "compound":
                values(s.right, outer)
            elif k == "callstat":
                values(s.call, outer)
            elif k in ("do", "while", "repeat", "fornum", "forin"):
                for v in [s.cond] if "cond" in s.d else s.d.get("values", []):
                    values(v, outer)
                inside(s.body, outer)
            elif k == "if":
                values(s.cond, outer)
                inside(s.body, outer)
                for c, b in s.others:
                    values(c, outer)
                    inside(b, outer)
                inside(s.last or [], outer)

    inside(block, "")
    return out


def _literal(args: N) -> N | None:
    """The string that a call is given first, through one pair of parentheses."""
    if not args.values:
        return None
    e = args.values[0]
    if e.kind == "paren":
        e = e.e
    return e if e.kind == "string" else None


class Walk:
    """Requires, name reads, declarations and keyed references in one scoped walk."""

    def __init__(self, block: list[N]):
        self.requires: list[dict] = []
        self.refs: list[dict] = []
        self.decls: list[dict] = []
        self.reads: set[str] = set()
        self.scopes: list[dict[str, str | None]] = [{}]
        self.silent = 0  # inside anonymous functions locals are not reported
        self.block(block, fresh=False)

    # -- modules

    def bound(self, name: str) -> str | None:
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        return None

    def required(self, prefix: N, args: N) -> str | None:
        if prefix.kind != "name" or prefix.token.text != "require" or any("require" in s for s in self.scopes):
            return None
        e = args.values[0] if args.values else None
        return unquote(e.token.text) if e is not None and e.kind == "string" and args.form != "table" else None

    def module(self, e: N) -> str | None:
        if e.kind == "name":
            return self.bound(e.token.text)
        if e.kind in ("paren", "cast"):
            return self.module(e.e)
        if e.kind == "call" and len(e.suffixes) == 1 and e.suffixes[0][0] == "call":
            return self.required(e.prefix, e.suffixes[0][2])
        return None

    def record(self, to: str, key: str | None, line: int) -> None:
        self.refs.append({"specifier": to, "key": key, "line": line})

    # -- expressions

    def chain(self, e: N) -> None:
        line = self.line(e)
        first, rest = e.suffixes[0], e.suffixes[1:]
        to = self.bound(e.prefix.token.text) if e.prefix.kind == "name" else self.module(e.prefix.e)
        step = first
        if to is None and first[0] == "call":
            to = self.required(e.prefix, first[2])
            step = rest[0] if rest else None
        if to is not None and step is not None:
            key = None
            if step[0] in ("dot", "method"):
                key = step[1].text
            elif step[0] == "index" and step[1].kind == "string":
                key = unquote(step[1].token.text)
            self.record(to, key, line)
        if e.prefix.kind == "name":
            self.reads.add(e.prefix.token.text)
            if first[0] == "call":
                name = e.prefix.token.text
                if name == "require":
                    s = _literal(first[2])
                    self.requires.append({"seq": len(self.requires), "kind": "string_literal" if s else "dynamic", "specifier": unquote(s.token.text) if s else None, "line": line})
                elif name in ("loadstring", "load"):
                    self.requires.append({"seq": len(self.requires), "kind": "loadstring", "specifier": None, "line": line})
        else:
            self.expr(e.prefix.e)
        for form, x, args, _ in e.suffixes:
            if form == "index":
                self.expr(x)
            elif args is not None:
                for v in args.values:
                    if args.form == "paren" and v.kind != "name" and (m := self.module(v)) is not None:
                        self.record(m, None, self.line(v))
                    self.expr(v)

    def line(self, e: N) -> int:
        while e.kind in ("call", "access", "paren", "cast"):
            if e.kind in ("paren", "cast"):
                e = e.e
            elif e.prefix.kind == "name":
                return e.prefix.token.line
            else:
                e = e.prefix.e
        return e.token.line if "token" in e.d else 1

    def expr(self, e: N) -> None:
        k = e.kind
        if k == "name":
            self.reads.add(e.token.text)
            if (to := self.bound(e.token.text)) is not None:
                self.record(to, None, e.token.line)
        elif k in ("call", "access"):
            self.chain(e)
        elif k == "binary":
            self.expr(e.a)
            self.expr(e.b)
        elif k in ("unary", "paren", "cast"):
            self.expr(e.e)
        elif k == "ifexpr":
            for x in (e.cond, e.yes, *[y for pair in e.others for y in pair], e.no):
                self.expr(x)
        elif k == "table":
            for form, key, v, _ in e.fields:
                if form == "expr":
                    self.expr(key)
                self.expr(v)
        elif k == "interpolated":
            for p in e.parts:
                self.expr(p)
        elif k == "anonymous":
            self.silent += 1
            self.body(e.body)
            self.silent -= 1

    # -- statements

    def body(self, body: N) -> None:
        names = [p.text for p in body.params]
        self.reads |= set(names)
        self.scopes.append(dict.fromkeys(names))
        self.block(body.block)
        self.scopes.pop()

    def declare(self, token) -> None:
        if not self.silent:
            self.decls.append({"name": token.text, "line": token.line})

    def block(self, stats: list[N], fresh: bool = True) -> None:
        if fresh:
            self.scopes.append({})
        for s in stats:
            self.statement(s)
        if fresh:
            self.scopes.pop()

    def statement(self, s: N) -> None:
        k = s.kind
        if k == "const":
            kept, self.silent = self.silent, 1
            self.statement(s.inner)
            self.silent = kept
        elif k == "local":
            for v in s.values:
                self.initial(v)
            found = [self.module(v) for v in s.values]
            for i, n in enumerate(s.names):
                self.declare(n)
                self.scopes[-1][n.text] = found[i] if i < len(found) else None
        elif k == "localfunction":
            self.declare(s.name)
            self.scopes[-1][s.name.text] = None
            self.body(s.body)
        elif k == "function":
            self.body(s.body)
        elif k == "assign":
            for v in s.right:
                self.expr(v)
            for v in s.left:
                if v.kind == "access":
                    self.chain(v)
            for v in s.left:
                if v.kind == "name":
                    name = v.token.text
                    if (to := self.bound(name)) is not None:
                        self.record(to, None, v.token.line)
                    for scope in reversed(self.scopes):
                        if name in scope:
                            scope[name] = None
                            break
        elif k == "compound":
            self.expr(s.left)
            self.expr(s.right)
        elif k == "callstat":
            self.chain(s.call)
        elif k == "return":
            for v in s.values:
                if v.kind != "name" and (m := self.module(v)) is not None:
                    self.record(m, None, self.line(v))
                self.expr(v)
        elif k == "if":
            self.expr(s.cond)
            self.block(s.body)
            for c, b in s.others:
                self.expr(c)
                self.block(b)
            if s.last is not None:
                self.block(s.last)
        elif k in ("while", "repeat"):
            if k == "while":
                self.expr(s.cond)
            self.block(s.body)
            if k == "repeat":
                self.expr(s.cond)
        elif k in ("fornum", "forin"):
            for v in s.values:
                self.expr(v)
            self.reads |= {n.text for n in s.names}
            self.scopes.append({n.text: None for n in s.names})
            self.block(s.body)
            self.scopes.pop()
        elif k == "do":
            self.block(s.body)

    def initial(self, e: N) -> None:
        """A local's value: a bare module there is a new binding, not a use."""
        if e.kind == "name" and self.bound(e.token.text) is not None:
            self.reads.add(e.token.text)
            self.record(self.bound(e.token.text), None, e.token.line)
        else:
            self.expr(e)


def exports(block: list[N]) -> list[dict]:
    """Keys of the table that the file returns first, if it returns one."""
    if not block or block[-1].kind != "return" or not block[-1].values:
        return []
    e = block[-1].values[0]
    while e.kind in ("paren", "cast"):
        e = e.e
    if e.kind != "table":
        return []
    out = []
    for form, key, _, _ in e.fields:
        if form == "name":
            out.append({"seq": len(out), "name": key.text, "line": key.line})
        elif form == "expr" and key.kind == "string":
            out.append({"seq": len(out), "name": unquote(key.token.text), "line": key.token.line})
    return out


def markers(comments, prefixes: tuple[str, ...] = PREFIXES) -> list[dict]:
    """Suppression comments: ``...-ignore``, ``...-ignore-file`` or ``...-ignore-next-line`` of the named tools; others are another linter's."""
    out = []
    for c in comments:
        text = c.text.strip()
        m = _MARKER.fullmatch(text) if c.single else None
        if not m or m[1] not in prefixes:
            continue
        rest = m[3].strip()
        if rest.startswith("-- "):
            kinds, reason = "", rest[3:]
        else:
            kinds, _, reason = rest.partition(" -- ")
        out.append({"line": c.line, "kind": kinds or "all", "level": "file" if m[2] == "-file" else "next-line", "reason": reason or None, "text": f"-- {text}"})
    return out


def flags(block: list[N]) -> list[dict]:
    """Flag-like names in conditions, and calls that ask for a flag or an attribute."""
    out = []

    def hit(token, kind: str, detail: str) -> None:
        out.append({"line": token.line, "kind": kind, "name": token.text, "detail": detail})

    def call(e: N) -> None:
        if e.prefix.kind == "name":
            name = e.prefix.token.text
            if "Feature" in name or "Flag" in name or name == "GetAttribute":
                hit(e.prefix.token, "get_attribute" if name == "GetAttribute" else "identifier", "call")
        for form, _, args, _ in e.suffixes:
            if form == "call" and args.form == "paren":
                for v in args.values:
                    cond(v)

    def cond(e: N) -> None:
        if e.kind == "name" and e.token.text.startswith(("FF_", "FLAG_", "Feature")):
            hit(e.token, "identifier", "identifier in condition")
        elif e.kind == "binary":
            cond(e.a)
            cond(e.b)
        elif e.kind in ("unary", "paren"):
            cond(e.e)
        elif e.kind == "call":
            call(e)

    def run(stats: list[N]) -> None:
        for s in stats:
            if s.kind == "if":
                cond(s.cond)
                run(s.body)
                for c, b in s.others:
                    cond(c)
                    run(b)
                run(s.last or [])
            elif s.kind in ("localfunction", "function"):
                run(s.body.block)
            elif s.kind == "do":
                run(s.body)
            elif s.kind == "while":
                cond(s.cond)
                run(s.body)
            elif s.kind == "callstat":
                call(s.call)

    run(block)
    return out


def extract_source(path: str, source: str, prefixes: tuple[str, ...] = PREFIXES) -> dict:
    """All rows of one file; ``error`` instead of rows if it does not parse."""
    row: dict = {"path": path, "lines": len(source.removesuffix("\n").split("\n")) if source else 0, "error": None}
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(max(old, 20_000))
    try:
        block, p = parse(source)
        walk = Walk(block)
        row |= {
            "functions": functions(block), "requires": walk.requires, "exports": exports(block), "local_decls": walk.decls, "local_reads": sorted(walk.reads),
            "type_decls": [{"name": n, "line": l} for n, l, exported, depth in p.type_decls if not exported and depth == 1], "type_refs": sorted(set(p.type_refs)),
            "key_refs": [dict(t) for t in dict.fromkeys(tuple(r.items()) for r in walk.refs)],
            "tokens": [{"text": {"number": NUMBER, "string": STRING}.get(t.kind, t.text), "line": t.line, "end_line": t.end_line} for t in p.tokens if t.kind != "eof"],
            "markers": markers(p.comments, prefixes), "flags": flags(block),
        }
    except (LuauError, RecursionError) as e:
        row["error"] = f"{path}: {e}"
    finally:
        sys.setrecursionlimit(old)
    return row


COLUMNS = [c.split(" ")[0] for c in re.split(r", (?=\w+ (?:string|int|array))", SCHEMA)]


def extract(files: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """files(path, source) to one nested row each. Only the two columns reach the Python workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [extract_source(p, s, prefixes) for p, s in zip(pdf["path"], pdf["source"])]
            yield pd.DataFrame([{c: r.get(c) for c in COLUMNS} for r in rows], columns=COLUMNS)

    return files.select("path", "source").mapInPandas(run, SCHEMA)
