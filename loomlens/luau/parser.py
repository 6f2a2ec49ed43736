"""A recursive-descent parser of Luau to a light tree; types are read for the names they use."""

from __future__ import annotations

from .lexer import Comment, LuauError, Token, tokenize

_BINARY = {
    "or": (1, 1), "and": (2, 2), "<": (3, 3), ">": (3, 3), "<=": (3, 3), ">=": (3, 3), "~=": (3, 3), "!=": (3, 3), "==": (3, 3),
    "..": (5, 4), "+": (6, 6), "-": (6, 6), "*": (7, 7), "/": (7, 7), "//": (7, 7), "%": (7, 7), "^": (10, 9),
}
_COMPOUND = frozenset(("+=", "-=", "*=", "/=", "//=", "%=", "^=", "..="))


class N:
    """A node: its kind and whatever that kind needs."""

    __slots__ = ("kind", "d")

    def __init__(self, kind: str, **d):
        self.kind, self.d = kind, d

    def __getattr__(self, name):
        try:
            return self.d[name]
        except KeyError:
            raise AttributeError(name) from None


class Parser:
    def __init__(self, source: str):
        self.tokens, self.comments = tokenize(source)
        self.at = 0
        self.type_refs: list[str] = []
        self.type_decls: list[tuple[str, int, bool, int]] = []
        self.depth = 0

    # -- tokens

    @property
    def t(self) -> Token:
        return self.tokens[self.at]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def is_(self, text: str) -> bool:
        return self.t.text == text and self.t.kind in ("op", "keyword")

    def take(self, text: str) -> Token | None:
        if self.is_(text):
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, text: str) -> Token:
        got = self.take(text)
        if got is None:
            raise LuauError(f"line {self.t.line}: expected {text!r}, got {self.t.text!r}")
        return got

    def name(self) -> Token:
        if self.t.kind != "name":
            raise LuauError(f"line {self.t.line}: expected a name, got {self.t.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    # -- statements

    def chunk(self) -> list[N]:
        body = self.block()
        if self.t.kind != "eof":
            raise LuauError(f"line {self.t.line}: unexpected {self.t.text!r}")
        return body

    def block(self) -> list[N]:
        out = []
        self.depth += 1
        while not (self.t.kind == "eof" or (self.t.kind == "keyword" and self.t.text in ("end", "else", "elseif", "until"))):
            s = self.statement()
            self.take(";")
            if s is not None:
                out.append(s)
                if s.kind in ("return", "break"):
                    break
        self.depth -= 1
        return out

    def statement(self) -> N | None:
        t = self.t
        while self.is_("@"):
            self.at += 1
            if self.take("["):
                while not self.take("]"):
                    self.at += 1
            else:
                self.name()
        if self.take(";"):
            return None
        t = self.t
        if t.kind == "keyword":
            f = getattr(self, "s_" + t.text, None)
            if f:
                self.at += 1
                return f(t)
        elif t.kind == "name":
            nxt = self.peek()
            if t.text == "continue" and not (nxt.kind == "op" and nxt.text in ("=", ".", ":", "(", "[", ",", "{") or nxt.text in _COMPOUND or nxt.kind in ("string", "istring")):
                self.at += 1
                return N("break")
            if t.text == "type" and nxt.kind == "name":
                self.at += 1
                return self.type_decl(t, False)
            if t.text == "export" and nxt.text == "type":
                self.at += 2
                return self.type_decl(t, True)
            if t.text == "const" and (nxt.kind == "name" or nxt.text == "function"):
                self.at += 1
                return N("const", inner=self.s_local(t))
        e = self.suffixed()
        if self.is_("=") or self.is_(","):
            left = [e]
            while self.take(","):
                left.append(self.suffixed())
            self.need("=")
            return N("assign", left=left, right=self.expressions())
        if self.t.text in _COMPOUND and self.t.kind == "op":
            self.at += 1
            return N("compound", left=e, right=self.expr())
        if e.kind != "call":
            raise LuauError(f"line {t.line}: not a statement")
        return N("callstat", call=e)

    def s_local(self, t: Token) -> N:
        if self.take("function"):
            name = self.name()
            return N("localfunction", name=name, body=self.function_body())
        names = [self.binding()]
        while self.take(","):
            names.append(self.binding())
        return N("local", names=names, values=self.expressions() if self.take("=") else [])

    def binding(self) -> Token:
        name = self.name()
        if self.take(":"):
            self.type_()
        elif self.is_("<"):  # attribs
            self.at += 1
            self.name()
            self.need(">")
        return name

    def s_function(self, t: Token) -> N:
        parts = [self.name().text]
        while self.is_(".") or self.is_(":"):
            parts += [self.t.text]
            self.at += 1
            parts.append(self.name().text)
        return N("function", name="".join(parts), root=parts[0], body=self.function_body())

    def s_if(self, t: Token) -> N:
        cond = self.expr()
        self.need("then")
        body, others, last = self.block(), [], None
        while self.take("elseif"):
            c = self.expr()
            self.need("then")
            others.append((c, self.block()))
        if self.take("else"):
            last = self.block()
        self.need("end")
        return N("if", cond=cond, body=body, others=others, last=last)

    def s_while(self, t: Token) -> N:
        cond = self.expr()
        self.need("do")
        body = self.block()
        self.need("end")
        return N("while", cond=cond, body=body)

    def s_repeat(self, t: Token) -> N:
        body = self.block()
        self.need("until")
        return N("repeat", body=body, cond=self.expr())

    def s_do(self, t: Token) -> N:
        body = self.block()
        self.need("end")
        return N("do", body=body)

    def s_for(self, t: Token) -> N:
        names = [self.binding()]
        if self.take("="):
            values = self.expressions()
            kind = "fornum"
        else:
            while self.take(","):
                names.append(self.binding())
            self.need("in")
            values, kind = self.expressions(), "forin"
        self.need("do")
        body = self.block()
        self.need("end")
        return N(kind, names=names, values=values, body=body)

    def s_return(self, t: Token) -> N:
        stop = self.t.kind == "eof" or self.t.text in ("end", "else", "elseif", "until", ";") and self.t.kind != "string"
        return N("return", values=[] if stop else self.expressions())

    def s_break(self, t: Token) -> N:
        return N("break")

    # -- functions and expressions

    def function_body(self) -> N:
        self.generics()
        start = self.need("(")
        params, count = [], 0
        while not self.take(")"):
            count += 1
            if self.take("..."):
                if self.take(":"):
                    self.type_()
            else:
                params.append(self.binding())
            if not self.take(","):
                self.need(")")
                break
        if self.take(":"):
            self.type_(pack=True)
        body = self.block()
        end = self.need("end")
        return N("body", line=start.line, end=end.line, params=params, count=count, block=body)

    def expressions(self) -> list[N]:
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        return out

    def expr(self, limit: int = 0) -> N:
        t = self.t
        if t.text in ("not", "-", "#") and t.kind in ("op", "keyword"):
            self.at += 1
            left = N("unary", e=self.expr(8))
        else:
            left = self.simple()
        while self.t.kind in ("op", "keyword") and self.t.text in _BINARY:
            op = self.t.text
            low, high = _BINARY[op]
            if low <= limit:
                break
            self.at += 1
            left = N("binary", op=op, a=left, b=self.expr(high))
        return left

    def simple(self) -> N:
        t = self.t
        if t.kind == "number":
            self.at += 1
            e = N("number")
        elif t.kind == "string":
            self.at += 1
            e = N("string", token=t)
        elif t.kind == "istring":
            e = self.interpolated()
        elif t.kind == "keyword" and t.text in ("nil", "true", "false"):
            self.at += 1
            e = N("constant")
        elif self.take("..."):
            e = N("constant")
        elif self.is_("{"):
            e = self.table()
        elif self.is_("@") or self.is_("function"):
            while self.take("@"):
                self.name()
            self.need("function")
            e = N("anonymous", body=self.function_body())
        elif self.take("if"):
            cond = self.expr()
            self.need("then")
            yes, others = self.expr(), []
            while self.take("elseif"):
                c = self.expr()
                self.need("then")
                others.append((c, self.expr()))
            self.need("else")
            e = N("ifexpr", cond=cond, yes=yes, others=others, no=self.expr())
        else:
            e = self.suffixed()
        while self.take("::"):
            self.type_()
            e = N("cast", e=e)
        return e

    def interpolated(self) -> N:
        parts = []
        while True:
            text = self.t.text
            self.at += 1
            if text.endswith("`") and (len(text) > 1 or parts):
                return N("interpolated", parts=parts)
            if not text.endswith("{"):
                raise LuauError(f"line {self.t.line}: broken interpolated string")
            parts.append(self.expr())
            if self.t.kind != "istring":
                raise LuauError(f"line {self.t.line}: broken interpolated string")

    def table(self) -> N:
        self.need("{")
        fields = []
        while not self.take("}"):
            if self.take("["):
                key = self.expr()
                self.need("]")
                self.need("=")
                fields.append(("expr", key, self.expr(), None))
            elif self.t.kind == "name" and self.peek().text == "=" and self.peek().kind == "op":
                name = self.name()
                self.need("=")
                fields.append(("name", name, self.expr(), None))
            else:
                fields.append(("item", None, self.expr(), None))
            if not (self.take(",") or self.take(";")):
                self.need("}")
                break
        return N("table", fields=fields)

    def suffixed(self) -> N:
        t = self.t
        if t.kind == "name":
            self.at += 1
            prefix = N("name", token=t)
        elif self.take("("):
            inner = self.expr()
            self.need(")")
            prefix = N("paren", e=inner)
        else:
            raise LuauError(f"line {t.line}: unexpected {t.text!r}")
        suffixes = []
        while True:
            t = self.t
            if t.kind == "string" or (t.kind == "istring" and t.text[0] == "`") or self.is_("{") or self.is_("("):
                suffixes.append(("call", None, self.arguments(), t.line))
            elif self.take("."):
                suffixes.append(("dot", self.name(), None, t.line))
            elif self.take("["):
                e = self.expr()
                self.need("]")
                suffixes.append(("index", e, None, t.line))
            elif self.is_(":") and self.peek().kind == "name":
                self.at += 1
                name = self.name()
                if self.take("<"):
                    self.need("<")
                    while not self.take(">"):
                        self.type_()
                        self.take(",")
                    self.need(">")
                suffixes.append(("method", name, self.arguments(), t.line))
            else:
                break
        if not suffixes:
            return prefix
        return N("call" if suffixes[-1][0] in ("call", "method") else "access", prefix=prefix, suffixes=suffixes)

    def arguments(self) -> N:
        t = self.t
        if t.kind == "string":
            self.at += 1
            return N("args", form="string", values=[N("string", token=t)])
        if t.kind == "istring":
            return N("args", form="string", values=[self.interpolated()])
        if self.is_("{"):
            return N("args", form="table", values=[self.table()])
        self.need("(")
        values = []
        if not self.take(")"):
            values = self.expressions()
            self.need(")")
        return N("args", form="paren", values=values)

    # -- types

    def type_decl(self, t: Token, exported: bool) -> N:
        if self.take("function"):
            name = self.name()
            self.type_decls.append((name.text, t.line, exported, self.depth))
            return N("typefunction", body=self.function_body())
        name = self.name()
        self.type_decls.append((name.text, t.line, exported, self.depth))
        self.generics()
        self.need("=")
        self.type_()
        return N("type", name=name)

    def generics(self) -> None:
        if self.take("<"):
            while not self.take(">"):
                self.name()
                self.take("...")
                if self.take("="):
                    self.type_(pack=True)
                self.take(",")

    def type_(self, pack: bool = False) -> None:
        if self.take("..."):
            self.type_()
            return
        self.take("|") or self.take("&")
        self.one_type()
        while True:
            if self.take("?"):
                continue
            if self.take("|") or self.take("&"):
                self.one_type()
                continue
            if self.take("..."):
                continue
            break

    def one_type(self) -> None:
        t = self.t
        if t.kind == "string" or t.text in ("nil", "true", "false"):
            self.at += 1
            return
        if self.is_("<"):
            self.generics()
        if self.take("{"):
            while not self.take("}"):
                if self.t.kind == "name" and self.t.text in ("read", "write") and (self.peek().kind == "name" or self.peek().text == "["):
                    self.at += 1
                if self.is_("["):
                    self.at += 1
                    self.type_()
                    self.need("]")
                    self.need(":")
                    self.type_()
                elif self.t.kind == "name" and self.peek().text == ":":
                    self.at += 2
                    self.type_()
                else:
                    self.type_()
                if not (self.take(",") or self.take(";")):
                    self.need("}")
                    break
            return
        if self.take("("):
            while not self.take(")"):
                if self.t.kind == "name" and self.peek().text == ":":
                    self.at += 2
                self.type_(pack=True)
                if not self.take(","):
                    self.need(")")
                    break
            if self.take("->"):
                self.type_(pack=True)
            return
        name = self.name()
        if name.text == "typeof" and self.take("("):
            self.expr()
            self.need(")")
            return
        self.type_refs.append(name.text)
        while self.take("."):
            self.type_refs.append(self.name().text)
        if self.take("<"):
            while not self.take(">"):
                self.type_(pack=True)
                self.take(",")
            return


def parse(source: str) -> tuple[list[N], Parser]:
    p = Parser(source)
    return p.chunk(), p


__all__ = ["Comment", "LuauError", "N", "Parser", "parse"]
