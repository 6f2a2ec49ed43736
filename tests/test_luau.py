"""The extractor, without Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomlens.luau.extract import extract_source
from loomlens.luau.lexer import LuauError, tokenize
from loomlens.luau.parser import parse
from loomlens.operators.graph import cycle_walk, tarjan
from loomlens.sources.config import glob_regex


def one(src, key):
    row = extract_source("m.luau", src)
    assert row["error"] is None
    return row[key]


def test_complexity_of_a_chain():
    f = one("local function f(x)\n if x then a() elseif y then b() elseif z then c() else d() end\nend", "functions")[0]
    assert (f["cyclomatic"], f["cognitive"], f["parameters"], f["lines"]) == (4, 4, 1, 3)


def test_nested_functions_are_units_of_their_own():
    f = one("function A.b:c(x, ...)\n return function() if x and y then end end\nend", "functions")
    assert [(r["name"], r["cyclomatic"], r["cognitive"]) for r in f] == [("A.b:c", 1, 0), ("A.b:c/<anonymous>", 3, 2)]
    assert f[0]["parameters"] == 2


def test_requires_and_shadowing():
    src = 'local a = require("./a")\nlocal b = require(script.b)\nlocal c = loadstring("x")\nlocal function f(require) return require("z").k end\nreturn a.x, a["y"], a:z(), a'
    row = extract_source("m.luau", src)
    assert [r["kind"] for r in row["requires"]] == ["string_literal", "dynamic", "loadstring", "string_literal"]
    assert [(r["specifier"], r["key"]) for r in row["key_refs"]] == [("./a", "x"), ("./a", "y"), ("./a", "z"), ("./a", None)]


def test_exports_locals_and_types():
    src = "local used, spare, _skip = 1, 2, 3\ntype T = { x: U?, [string]: (a: V) -> W... }\nexport type E = T\nlocal x: T = used\nreturn { a = x, ['b c'] = 1, [k] = 2 }"
    row = extract_source("m.luau", src)
    assert [e["name"] for e in row["exports"]] == ["a", "b c"]
    assert [d["name"] for d in row["local_decls"] if d["name"] not in row["local_reads"]] == ["spare", "_skip"]
    assert [d["name"] for d in row["type_decls"]] == ["T"] and {"T", "U", "V", "W"} <= set(row["type_refs"])


def test_syntax_that_only_luau_has():
    src = "@native local function f<T>(x: T): (T, number)\n x += 1\n local s = `a{x}b{ {1} }c`\n for i = 1, 2 do if i == 1 then continue end end\n return if x then s else nil :: any, 0b11\nend\nconst k = 0xFF_FF // 2\ntype F = typeof(f)"
    assert extract_source("m.luau", src)["error"] is None


def test_markers():
    src = "-- lint-ignore-file complexity -- old code\n-- lint-ignore-next-line\nlocal x = 1 -- lint-ignore unused-local, high-crap\n--[[ lint-ignore ]] -- lint-ignored\nlocal s = '-- lint-ignore'"
    got = [(m["line"], m["level"], m["kind"], m["reason"]) for m in one(src, "markers")]
    assert got == [(1, "file", "complexity", "old code"), (2, "next-line", "all", None), (3, "next-line", "unused-local, high-crap", None)]


def test_tokens_hide_literals():
    assert [t["text"] for t in one("x = 'a' .. 1", "tokens")] == ["x", "=", "\2string", "..", "\1number"]


@pytest.mark.parametrize("src", ["if x then", "local = 1", "return 'a", "x", "--[[ a", "`a{1"])
def test_errors_are_rows(src):
    assert extract_source("m.luau", src)["error"].startswith("m.luau: ")


@given(st.text(alphabet="abx=(){}[]'\"`\n -.,:1+", max_size=40))
def test_any_text_parses_or_is_refused(src):
    try:
        parse(src)
    except (LuauError, RecursionError):
        pass


@given(st.lists(st.sampled_from(["a", "if", "1.5", "'s'", "==", "[[l\nl]]", "--c\n", "\n"]), max_size=20))
def test_token_lines(parts):
    src = " ".join(parts)
    lines = src.split("\n")
    assert all(t.text.split("\n")[0] in lines[t.line - 1] for t in tokenize(src)[0] if t.kind != "eof")


@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_components_and_walks(pairs):
    reach = {(a, b) for a, b in pairs}
    for k in range(8):
        reach |= {(a, b) for a in range(8) for b in range(8) if (a, k) in reach and (k, b) in reach}
    want = sorted({tuple(b for b in range(8) if (a, b) in reach and (b, a) in reach) for a in range(8) if (a, a) in reach})
    assert [tuple(p) for p in tarjan(list(pairs))] == want
    for part in tarjan(list(pairs)):
        walk = cycle_walk(part, list(pairs))
        assert walk[0] == walk[-1] and set(part) <= set(walk) and all(p in pairs for p in zip(walk, walk[1:]))


def test_globs():
    import re

    ok = lambda g, p: bool(re.match(glob_regex(g), p))
    assert ok("src/*.luau", "src/a.luau") and not ok("src/*.luau", "src/b/a.luau") and ok("**/*.luau", "a.luau") and ok("src/**", "src/b/a.luau") and ok("{a,b}.lua", "b.lua")
    with pytest.raises(ValueError):
        glob_regex("[a")
