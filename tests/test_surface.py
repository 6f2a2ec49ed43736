"""The tool server, saved reports, metadata, suppression prefixes, targets and clones of unusual size, the watch stream."""

import io
import json
import os
import subprocess
import time

import pytest

from loomlens import api, mcp
from loomlens.luau.extract import extract_source
from loomlens.operators import clones
from loomlens.plans import explain, viz
from loomlens.plans.project import Project
from loomlens.sources import git
from loomlens.sources.baseline import render_report
from loomlens.sources.config import Config, from_dict
from loomlens.sources.files import from_pairs
from loomlens.streaming import watch

FILES = {"init.luau": 'local a = require("./a")\nreturn { run = function() return a.k end }\n', "a.luau": "return { k = 1, gone = 2 }\n", "lost.luau": "return {}\n"}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (d / name).write_text(text)
    return d


def ask(spark, *messages):
    call = lambda name, args: api.report(spark, name, **({"explain": True} | args))
    return [mcp.answer(m, call) for m in messages]


def test_tools_give_what_the_command_line_gives(spark, tree):
    root = str(tree)
    first, listed, dead, schema, rule, bad = ask(
        spark, {"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {}}, {"id": 1, "method": "tools/list"},
        {"id": 2, "method": "tools/call", "params": {"name": "find_dead_code", "arguments": {"root": root}}}, {"id": 3, "method": "tools/call", "params": {"name": "schema"}},
        {"id": 4, "method": "tools/call", "params": {"name": "explain", "arguments": {"id": "unused_file"}}}, {"id": 5, "method": "tools/call", "params": {"name": "nothing"}},
    )
    assert first["result"]["serverInfo"]["name"] == "loomlens"
    assert {t["name"] for t in listed["result"]["tools"]} == set(mcp.TOOLS) and all(t["inputSchema"]["properties"]["root"] for t in listed["result"]["tools"])
    doc = dead["result"]["structuredContent"]
    assert doc == api.report(spark, "dead-code", root, explain=True) == json.loads(dead["result"]["content"][0]["text"])
    assert [r["path"] for r in doc["unused_files"]] == ["lost.luau"] and doc["_meta"]["limitations"]
    assert schema["result"]["structuredContent"]["_meta"]["metrics"].keys() == explain.METRICS.keys()
    assert rule["result"]["structuredContent"]["id"] == "unused-file" and bad["result"]["isError"]
    assert ask(spark, {"method": "notifications/initialized"}, {"id": 9, "method": "x"})[1]["error"]["code"] == -32601


def test_serving_lines():
    sink = io.StringIO()
    mcp.serve(io.StringIO('{"id": 1, "method": "ping"}\n\n{"method": "note"}\n{"id": 2, "method": "tools/call", "params": {"name": "explain", "arguments": {"id": "clone"}}}\n'), sink)
    assert [json.loads(x)["id"] for x in sink.getvalue().splitlines()] == [1, 2]


def test_saved_reports(tmp_path):
    doc = {"kind": "audit", "verdict": "fail", "score": [{"score": 81.25, "grade": "B"}], "findings": [{"path": "a.luau", "line": 3, "name": "f", "rule": "high-crap"}], "unused_files": [{"path": "b.luau"}], "clone_groups": [{}, {}]}
    p = tmp_path / "r.json"
    p.write_text(json.dumps(doc))
    assert json.loads(render_report(p, "json")) == json.loads(render_report(p, "compact")) == doc and "\n" not in render_report(p, "compact")
    text = render_report(p, "markdown")
    for part in ("**Verdict:** `fail`", "**Health score:** 81.2 (B)", "- `a.luau:3` high-crap f", "- `b.luau`", "## Clones (2)"):
        assert part in text
    with pytest.raises(ValueError):
        render_report(p, "xml")


def test_other_tools_comments_do_not_silence_findings(spark):
    src = "-- other-ignore-file\n-- lint-ignore-next-line\nlocal x = 1\n"
    assert [m["line"] for m in extract_source("m", src)["markers"]] == [2]
    assert [m["line"] for m in extract_source("m", src, ("other",))["markers"]] == [1]
    conf = from_dict({"suppressed_by": ["other"]})
    assert Project(spark, from_pairs(spark, {"m.luau": src}), conf).markers.count() == 1 and Config().suppressed_by == ["loomlens", "lint"]


def test_an_exact_path_among_many_of_its_name(spark):
    files = {f"f{i:02d}/x.luau": "return {}\n" for i in range(25)} | {"x.luau": "return {}\n", "z/only.luau": "return {}\n"}
    p = Project(spark, from_pairs(spark, files))
    assert p.target("x.luau") == "x.luau" and p.target("./only.luau") == "z/only.luau"
    doc = p.inspect("x.luau")
    assert (doc["fan_in"], doc["fan_out"], doc["symbol"]) == (0, 0, None)
    del files["x.luau"]
    with pytest.raises(ValueError, match=r"ambiguous: f00/x.luau, .*f19/x.luau \.\.\."):
        Project(spark, from_pairs(spark, files)).target("x.luau")


def suffix_array_clones(files, m, min_lines):
    """Groups by sorting all suffixes of all tokens: {fingerprint: (tokens, lines, instances)}"""
    corpus = []
    for i, (path, text) in enumerate(sorted(files.items())):
        tokens = extract_source(path, text)["tokens"]
        corpus += [(t["text"], t["line"], t["end_line"], i) for t in tokens] + [(f"\0EOF:{i}", 1, 1, i)]
    paths, texts, out = sorted(files), [t[0] for t in corpus], {}
    order = sorted(range(len(corpus)), key=lambda k: texts[k:])
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(texts) and texts[a + n] == texts[b + n] and not texts[a + n].startswith("\0"):
            n += 1
        la, lb = corpus[a][1], corpus[b][1]
        if n < m or (corpus[a][3] == corpus[b][3] and corpus[a + n - 1][1] >= lb and corpus[b + n - 1][1] >= la and abs(la - lb) < min_lines):
            continue
        spans = [(paths[corpus[k][3]], corpus[k][1], corpus[k + n - 1][2]) for k in (a, b)]
        if min(e - s + 1 for _, s, e in spans) < min_lines:
            continue
        group = out.setdefault(clones.fingerprint(texts[a : a + n]), [n, max(e - s + 1 for _, s, e in spans), []])
        group[2] += [x for x in spans if x not in group[2]]
    return {f: (n, lines, at) for f, (n, lines, at) in out.items() if len(at) > 1}


def test_clones_equal_those_of_a_suffix_array(spark):
    body = [f"local v{i} = a(b)" for i in range(14)]
    one, two = "\n".join([*body, "local p = 1", "foo(p)"]), "\n\n".join([*body, "local q = 2", "bar(q)"])
    loop = "x = x + 1\n" * 30
    sets = [{"a.luau": one, "b.luau": one, "c.luau": two, "d.luau": two, "e.luau": "return 1\n"}, {"a.luau": loop, "b/c.luau": loop + "y = 2\n", "b.luau": ""}, {"a.luau": "return 1\n"}, {f"f{i}.luau": one for i in range(12)}]
    for files in sets:
        for m, lines in ((20, 3), (60, 5)):
            d = Project(spark, from_pairs(spark, files)).dupes(min_tokens=m, min_lines=lines)
            got = {r["fingerprint"]: (r["token_count"], r["line_count"], [tuple(i) for i in r["instances"]]) for r in d["clone_groups"].collect()}
            want = suffix_array_clones(files, m, lines)
            assert got == want
            stats = d["stats"].first()
            assert (stats["clone_groups"], stats["clone_instances"]) == (len(want), sum(len(x[2]) for x in want.values()))
    assert clones.fingerprint(["a", "b"]) == f"dup:{fnv(b'a' + bytes(1) + b'b'):08x}"


def test_clones_across_tasks_and_batches(spark):
    """A block in every file: its suffixes lie in several tasks and batches, and files end within a clone."""
    block = "\n".join(f"local v{i} = a(b)" for i in range(6))
    files = {f"f{i:02}.luau": block + ("" if i % 4 == 0 else f"\nreturn v{i % 3}") for i in range(9)}
    rows = [(path, [(t["text"], t["line"], t["end_line"]) for t in extract_source(path, text)["tokens"]]) for path, text in files.items()]
    df = spark.createDataFrame(rows, "path string, tokens array<struct<text:string,line:int,end_line:int>>")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["fingerprint"]: (r["token_count"], r["line_count"], [tuple(i) for i in r["instances"]]) for r in clones.clone_groups(df, 12, 2).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == suffix_array_clones(files, 12, 2)


def fnv(raw):
    h = 2_166_136_261
    for c in raw:
        h = ((h ^ c) * 16_777_619) % (1 << 32)
    return h


def test_numbers_of_files(spark):
    paths = ["b/a", "a/z", "a", "b", "a/b/c", "Z", "c-1", "c/1"]
    got = clones.numbered(spark.createDataFrame([(p,) for p in paths], "path string").repartition(3)).collect()
    assert [r["path"] for r in sorted(got, key=lambda r: r["file_idx"])] == sorted(paths, key=lambda p: p.split("/")) and {r["file_idx"] for r in got} == set(range(8))


def test_blobs_and_the_page(spark, tree, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init")
    for name, text in {"a.luau": "return 1\n", "empty.luau": "", "ä b.luau": "-- é\n\n"}.items():
        (tmp_path / name).write_text(text)
    run("add", ".")
    run("commit", "-m", "one")
    assert git.snapshot(tmp_path, "HEAD") == {"a.luau": "return 1\n", "empty.luau": "", "ä b.luau": "-- é\n\n"} and git.blobs(tmp_path, []) == []
    page = viz.render(Project(spark, from_pairs(spark, FILES)))
    assert page.lstrip().lower().startswith("<!doctype html") and "init.luau" in page and "a.luau" in page


def test_the_tree_stream_tells_of_edits_in_place(tree):
    reader = watch._Reader(str(tree))
    rows, at = reader.read(reader.initialOffset())
    assert [n for _, n in rows] == [3] and list(reader.read(at)[0]) == []
    (tree / "a.luau").write_text("return { k = 1, gone = 2 }\n")
    later = time.time() + 5
    os.utime(tree / "a.luau", (later, later))
    rows, after = reader.read(at)
    assert len(list(rows)) == 1 and after != at and list(reader.readBetweenOffsets(at, after)) and not list(reader.readBetweenOffsets(after, after))
