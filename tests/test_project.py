"""Reports over a small project."""

import json
import subprocess

import pytest

from loomlens.operators import graph
from loomlens.plans.project import HealthOptions, Project
from loomlens.sources import baseline, git
from loomlens.sources.config import Config, Zone, init_config, load_config
from loomlens.sources.files import from_pairs, source_files

FILES = {
    "init.luau": 'local a = require("./a")\nlocal b = require("./b")\nreturn { run = function() return a.keep() + b.x end }\n',
    "a.luau": 'local M = require("./b")\nlocal unused = 1\nlocal function deep(x)\n  if x then\n    for i = 1, 3 do\n      if i and x or i then print(i) elseif x then print(x) end\n    end\n  else\n    print(1)\n  end\nend\nreturn { keep = function() return deep(M.x) end, drop = 1 }\n',
    "b.luau": 'local a = require("./a")\ntype Never = number\ntype Used = string\nlocal z: Used = "q"\nreturn { x = z, y = a.keep }\n',
    "orphan.luau": "-- lint-ignore-file unused-file\nreturn {}\n",
    "orphan2.luau": "return { q = 1 }\n",
    "a.spec.luau": 'local a = require("./a")\nif FF_New then a.keep() end\n',
}


@pytest.fixture(scope="module")
def project(spark):
    commits = spark.createDataFrame([("a.luau", 1_700_000_000 - 86_400 * d) for d in (1, 2, 3)], "path string, ts long")
    return Project(spark, from_pairs(spark, FILES), commits=commits)


def names(df):
    return [(r["path"], r["name"]) for r in df.collect()]


def test_dead_code(project):
    d = project.dead_code()
    assert names(d["unused_files"]) == [("orphan2.luau", "orphan2.luau")]
    assert names(d["unused_exports"]) == [("a.luau", "drop"), ("b.luau", "y"), ("orphan2.luau", "q")]
    assert names(d["unused_locals"]) == [("a.luau", "unused")]
    assert names(d["unused_types"]) == [("b.luau", "Never")]
    assert [r["cycle"] for r in d["circular_dependencies"].collect()] == [["a.luau", "b.luau", "a.luau"]]


def test_health(project):
    h = project.health(HealthOptions(now=1_700_000_000, max_cyclomatic=7, max_cognitive=12))
    s = {r["path"]: r for r in h["file_scores"].collect()}
    assert (s["a.luau"]["total_cyclomatic"], s["a.luau"]["total_cognitive"], s["a.luau"]["fan_in"]) == (8, 12, 3)
    assert [(r["name"], r["rule"]) for r in h["findings"].collect()] == [("deep", "high-complexity")]
    hot = h["hotspots"].first()
    assert hot["path"] == "a.luau" and hot["score"] == 100.0 and hot["trend"] == "accelerating"
    t = h["targets"].collect()
    assert [r["path"] for r in t] == ["a.luau"] and t[0]["evidence"]["direct_callers"] == ["a.spec.luau", "b.luau", "init.luau"]
    assert h["score"].first()["penalties"]["circular_deps"] == 25.0


def test_trace_and_inspect(project):
    c = project.trace("a.luau", "keep")["callers"].collect()
    assert [(r["src"], r["line"]) for r in c if r["depth"] == 1] == [("a.spec.luau", 2), ("b.luau", 5), ("init.luau", 3)]
    assert project.trace("a.luau", depth=0)["callees"].count() == 0
    assert project.inspect("a.luau", "deep")["functions"].first()["cyclomatic"] == 7
    with pytest.raises(ValueError, match="functions: deep"):
        project.inspect("a.luau", "nothing")
    with pytest.raises(ValueError, match="no such file"):
        project.target("x.luau")


def test_flags_listing_and_suppressions(project):
    assert [(r["path"], r["name"]) for r in project.flags().collect()] == [("a.spec.luau", "FF_New")]
    assert project.listing()["counts"].first().asDict() == {"edges": 5, "unresolved": 0, "files": 6}
    assert project.suppressions()["totals"].first().asDict() == {"files": 1, "markers": 1}


def test_boundaries(spark):
    files = from_pairs(spark, {"ui/a.luau": 'local b = require("../core/b")\nreturn {}\n', "core/b.luau": "return {}\n"})
    zones = [Zone("ui", ["ui/**"]), Zone("core", ["core/**"])]
    assert Project(spark, files, Config(boundaries=zones)).boundaries().count() == 1
    zones[0].allow_imports_from = ["core"]
    assert Project(spark, files, Config(boundaries=zones)).boundaries().count() == 0
    zones[0].allow_imports_from = ["elsewhere"]
    with pytest.raises(ValueError, match="unknown zone"):
        Project(spark, files, Config(boundaries=zones)).boundaries()


def test_module_paths_and_self(spark):
    files = from_pairs(spark, {"init.luau": 'require("@self/x")\nrequire("./gone")\n', "x.luau": 'require("./deep/b.c")\n', "deep/b.c.luau": "return {}\n", "deep/init.lua": 'require("./x")\nrequire("@self/b.c")\n'})
    got = {(r["from"], r["specifier"]): r["to"] for r in Project(spark, files).edges.collect()}
    assert got == {("init.luau", "@self/x"): "x.luau", ("init.luau", "./gone"): None, ("x.luau", "./deep/b.c"): "deep/b.c.luau", ("deep/init.lua", "./x"): "x.luau", ("deep/init.lua", "@self/b.c"): "deep/b.c.luau"}


def test_clones_and_audit(spark):
    body = "\n".join(f"local v{i} = f{i}(a, b) + {i}" for i in range(12)) + "\n"
    now = Project(spark, from_pairs(spark, {"a.luau": body, "b.luau": "--x\n" + body, "c.luau": "-- lint-ignore-file duplicates\n" + body, "main.luau": 'require("./a")\nrequire("./b")\nrequire("./c")\n'}))
    d = now.dupes(min_tokens=30, min_lines=3)
    g = d["clone_groups"].collect()
    assert g and all({i["path"] for i in r["instances"]} <= {"a.luau", "b.luau"} for r in g)
    assert d["stats"].first()["duplicated_lines"] == 24
    with pytest.raises(ValueError):
        now.dupes(min_tokens=0)


def test_attribution_against_a_base(spark):
    one = {"main.luau": "local old = 1\nreturn {}\n"}
    base = Project(spark, from_pairs(spark, one))
    now = Project(spark, from_pairs(spark, one | {"lost.luau": "return {}\n"}))
    a = now.audit(base=base)
    assert [(r["kind"], r["path"], r["introduced"]) for r in a["issues"].collect()] == [("unused_file", "lost.luau", True), ("unused_local", "main.luau", False)]
    assert a["verdict"] == "fail" and now.audit(["main.luau"], base)["verdict"] == "pass" and now.audit(["main.luau"])["verdict"] == "warn"


def test_files_git_and_config(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.luau").write_text("return {}\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.lua").write_text("return {}\n")
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init")
    run("add", "src")
    run("commit", "-m", "one")
    (tmp_path / "new.luau").write_text("return 1\n")
    assert sorted(r["path"] for r in source_files(spark, str(tmp_path)).collect()) == ["new.luau", "src/a.luau"]
    assert git.changed_files(tmp_path, "HEAD") == ["new.luau"]
    assert git.snapshot(tmp_path, "HEAD") == {"src/a.luau": "return {}\n"}
    assert [p for p, _ in git.churn_rows(tmp_path)] == ["src/a.luau"] and git.churn_rows(tmp_path / "gone") == []
    with pytest.raises(ValueError):
        git.resolve(tmp_path, "--all")
    init_config(tmp_path, "toml")
    assert load_config(tmp_path) == Config()
    with pytest.raises(FileExistsError):
        init_config(tmp_path)
    baseline.save_baseline(tmp_path / "x/b.json", ["k"])
    assert baseline.load_baseline(tmp_path / "x/b.json") == ["k"]
    (tmp_path / "bad.json").write_text(json.dumps({"schema_version": 2, "keys": []}))
    with pytest.raises(ValueError):
        baseline.load_baseline(tmp_path / "bad.json")


def test_loops_equal_the_small_graph_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 1), (4, 7)], "src int, dst int")
    s = spark.createDataFrame([(2,)], "node int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.scc(e, 0)) == rows(graph.scc(e)) == [(1, 1), (2, 1), (3, 1), (5, 5)]
    assert rows(graph.reachable(e, s, 0)) == rows(graph.reachable(e, s)) == [(1,), (2,), (3,), (4,), (7,)]


def test_a_long_chain_is_walked_round_by_round(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(20, 3)], "src int, dst int")
    s = spark.createDataFrame([(0,), (99,)], "node int")
    assert sorted(r[0] for r in graph.reachable(e, s, 0).collect()) == [*range(12), 99]


def test_everything_of_an_empty_project(spark):
    p = Project(spark, from_pairs(spark, {"x.luau": ""}).limit(0))
    assert p.health()["score"].first()["grade"] == "A" and p.dead_code()["findings"].count() == 0 and p.audit()["verdict"] == "pass"
