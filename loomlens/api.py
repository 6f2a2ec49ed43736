"""Reports as JSON-ready documents: what the command line and the tool server share."""

from __future__ import annotations

from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import health, scope
from .plans import explain, viz
from .plans.project import HealthOptions, Project
from .sources import baseline, git
from .sources.config import from_dict, load_config
from .sources.files import from_pairs, source_files


def plain(x):
    if isinstance(x, DataFrame):
        return [plain(r.asDict(True)) for r in x.toLocalIterator()]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def load(spark: SparkSession, root: str, churn: bool = False, since_days: float = 180) -> Project:
    commits = git.churn(spark, root, since_days) if churn else None
    return Project(spark, source_files(spark, root), load_config(root), commits)


def report(spark: SparkSession, name: str, root: str = ".", **o) -> dict:
    """Any report by name; options as on the command line."""
    if name == "schema":
        return explain.manifest() | ({"_meta": explain.meta("schema")} if o.get("explain") else {})
    if name == "explain":
        return explain.explain_rule(o["rule"])
    if name == "viz":
        out = Path(o.get("out") or Path(root) / "viz.html")
        out.write_text(viz.render(load(spark, root)))
        return {"path": str(out)}
    p = load(spark, root, churn=name == "health", since_days=o.get("since_days", 180))
    sections: dict = {
        "list": lambda: p.listing(), "flags": lambda: {"flags": p.flags()}, "suppressions": lambda: p.suppressions(),
        "dead-code": lambda: p.dead_code(o.get("entry")), "dupes": lambda: p.dupes(o.get("min_tokens"), o.get("min_lines"), o.get("min_occurrences") or 2),
        "inspect": lambda: p.inspect(o["path"], o.get("symbol")), "trace": lambda: p.trace(o["path"], o.get("key"), o.get("depth", 3)),
        "health": lambda: _health(p, o), "audit": lambda: _audit(spark, p, root, o),
    }
    if name not in sections:
        raise ValueError(f"unknown report {name}")
    doc = {"schema_version": 1, "kind": name, "root": str(root)} | plain(sections[name]())
    if o.get("explain"):
        doc["_meta"] = explain.meta(name)
    return doc


def _health(p: Project, o: dict) -> dict:
    """Sections that were asked for, all if none was; --score alone leaves hotspots out."""
    asked = [s for s in ("score", "hotspots", "targets") if o.get(s)]
    known = {f.name for f in fields(HealthOptions)}
    opts = HealthOptions(**(vars(p.config.health) | {k: v for k, v in o.items() if k in known and v is not None and k not in ("score", "hotspots", "targets", "baseline")}))
    if asked:
        opts.score, opts.hotspots, opts.targets = (s in asked for s in ("score", "hotspots", "targets"))
    out = p.health(opts)
    if o.get("save_baseline") and "targets" in out:
        baseline.save_baseline(o["save_baseline"], [r["key"] for r in out["targets"].select("key").toLocalIterator()])
    if o.get("baseline") and "targets" in out:
        known_keys = p.spark.createDataFrame([(k,) for k in baseline.load_baseline(o["baseline"])], "key string")
        out["targets"] = health.in_order(scope.not_listed(out["targets"], known_keys))
    return out


def _audit(spark: SparkSession, p: Project, root: str, o: dict) -> dict:
    ref, gate = o.get("changed_since"), o.get("gate") or "new-only"
    if not ref:
        return p.audit(gate="all")
    base = None
    if gate == "new-only":
        snap = git.snapshot(root, ref)
        import json
        import tomllib

        conf = next((from_dict((json.loads if n.endswith("json") else tomllib.loads)(snap[n])) for n in ("loomlens.json", "loomlens.toml", ".loomlens.toml") if n in snap), None)
        base = Project(spark, from_pairs(spark, {k: v for k, v in snap.items() if k.endswith((".lua", ".luau"))}), conf)
    return p.audit(git.changed_files(root, ref), base, gate)
