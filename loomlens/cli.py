"""Command line: ``python -m loomlens.cli health . --score``. One JSON document on stdout."""

from __future__ import annotations

import argparse
import json
import sys

from . import api
from .session import session
from .sources.baseline import render_report
from .sources.config import init_config, load_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomlens")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple) -> None:
        s = sub.add_parser(name)
        for names, kw in flags:
            s.add_argument(*names.split(), **kw)

    root, why = ("root", {"nargs": "?", "default": "."}), ("--explain", {"action": "store_true"})
    switch, num = {"action": "store_true"}, {"type": int}
    for name in ("list", "flags", "suppressions"):
        add(name, root, why)
    add("health", root, why, ("--score", switch), ("--hotspots", switch), ("--targets", switch), ("--since-days", {"type": float, "default": 180.0}), ("--min-commits", num), ("--max-crap", {"type": float}), ("--max-cyclomatic", num), ("--max-cognitive", num), ("--max-unit-size", num), ("--baseline", {}), ("--save-baseline", {}))
    add("dead-code", root, why, ("--entry", {"action": "append"}))
    add("dupes", root, why, ("--min-tokens", num), ("--min-lines", num), ("--min-occurrences", num))
    add("audit", root, why, ("--changed-since", {}), ("--gate", {"choices": ["new-only", "all"]}))
    add("inspect", ("path", {}), ("--symbol", {}), ("--root", {"default": "."}), why)
    add("trace", ("path", {}), ("--key", {}), ("--depth", {"type": int, "default": 3}), ("--root", {"default": "."}), why)
    add("viz", root, ("--out", {}))
    add("watch", root, ("--interval-ms", {"type": int, "default": 1000}), ("--changed-since", {}))
    add("report", ("file", {}), ("--format", {"choices": ["json", "compact", "markdown"], "default": "json"}))
    add("explain", ("rule", {}))
    add("config", root)
    add("init", root, ("--format", {"choices": ["json", "toml"], "default": "json"}))
    add("schema")
    add("mcp")
    return p


def main(argv: list[str] | None = None) -> int:
    a = vars(parser().parse_args(argv))
    command = a.pop("command")
    try:
        if command == "report":
            print(render_report(a["file"], a["format"]))
        elif command == "config":
            print(json.dumps(load_config(a["root"]), default=vars, indent=2))
        elif command == "init":
            print(json.dumps({"path": str(init_config(a["root"], a["format"]))}))
        elif command == "mcp":
            from .mcp import serve

            serve()
        elif command == "watch":
            from .streaming.watch import watch

            watch(session(), a["root"], a["interval_ms"], a["changed_since"])
        else:
            doc = api.report(None if command in ("schema", "explain") else session(), command, **a)
            print(json.dumps(doc, indent=2, default=str))
            return int(doc.get("verdict") == "fail")
    except (ValueError, OSError, RuntimeError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
