"""Baselines of refactoring targets and saved reports."""

from __future__ import annotations

import json
from pathlib import Path

VERSION = 1


def save_baseline(path: str | Path, keys: list[str]) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps({"schema_version": VERSION, "keys": sorted(set(keys))}, indent=2) + "\n")


def load_baseline(path: str | Path) -> list[str]:
    data = json.loads(Path(path).read_text())
    if not isinstance(data, dict) or data.get("schema_version") != VERSION or not isinstance(data.get("keys"), list) or not all(isinstance(k, str) for k in data["keys"]):
        raise ValueError(f"{path}: not a baseline of version {VERSION}")
    return data["keys"]


def render_report(path: str | Path, form: str = "json") -> str:
    """A saved report again, as json, compact or markdown; nothing is analysed."""
    data = json.loads(Path(path).read_text())
    if form == "json":
        return json.dumps(data, indent=2)
    if form == "compact":
        return json.dumps(data, separators=(",", ":"))
    if form == "markdown":
        return "\n".join(markdown(data))
    raise ValueError(f"unknown format {form}")


def _first(data: dict, *ways: tuple[str, ...]):
    """What lies at the first of some paths of keys that is there; a table of one row stands for its row."""
    for way in ways:
        at = data
        for key in way:
            at = at[0] if isinstance(at, list) and at else at
            at = at.get(key) if isinstance(at, dict) else None
        if at is not None:
            return at
    return None


def markdown(data: dict) -> list[str]:
    """Verdict, score, findings, unused files and the number of clones, each where the report has it."""
    out = [f"# {data.get('kind', 'saved')} report", ""]
    if verdict := _first(data, ("verdict",)):
        out += [f"**Verdict:** `{verdict}`", ""]
    if (score := _first(data, ("score", "score"), ("health", "score", "score"))) is not None:
        out += [f"**Health score:** {score:.1f} ({_first(data, ('score', 'grade'), ('health', 'score', 'grade')) or '?'})", ""]
    if (findings := _first(data, ("findings",), ("issues",), ("health", "findings"))) is not None:
        out += ["## Findings", "", *[f"- `{f.get('path', '?')}:{f.get('line', 0)}` {f.get('rule') or f.get('kind') or ''} {f.get('name') or ''}".rstrip() for f in findings], ""]
    if (unused := _first(data, ("unused_files",), ("dead_code", "unused_files"))) is not None:
        out += ["## Unused files", "", *[f"- `{u['path'] if isinstance(u, dict) else u}`" for u in unused], ""]
    if (groups := _first(data, ("clone_groups",), ("dupes", "clone_groups"))) is not None:
        out += [f"## Clones ({len(groups)})", ""]
    return [*out, "_Rendered from a saved report; nothing was analysed again._"]
