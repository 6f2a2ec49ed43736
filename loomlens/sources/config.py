"""Project configuration: JSON or TOML, every field with a default, unknown fields ignored."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

NAMES = ("loomlens.json", "loomlens.toml", ".loomlens.toml")


@dataclass
class Health:
    max_crap: float = 30.0
    max_cyclomatic: int = 20
    max_cognitive: int = 15
    max_unit_size: int = 60


@dataclass
class Duplicates:
    min_tokens: int = 30
    min_lines: int = 5


@dataclass
class Zone:
    name: str
    paths: list[str] = field(default_factory=list)
    allow_imports_from: list[str] = field(default_factory=list)


@dataclass
class Config:
    entry: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    health: Health = field(default_factory=Health)
    duplicates: Duplicates = field(default_factory=Duplicates)
    boundaries: list[Zone] = field(default_factory=list)
    suppressed_by: list[str] = field(default_factory=lambda: ["loomlens", "lint"])


def _known(kind, data: dict):
    return kind(**{k: v for k, v in data.items() if k in kind.__dataclass_fields__})


def from_dict(data: dict) -> Config:
    return Config(
        list(data.get("entry", [])), list(data.get("ignore", [])), _known(Health, data.get("health", {})), _known(Duplicates, data.get("duplicates", {})),
        [_known(Zone, z) for z in data.get("boundaries", [])], list(data.get("suppressed_by", Config().suppressed_by)),
    )


def load_config(root: str | Path) -> Config:
    for name in NAMES:
        p = Path(root) / name
        if p.exists():
            text = p.read_text()
            return from_dict(json.loads(text) if name.endswith(".json") else tomllib.loads(text))
    return Config()


def init_config(root: str | Path, form: str = "json") -> Path:
    """Write the defaults; refuse if a configuration exists."""
    for name in NAMES:
        if (Path(root) / name).exists():
            raise FileExistsError(f"{name} exists already")
    d = asdict(Config())
    p = Path(root) / ("loomlens.json" if form == "json" else "loomlens.toml")
    if form == "json":
        p.write_text(json.dumps(d, indent=2) + "\n")
    else:
        lines = ["entry = []", "ignore = []", "boundaries = []", f"suppressed_by = {json.dumps(d['suppressed_by'])}"]
        for part in ("health", "duplicates"):
            lines += ["", f"[{part}]", *[f"{k} = {v}" for k, v in d[part].items()]]
        p.write_text("\n".join(lines) + "\n")
    return p


def glob_regex(pattern: str) -> str:
    """A Java and Python regex: ``*`` and ``?`` stay within a path part, ``**`` crosses parts, {a,b} and [x] as usual."""
    p, out, i, open_ = pattern.replace("\\", "/"), "", 0, 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if p.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[":
            end = p.find("]", i + 2)
            if end < 0:
                raise ValueError(f"invalid glob {pattern!r}")
            body = p[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            continue
        if c == "{":
            open_ += 1
        if c == "}":
            open_ -= 1
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and open_ > 0 else re.escape(c))
        i += 1
    if open_:
        raise ValueError(f"invalid glob {pattern!r}")
    return f"^(?:{out})$"


def globs_regex(patterns: list[str]) -> str | None:
    return "|".join(map(glob_regex, patterns)) if patterns else None
