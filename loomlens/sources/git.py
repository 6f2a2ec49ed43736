"""Version control: churn, changed files and snapshots. Churn fails silently, the others loudly."""

from __future__ import annotations

import subprocess
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .files import NOISE

SOURCES = ("*.lua", "*.luau")


def _git(root: str | Path, *args: str, text: bool = True):
    r = subprocess.run(["git", "-C", str(root), *args], capture_output=True, timeout=600)
    if r.returncode:
        raise RuntimeError(f"git {args[0]}: {r.stderr.decode(errors='replace').strip()}")
    return r.stdout.decode(errors="replace") if text else r.stdout


def churn_rows(root: str | Path, since_days: float = 180, now: int | None = None) -> list[tuple[str, int]]:
    now = int(time.time()) if now is None else now
    try:
        log = _git(root, "log", f"--since={int(since_days)} days ago", "--pretty=\1%ct", "--name-only", "--diff-filter=ACMR", "--", *SOURCES)
    except (RuntimeError, OSError, subprocess.SubprocessError):
        return []
    out, ts = [], 0
    for line in log.splitlines():
        if line.startswith("\1"):
            ts = int(line[1:])
        elif line and ts <= now:
            out.append((line, ts))
    return out


def churn(spark: SparkSession, root: str | Path, since_days: float = 180, now: int | None = None) -> DataFrame:
    return spark.createDataFrame(churn_rows(root, since_days, now), "path string, ts long")


def changed_files(root: str | Path, ref: str) -> list[str]:
    """Files changed since a revision, and untracked ones, each once, in order; folders that no scan enters are left out."""
    resolve(root, ref)
    diff = _git(root, "diff", "--name-only", "--relative", "-z", "--diff-filter=ACMR", ref, "--")
    new = _git(root, "ls-files", "--others", "--exclude-standard", "-z")
    return sorted({p for p in (diff + new).split("\0") if p.endswith((".lua", ".luau")) and not set(NOISE) & set(p.split("/"))})


def resolve(root: str | Path, ref: str) -> str:
    if ref.startswith("-"):
        raise ValueError(f"not a revision: {ref}")
    return _git(root, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}").strip()


def snapshot(root: str | Path, ref: str) -> dict[str, str]:
    """path to text of every source and configuration file at a revision, relative to root; no folder is written."""
    commit, found = resolve(root, ref), []
    for entry in filter(None, _git(root, "ls-tree", "-rz", commit).split("\0")):
        meta, path = entry.split("\t", 1)
        mode, _, blob = meta.split()
        if not path.endswith((".lua", ".luau")) and Path(path).name not in ("loomlens.json", "loomlens.toml", ".loomlens.toml"):
            continue
        if mode not in ("100644", "100755") or any(p in ("", ".", "..") for p in path.split("/")):
            raise ValueError(f"not a plain file: {path}")
        found.append((path, blob))
    return {path: body.decode() for (path, _), body in zip(found, blobs(root, [b for _, b in found]), strict=True)}


def blobs(root: str | Path, names: list[str]) -> list[bytes]:
    """Contents of many blobs through one process."""
    r = subprocess.run(["git", "-C", str(root), "cat-file", "--batch"], input="".join(f"{n}\n" for n in names).encode(), capture_output=True, timeout=600)
    if r.returncode:
        raise RuntimeError(f"git cat-file: {r.stderr.decode(errors='replace').strip()}")
    out, at = [], 0
    for n in names:  # each: a line of name, type and size, the content, and a line end
        end = r.stdout.index(b"\n", at)
        head = r.stdout[at:end].split()
        if len(head) != 3:
            raise RuntimeError(f"git cat-file: {n} is missing")
        at = end + 1 + int(head[2])
        out.append(r.stdout[end + 1 : at])
        at += 1
    return out
