"""Watching a tree: a stream whose offset is a digest of all paths and times, so edits in place count."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.files import NOISE


def snapshot(root: str) -> dict[str, int]:
    """path to time of change of every source file; the ignore list of a configuration does not apply."""
    out = {}
    for top, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in NOISE]
        for n in names:
            if n.endswith((".lua", ".luau")):
                p = os.path.join(top, n)
                try:
                    out[os.path.relpath(p, root)] = os.stat(p).st_mtime_ns
                except OSError:
                    continue
    return out


def digest(files: dict[str, int]) -> str:
    return hashlib.sha256(json.dumps(sorted(files.items())).encode()).hexdigest()


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"digest": "", "files": 0}

    def read(self, start: dict):
        files = snapshot(self.root)
        now = {"digest": digest(files), "files": len(files)}
        rows = [] if now["digest"] == start["digest"] else [(now["digest"], now["files"])]
        return iter(rows), now

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([] if start["digest"] == end["digest"] else [(end["digest"], end["files"])])


class TreeSource(DataSource):
    """``spark.readStream.format("source_tree").option("root", ...)``: one row whenever the tree differs."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "digest string, files int"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options["root"])


def stream(spark: SparkSession, root: str):
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("source_tree").option("root", root).load()


def watch(spark: SparkSession, root: str, interval_ms: int = 1000, changed_since: str | None = None, sink=None):
    """Audit again after every change; runs until it is stopped."""
    from .. import api

    def audit(batch, _epoch) -> None:
        if not batch.isEmpty():
            doc = api.report(spark, "audit", root, changed_since=changed_since)
            (sink or (lambda d: print(json.dumps(d, default=str), flush=True)))(doc)

    q = stream(spark, root).writeStream.trigger(processingTime=f"{max(interval_ms, 200)} milliseconds").foreachBatch(audit).start()
    if sink is not None:
        return q
    q.awaitTermination()
