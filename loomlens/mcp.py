"""A tool server: JSON-RPC, one message a line, over the same reports as the command line."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from . import api
from .session import session

TOOLS = {
    "schema": ("schema", "What there is: reports, rules and formats", {}), "list_project": ("list", "Files and the requires between them", {}),
    "check_health": ("health", "Complexity, maintainability, hotspots, targets and the score", {}), "find_dead_code": ("dead-code", "Unused files, exports, locals and types, cycles and boundaries", {}),
    "find_dupes": ("dupes", "Groups of equal code", {"min_tokens": "integer", "min_lines": "integer"}), "audit": ("audit", "All findings with a verdict: pass, warn or fail", {"changed_since": "string", "gate": "string"}),
    "explain": ("explain", "What a rule means", {"id": "string"}), "inspect": ("inspect", "All that is known of a file or a symbol", {"path": "string", "symbol": "string"}),
    "trace": ("trace", "Who requires whom", {"path": "string", "key": "string", "depth": "integer"}), "flags": ("flags", "Switches of behaviour", {}), "suppressions": ("suppressions", "Comments that suppress findings", {}),
}


def answer(message: dict, call) -> dict | None:
    """The reply to one message; none to a notification."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        reply["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "loomlens", "version": "1"}}
    elif method == "ping":
        reply["result"] = {}
    elif method == "tools/list":
        reply["result"] = {"tools": [{"name": n, "description": text, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in (p | {"root": "string"}).items()}}} for n, (_, text, p) in TOOLS.items()]}
    elif method == "tools/call":
        name, args = params.get("name"), params.get("arguments") or {}
        try:
            if name not in TOOLS:
                raise ValueError(f"unknown tool {name}")
            doc = call(TOOLS[name][0], {"rule" if k == "id" else k: v for k, v in args.items()})
            reply["result"] = {"content": [{"type": "text", "text": json.dumps(doc, default=str)}], "structuredContent": doc}
        except Exception as e:  # a tool's failure is its result
            reply["result"] = {"isError": True, "content": [{"type": "text", "text": str(e)}]}
    else:
        reply["error"] = {"code": -32601, "message": f"unknown method {method}"}
    return reply


def serve(source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    spark = None

    def call(name: str, args: dict) -> dict:
        nonlocal spark
        if name not in ("schema", "explain"):
            spark = spark or session()
        return api.report(spark, name, **({"explain": True} | args))

    for line in source:
        if line.strip():
            reply = answer(json.loads(line), call)
            if reply is not None:
                print(json.dumps(reply, default=str), file=sink, flush=True)
