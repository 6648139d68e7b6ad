"""Chat logs to one message schema: conversation, turn, role, content, ts.

Files are read whole, one per row, so a conversation's order is its file's; parsing is per file in
Arrow batches.  Lines that do not parse are skipped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MESSAGES = "source_uri string, external_id string, turn int, role string, content string, tool_calls string, ts string"
Message = dict[str, Any]


def _lines(text: str) -> Iterator[Any]:
    for line in text.splitlines():
        if line.strip():
            try:
                yield json.loads(line)
            except ValueError:
                continue


def flatten(content: Any) -> tuple[str, list[Any]]:
    """Text of a string or list of blocks, and the tool calls among them; thoughts are marked."""
    if not isinstance(content, list):
        return ("" if content is None else str(content)), []
    texts, calls = [], []
    for b in content:
        if isinstance(b, str):
            texts.append(b)
        elif isinstance(b, dict):
            kind = b.get("type")
            if kind == "thinking":
                texts.append(f"[thinking] {b.get('thinking', '')}")
            elif kind in ("tool_use", "tool_result"):
                calls.append(b)
            elif "text" in b:
                texts.append(str(b["text"]))
    return "\n".join(texts), calls


def jsonl(text: str) -> Iterator[Message]:
    """{role, content, tool_calls?, ts?} a line."""
    for o in _lines(text):
        if isinstance(o, dict) and "role" in o:
            said, calls = flatten(o.get("content"))
            yield {"role": o["role"], "content": said, "tool_calls": o.get("tool_calls") or calls, "ts": o.get("ts")}


def session_log(text: str) -> Iterator[Message]:
    """Events by type: user, assistant and attachment become messages."""
    for o in _lines(text):
        if isinstance(o, dict) and o.get("type") in ("user", "assistant", "attachment"):
            inner = o.get("message") if isinstance(o.get("message"), dict) else o
            said, calls = flatten(inner.get("content"))
            yield {"role": inner.get("role") or o["type"], "content": said, "tool_calls": calls, "ts": o.get("timestamp"), "external_id": o.get("sessionId")}


def event_log(text: str) -> Iterator[Message]:
    """response_item events; a function call belongs to the assistant message before it."""
    out: list[Message] = []
    for o in _lines(text):
        p = o.get("payload") if isinstance(o, dict) else None
        if not isinstance(p, dict) or o.get("type") != "response_item":
            continue
        if p.get("type") == "message":
            said, calls = flatten(p.get("content"))
            out.append({"role": p.get("role"), "content": said, "tool_calls": calls, "ts": o.get("timestamp")})
        elif p.get("type") == "function_call":
            if not out or out[-1]["role"] != "assistant":
                out.append({"role": "assistant", "content": "", "tool_calls": [], "ts": o.get("timestamp")})
            out[-1]["tool_calls"].append({"name": p.get("name"), "arguments": p.get("arguments")})
    yield from out


def json_array(text: str) -> Iterator[Message]:
    """One array of {role or type, content or parts}; the role model is assistant."""
    try:
        rows = json.loads(text)
    except ValueError:
        return
    for o in rows.get("messages", []) if isinstance(rows, dict) else rows:
        role = o.get("role") or o.get("type")
        said, calls = flatten(o.get("content") if "content" in o else o.get("parts"))
        yield {"role": "assistant" if role in ("model", "gemini") else role, "content": said, "tool_calls": calls, "ts": o.get("timestamp")}


def tree_export(text: str) -> Iterator[Message]:
    """Conversations with a mapping of nodes: the chain from current_node to the root, reversed."""
    try:
        rows = json.loads(text)
    except ValueError:
        return
    for c in rows if isinstance(rows, list) else [rows]:
        chain, node, nodes = [], c.get("current_node"), c.get("mapping") or {}
        while node in nodes and len(chain) <= len(nodes):
            m = nodes[node].get("message")
            if m and (m.get("author") or {}).get("role") in ("user", "assistant"):
                parts = (m.get("content") or {}).get("parts") or []
                chain.append({"role": m["author"]["role"], "content": "\n".join(p for p in parts if isinstance(p, str)), "tool_calls": [], "ts": m.get("create_time"), "external_id": c.get("id")})
            node = nodes[node].get("parent")
        yield from reversed(chain)


FORMATS: dict[str, Callable[[str], Iterator[Message]]] = {"jsonl": jsonl, "session_log": session_log, "event_log": event_log, "json_array": json_array, "tree_export": tree_export}


def read_chat(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Messages of all files under a path, in one of FORMATS."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).selectExpr("_metadata.file_path as source_uri", "value")
    return parse_chat(files, fmt)


def parse_chat(files: DataFrame, fmt: str) -> DataFrame:
    """Messages of files (source_uri, value)."""
    parse = FORMATS[fmt]
    names = [c.split()[0] for c in MESSAGES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for uri, text in zip(f["source_uri"], f["value"], strict=True):
                turns: dict[Any, int] = {}
                for m in parse(text or ""):
                    key = m.get("external_id")
                    turn = turns[key] = turns.get(key, -1) + 1
                    ts = m.get("ts")
                    rows.append((uri, key, turn, m.get("role"), m["content"], json.dumps(m["tool_calls"]) if m.get("tool_calls") else None, None if ts is None else str(ts)))
            yield pd.DataFrame(rows, columns=names)

    return files.select("source_uri", "value").mapInPandas(run, MESSAGES)
