"""Sinks: chat, feedback-pair and demonstration exports, reports and the context cache."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import percent_of_hash
from textloom.operators.templates import ordered_messages, render


def chat_rows(messages: DataFrame, template: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation that has messages: id, template, text, message_count, messages."""
    m = messages.groupBy(conv).agg(ordered_messages(turn, role, text).alias("messages"))
    return m.where(F.size("messages") > 0).select(F.col(conv).alias("conversation_id"), F.lit(template).alias("template"), render(F.col("messages"), template).alias("text"), F.size("messages").alias("message_count"), "messages")


def export_chat(messages: DataFrame, path: str, template: str = "chatml", fmt: str = "jsonl") -> None:
    write(chat_rows(messages, template), path, fmt)


def feedback_pairs(events: DataFrame, sessions: DataFrame, audit: DataFrame, feedback: DataFrame) -> DataFrame:
    """Events (event_id, session_id, audit_id, feedback_id, ts) with what they point to; feedback beats audit.

    sessions: session_id, client, host; audit: audit_id, before, after; feedback: feedback_id, text, rating.
    """
    e = events.join(sessions, "session_id").join(audit, "audit_id", "left").join(feedback, "feedback_id", "left")
    told = F.col("feedback_id").isNotNull()
    kind = F.when(told, "feedback").when(F.col("audit_id").isNotNull(), "audit")
    return e.where(kind.isNotNull()).select("event_id", "session_id", "client", "host", kind.alias("kind"), F.when(told, F.col("text")).otherwise(F.col("before")).alias("response"), F.when(~told, F.col("after")).alias("after"), F.when(told, F.col("rating")).alias("rating"), "ts")


def export_demonstrations(rows: DataFrame, path: str, hash_col: str = "content_hash", held_out: float = 0.1, sources: list[str] | None = None, fmt: str = "jsonl") -> None:
    """path/train and path/held_out by the hash of the stored hash; an empty list of sources exports none."""
    if sources is not None:
        rows = rows.where(F.col("source").isin(sources)) if sources else rows.where(F.lit(False))
    out = percent_of_hash(F.col(hash_col)) < int(held_out * 100)
    write(rows.where(~out), f"{path}/train", fmt)
    write(rows.where(out), f"{path}/held_out", fmt)


def write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt not in ("jsonl", "parquet"):
        raise ValueError("fmt: jsonl or parquet")
    writer = df.write.mode("overwrite")
    writer.json(path) if fmt == "jsonl" else writer.parquet(path)


def markdown_report(title: str, df: DataFrame, most: int = 200) -> str:
    """A small table as Markdown; rows beyond `most` are counted, not shown."""
    rows = df.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
    return "\n".join([*lines, *(["", f"More than {most} rows."] if len(rows) > most else [])]) + "\n"


def context_key(dataset: str, model: str, hashes: list[str]) -> str:
    """The name of a cached context: its dataset, its model and the texts that it was made of."""
    return hashlib.sha256(json.dumps([dataset, model, sorted(hashes)]).encode()).hexdigest()


def build_context(chunks: DataFrame, id_col: str, text_col: str, most: int = 50) -> str:
    """The first `most` chunks by id, joined by blank lines."""
    return "\n\n".join(r[0] or "" for r in chunks.orderBy(id_col).limit(most).select(text_col).collect())


def stale_contexts(contexts: DataFrame, changed: DataFrame) -> DataFrame:
    """Contexts (key, hashes) that hold a hash of changed (hash)."""
    held = contexts.select("key", F.explode("hashes").alias("hash"))
    return contexts.join(held.join(changed, "hash", "left_semi").select("key").distinct(), "key", "left_semi")
