"""Chat templates as expressions over array<struct<role, content>>; a final line break is dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ["alpaca", "chatml", "gemma", "llama3", "qwen", "vicuna"]


def render(messages: Column, name: str) -> Column:
    def each(f):
        return F.array_join(F.transform(messages, f), "")

    role, content = (lambda m: m["role"]), (lambda m: F.coalesce(m["content"], F.lit("")))
    if name in ("chatml", "qwen"):
        return F.concat(each(lambda m: F.concat(F.lit("<|im_start|>"), role(m), F.lit("\n"), content(m), F.lit("<|im_end|>\n"))), F.lit("<|im_start|>assistant"))
    if name == "llama3":
        return F.concat(F.lit("<|begin_of_text|>"), each(lambda m: F.concat(F.lit("<|start_header_id|>"), role(m), F.lit("<|end_header_id|>\n\n"), content(m), F.lit("<|eot_id|>"))), F.lit("<|start_header_id|>assistant<|end_header_id|>\n"))
    if name == "gemma":
        return F.concat(each(lambda m: F.concat(F.lit("<start_of_turn>"), F.when(role(m) == "system", "user").otherwise(role(m)), F.lit("\n"), content(m), F.lit("<end_of_turn>\n"))), F.lit("<start_of_turn>model"))
    if name == "vicuna":
        return F.concat(each(lambda m: F.when(role(m) == "system", F.concat(content(m), F.lit("\n\n"))).when(role(m) == "user", F.concat(F.lit("USER: "), content(m), F.lit("\n"))).when(role(m) == "assistant", F.concat(F.lit("ASSISTANT: "), content(m), F.lit("\n"))).otherwise("")), F.lit("ASSISTANT:"))
    if name == "alpaca":
        return F.concat(each(lambda m: F.when(role(m) == "system", F.concat(content(m), F.lit("\n\n"))).when(role(m) == "user", F.concat(F.lit("### Instruction:\n"), content(m), F.lit("\n\n"))).when(role(m) == "assistant", F.concat(F.lit("### Response:\n"), content(m), F.lit("\n\n"))).otherwise("")), F.lit("### Response:"))
    raise ValueError(f"no template {name}")


def ordered_messages(turn: str, role: str, text: str) -> Column:
    """Aggregate: a conversation's messages by turn."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
