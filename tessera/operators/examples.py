"""Instruction rows: template cycling, topics, rendering, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import render, topic
from tessera.operators.index import with_global_index

# --- fixed values (must equal the reference for equal results) -------------
# Instruction templates, cycled by global chunk position (row i -> i mod 8):
TEMPLATES = [
    "What information do you have about the following topic?",
    "Can you explain what you know about this subject?",
    "Please provide information on this topic:",
    "What can you tell me about this?",
    "Explain the following in detail:",
    "Share what you know about:",
    "Provide a detailed explanation of:",
    "What do you understand about this topic?",
]
PREVIEW_INSTRUCTION_CHARS = 150
PREVIEW_RESPONSE_CHARS = 300
# ---------------------------------------------------------------------------


def assign_template(df: DataFrame, order_by, templates=TEMPLATES,
                    idx_col: str = "example_id") -> DataFrame:
    """Global position i (idx_global) and template ``i mod len`` (txt_template_cycle)."""
    if not templates:
        raise ValueError("templates must not be empty")
    d = with_global_index(df, order_by, idx_col)
    arr = F.array(*[F.lit(t) for t in templates])
    return d.withColumn("template", F.element_at(arr, (F.col(idx_col) % len(templates) + 1).cast("int")))


def to_examples(chunks: DataFrame, order_by=("doc_id", "segment_no", "chunk_no"),
                templates=TEMPLATES, text_col: str = "text", keep=()) -> DataFrame:
    """instruction = template + ' ' + topic(chunk); response = chunk
    (txt_instruction).  ``example_id`` is the global chunk position."""
    d = assign_template(chunks, list(order_by), templates)
    return d.select("example_id", *keep,
                    F.concat_ws(" ", "template", topic(text_col)).alias("instruction"),
                    F.col(text_col).alias("response"))


def rendered(examples: DataFrame) -> DataFrame:
    """Training prompt text per example (txt_render)."""
    return examples.withColumn("prompt", render("instruction", "response"))


def preview(examples: DataFrame, n: int = 3, split: str | None = "train") -> DataFrame:
    """First ``n`` examples by id with cut text (top_preview); a top-k."""
    d = examples if split is None else examples.where(F.col("split") == split)
    return (d.orderBy("example_id").limit(n)
            .select("example_id",
                    F.substring("instruction", 1, PREVIEW_INSTRUCTION_CHARS).alias("instruction"),
                    F.substring("response", 1, PREVIEW_RESPONSE_CHARS).alias("response")))
