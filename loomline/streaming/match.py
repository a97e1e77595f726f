"""Matching a stream against a fixed catalog (ST3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.functions import tokens as T
from loomline.operators.lines import distinct_shapes, with_tokens
from loomline.operators.matching import match_lines
from loomline.options import MinerOptions


def match_batch(lines: DataFrame, templates: DataFrame, options: MinerOptions,
                strategy: str = "always", text_col: str = "text", id_col: str = "line_id"
                ) -> DataFrame:
    """Lines with their ``template_id``, NULL where no template fits. Distinct
    shapes are matched once and joined back."""
    tokenized = with_tokens(lines, options, text_col)
    matched = match_lines(distinct_shapes(tokenized, (), id_col), templates, options, strategy)
    tagged = tokenized.withColumn("shape_id", T.content_id(F.col("tokens"))).drop("tokens")
    return tagged.join(matched.select("shape_id", "template_id"), "shape_id", "left").drop("shape_id")


def stream_match(lines: DataFrame, templates: DataFrame, options: MinerOptions, path: str,
                 checkpoint: str, strategy: str = "always", text_col: str = "text",
                 trigger: dict | None = None) -> StreamingQuery:
    """Match each micro-batch and write it to ``path`` as ``batch=<id>``.

    The match is the batch join, so the catalog may be of any size; no state is
    kept, and a replayed batch replaces its own folder.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        matched = match_batch(batch, templates, options, strategy, text_col)
        matched.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (lines.writeStream.foreachBatch(step)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
