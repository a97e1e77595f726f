"""Parse, clean, mine and score several labelled datasets in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomline.functions.masks import delete_patterns, replace_patterns
from loomline.operators.evaluate import score_counts, size_counts
from loomline.options import MinerOptions
from loomline.plans.mining import Mined, assign_lines, mine_templates
from loomline.session import stage
from loomline.sources.lines import parse_format


@dataclass(frozen=True)
class Dataset:
    """One labelled dataset: header format, cleaning patterns and its lines
    ``(line_id, text, event_id)``."""

    name: str
    lines: DataFrame
    log_format: str = "<Content>"
    delete: Sequence[str] = field(default=())
    replace: Sequence[str] = field(default=())


def prepare(datasets: Sequence[Dataset], options: MinerOptions) -> DataFrame:
    """Parsed and cleaned lines of all datasets with a ``dataset`` column.
    Lines that do not fit their format have no text and are ``rejected``."""
    parts = []
    for d in datasets:
        parsed, rejected = parse_format(d.lines, d.log_format, keep=("line_id", "event_id"))
        # One step at a time: each pattern names its input more than once.
        text = parsed.withColumn("_text", delete_patterns(F.col("Content"), d.delete)).select(
            "line_id", "event_id", replace_patterns(F.col("_text"), d.replace, options.wildcard)
            .alias("text"), F.lit(False).alias("rejected"))
        lost = rejected.select("line_id", "event_id", F.lit(None).cast("string").alias("text"),
                               F.lit(True).alias("rejected"))
        parts.append(text.unionByName(lost).withColumn("dataset", F.lit(d.name)))
    return reduce(DataFrame.unionByName, parts)


def benchmark_run(datasets: Sequence[Dataset], options: MinerOptions
                  ) -> tuple[DataFrame, Mined]:
    """Returns (scores per dataset, mined result). Scores: lines, exact lines,
    accuracy (all over the parsed lines), clusters, and rejected lines."""
    prepared = stage(prepare(datasets, options), "benchmark")
    lines = prepared.filter("NOT rejected").drop("rejected")
    mined = mine_templates(lines, options, ["dataset"])
    assigned = assign_lines(lines, mined, options, ["dataset"])
    counts = size_counts(assigned.groupBy(
        "dataset", F.col("template_id").alias("cluster_id"), "event_id")
        .agg(F.count("*").alias("common")), ["dataset"])
    scores = score_counts(counts, ["dataset"])
    clusters = mined.templates.groupBy("dataset").agg(F.count("*").alias("clusters"))
    rejected = prepared.groupBy("dataset").agg(F.count_if("rejected").alias("rejected"))
    return scores.join(clusters, "dataset").join(rejected, "dataset"), mined
