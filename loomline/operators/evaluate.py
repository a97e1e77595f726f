"""Scoring a grouping against labelled lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def joint_counts(grouped: DataFrame, labels: DataFrame, keys: Sequence[str] = (),
                 on: str = "line_id") -> DataFrame:
    """Lines per (cluster, label), with the sizes of both.

    The only shuffle of lines is the join by line id; everything after works on
    counts.
    """
    keys = list(keys)
    joint = (grouped.select(*keys, on, "cluster_id").join(
        labels.select(*keys, on, "event_id"), [*keys, on])
        .groupBy(*keys, "cluster_id", "event_id").agg(F.count("*").alias("common")))
    return size_counts(joint, keys)


def size_counts(joint: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(cluster_id, event_id, common)`` with the sizes of cluster and label."""
    keys = list(keys)
    by_cluster = joint.groupBy(*keys, "cluster_id").agg(
        F.sum("common").alias("cluster_lines"), F.count("*").alias("labels_inside"))
    by_label = joint.groupBy(*keys, "event_id").agg(F.sum("common").alias("label_lines"))
    return (joint.join(by_cluster, [*keys, "cluster_id"])
            .join(by_label, [*keys, "event_id"]))


def grouping_accuracy(grouped: DataFrame, labels: DataFrame, keys: Sequence[str] = ()
                      ) -> DataFrame:
    """Share of lines in clusters that hold exactly the lines of one label."""
    return score_counts(joint_counts(grouped, labels, keys), keys)


def score_counts(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy from the counts of ``size_counts``."""
    exact = ((F.col("common") == F.col("cluster_lines"))
             & (F.col("common") == F.col("label_lines")))
    return counts.groupBy(*keys).agg(
        F.sum("common").alias("lines"),
        F.sum(F.when(exact, F.col("common")).otherwise(0)).alias("exact_lines"),
        F.round(F.sum(F.when(exact, F.col("common")).otherwise(0)) / F.sum("common"), 4)
        .alias("accuracy"))


def grouping_errors(grouped: DataFrame, labels: DataFrame, keys: Sequence[str] = ()
                    ) -> DataFrame:
    """Every wrong (cluster, label) cell: ``impure`` clusters mix labels,
    ``incomplete`` ones miss lines of their label; ``missing`` counts those."""
    counts = joint_counts(grouped, labels, keys)
    wrong = (F.when(F.col("labels_inside") > 1, "impure")
             .when(F.col("cluster_lines") < F.col("label_lines"), "incomplete"))
    return (counts.withColumn("error", wrong).filter(F.col("error").isNotNull())
            .withColumn("missing", F.col("label_lines") - F.col("common"))
            .select(*keys, "cluster_id", "event_id", "error", "common", "cluster_lines",
                    "label_lines", "missing"))


def missing_lines(grouped: DataFrame, labels: DataFrame, cluster_id: str, event_id: str,
                  on: str = "line_id") -> DataFrame:
    """Lines of one label that one cluster lacks."""
    wanted = labels.filter(F.col("event_id") == event_id)
    return wanted.join(grouped.filter(F.col("cluster_id") == cluster_id), on, "left_anti")


# Fixed value: the wording of a summary line.
REPORT = (r"Evaluation on Dataset: (\S+), Group Accuracy: ([\d.]+), Duration: ([\d.]+) sec, "
          r"Total of (\d+) lines, rate ([\d.]+) lines/sec, (\d+) clusters")


def report_line(dataset: str = "dataset", accuracy: str = "accuracy", duration: str = "duration",
                lines: str = "lines", clusters: str = "clusters"):
    """One summary line per dataset as text."""
    def fixed(column, digits: int):
        return F.col(column).cast(f"decimal(30,{digits})").cast("string")

    rate = F.when(F.col(duration) > 0, F.col(lines) / F.col(duration)).otherwise(F.lit(0.0))
    return F.concat(
        F.lit("Evaluation on Dataset: "), F.col(dataset),
        F.lit(", Group Accuracy: "), fixed(accuracy, 4),
        F.lit(", Duration: "), fixed(duration, 2), F.lit(" sec, Total of "),
        F.col(lines).cast("string"), F.lit(" lines, rate "),
        rate.cast("decimal(30,1)").cast("string"), F.lit(" lines/sec, "),
        F.col(clusters).cast("string"), F.lit(" clusters"))


def result_table(report: DataFrame, text_col: str = "text") -> DataFrame:
    """Summary lines to a typed table; other lines are dropped."""
    text = F.col(text_col)

    def part(i: int, kind: str):
        return F.regexp_extract(text, REPORT, i).cast(kind)

    return report.filter(text.rlike(REPORT)).select(
        part(1, "string").alias("dataset"), part(2, "double").alias("group_accuracy"),
        part(3, "double").alias("duration_sec"), part(4, "long").alias("line_number"),
        part(5, "double").alias("lines_per_sec"), part(6, "long").alias("clusters"))
