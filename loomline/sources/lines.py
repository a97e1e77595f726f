"""Line sources and header parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from loomline.functions.patterns import FLAGS, SPACE, header_pattern, quote
from loomline.functions.tokens import (
    SEP, escape_marks, rstrip_space, strip_space, tokenize, unescape_marks)
from loomline.session import stage


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text files to ``(source, block, value)``: one row per line, right-trimmed.

    ``block`` is the byte offset of the file split a line was read from; give
    dense ids with ``number_file_lines``. Undecodable bytes are dropped.
    """
    raw = spark.read.text(path if isinstance(path, str) else list(path))
    value = F.col("value")
    decodable = F.when(F.is_valid_utf8(value), value).otherwise(
        F.replace(F.make_valid_utf8(value), F.lit("\ufffd"), F.lit("")))
    text = rstrip_space(decodable)
    return raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        text.alias("text"))


def split_text(documents: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Explode multi-line texts to ``(id, line_no, text)``, one row per line."""
    exploded = documents.select(
        F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    return exploded.select(
        id_col, (F.col("pos") + 1).cast("long").alias("line_no"),
        rstrip_space(F.col("line")).alias("text"))


def strip_header(text: Column, prefixes: Sequence[str] = ("po-", "fsp-"), skip: int = 5) -> Column:
    """Drop the first ``skip`` tokens when token 2 starts with a prefix."""
    starts = "|".join(quote(prefix) for prefix in prefixes)
    is_header = text.rlike(f"{FLAGS}(?i)^{SPACE}*[^\\s]+{SPACE}+(?:{starts})")
    rest = F.slice(tokenize(text), F.lit(skip + 1), F.lit(2**31 - 1))
    return F.when(is_header, F.array_join(rest, " ")).otherwise(text)


def parse_format(lines: DataFrame, log_format: str, text_col: str = "text",
                 keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Split lines by a header format; returns (parsed, rejected).

    Every ``<Name>`` of the format is a string column. ``keep`` names input
    columns to carry along. All fields come out of one match: they are written
    next to each other with a separator and split; a separator in the line itself
    is escaped before.
    """
    names, regex = header_pattern(log_format)
    text = escape_marks(strip_space(F.col(text_col)))
    fits = text.rlike(regex)
    pick = SEP.join(f"${{f{i}}}" for i in range(len(names)))
    values = F.split(F.regexp_replace(text, regex, pick), SEP, -1)
    parsed = lines.filter(fits).select(*keep, values.alias("_values")).select(
        *keep, *[unescape_marks(F.col("_values")[i]).alias(n) for i, n in enumerate(names)])
    rejected = lines.filter(~F.coalesce(fits, F.lit(False)))
    return parsed, rejected


def _with_offsets(counted: DataFrame, runs: Sequence[str], id_col: str) -> DataFrame:
    """Ids for rows that carry ``_mid``, consecutive inside each run.

    Only the table of runs (file splits or partitions) is ordered as a whole;
    lines are never ranked by a window, so a long run is no hot spot.
    """
    sizes = counted.groupBy(*runs).agg(F.count("*").alias("_rows"), F.min("_mid").alias("_start"))
    before = W.orderBy(*runs).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *runs, "_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    ids = (F.col("_mid") - F.col("_start") + F.col("_offset") + 1).cast("long")
    return (counted.join(offsets, list(runs)).withColumn(id_col, ids)
            .drop("_mid", "_start", "_offset"))


def number_lines(lines: DataFrame, order_cols: Sequence[str], id_col: str = "LineId") -> DataFrame:
    """Dense ids 1..n in the order of ``order_cols``.

    The lines are range partitioned and sorted once, and written with a counter
    per partition; the ids are the counter plus the rows of the partitions
    before.
    """
    ordered = (lines.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
               .withColumn("_mid", F.monotonically_increasing_id()))
    placed = stage(ordered, "ordered").withColumn("_part", F.shiftright("_mid", 33))
    return _with_offsets(placed, ["_part"], id_col).drop("_part")


def number_file_lines(lines: DataFrame, id_col: str = "LineId") -> DataFrame:
    """Dense ids over the output of ``read_lines``, in file order.

    A split holds one contiguous run of a file and is read by one task, so the
    order inside it is the order of a per-task counter; the counter is fixed by
    writing it once.
    """
    placed = stage(lines.withColumn("_mid", F.monotonically_increasing_id()), "lines")
    return _with_offsets(placed, ["source", "block"], id_col)
