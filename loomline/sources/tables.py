"""Label readers and result writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

LABEL_SCHEMA = "line_id LONG, EventId STRING, EventTemplate STRING"
TEMPLATE_SCHEMA = "EventId STRING, EventTemplate STRING"


def read_labels(spark: SparkSession, path: str, schema: str = LABEL_SCHEMA,
                multi_line: bool = True) -> DataFrame:
    """CSV with a header row, read by the names in it, in any order and among other
    columns; quotes are doubled. With ``multi_line`` fields may hold newlines, and
    then a file is one task; without, files are split.

    A column of ``schema`` that the header lacks is an error.
    """
    found = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line).csv(path)
    wanted = StructType.fromDDL(schema)
    absent = [f.name for f in wanted if f.name not in found.columns]
    if absent:
        raise ValueError(f"label file lacks the columns {absent}; it has {found.columns}")
    return found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    (df.write.mode("errorifexists").partitionBy(*partition_by)
     .options(header=True, quote='"', escape='"').csv(path))


def json_record(*columns: str) -> Column:
    """One result row as a JSON object."""
    return F.to_json(F.struct(*columns))


def write_results(df: DataFrame, path: str, fmt: str = "json",
                  partition_by: Sequence[str] = ()) -> None:
    """Write results as ``json`` lines, ``csv`` or ``parquet``."""
    if fmt == "csv":
        write_csv(df, path, partition_by)
    elif fmt in ("json", "parquet"):
        df.write.mode("errorifexists").partitionBy(*partition_by).format(fmt).save(path)
    else:
        raise ValueError(f"unknown result format {fmt!r}")
