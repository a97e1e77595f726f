"""Scores of a grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import evaluate as E
from loomline.plans.benchmark import Dataset, benchmark_run
from loomline.queries import inputs as I
from loomline.queries.lines import HEADER, SQL_HEADER
from loomline.queries.mining import SQL_MEMBERS, sql_mined
from loomline.queries.registry import query

# A grouping of events by type and weekday-like user class, with some merged
# and some split types, so that all kinds of errors occur.
SQL_GROUPED = """
grouped AS (SELECT event_id AS line_id, event_type AS event_id_label,
  CASE WHEN event_type IN ('click', 'view') THEN 'browse'
       WHEN event_type = 'error' AND value < 50 THEN 'error low' ELSE event_type END AS cluster_id
  FROM events),
joint AS (SELECT cluster_id, event_id_label AS event_id, count(*) AS common FROM grouped GROUP BY ALL),
counts AS (SELECT *, CAST(sum(common) OVER (PARTITION BY cluster_id) AS BIGINT) AS cluster_lines,
  count(*) OVER (PARTITION BY cluster_id) AS labels_inside,
  CAST(sum(common) OVER (PARTITION BY event_id) AS BIGINT) AS label_lines FROM joint)"""


def grouped_events(spark, sf_dir):
    events = I.table(spark, sf_dir, "events")
    cluster = (F.when(F.col("event_type").isin("click", "view"), "browse")
               .when((F.col("event_type") == "error") & (F.col("value") < 50), "error low")
               .otherwise(F.col("event_type")))
    grouped = events.select(F.col("event_id").alias("line_id"), cluster.alias("cluster_id"))
    labels = events.select(F.col("event_id").alias("line_id"), F.col("event_type").alias("event_id"))
    return grouped, labels


@query("grouping_accuracy", f"""
WITH {SQL_GROUPED}
SELECT CAST(sum(common) AS BIGINT) AS lines, CAST(sum(CASE WHEN common = cluster_lines
         AND common = label_lines THEN common ELSE 0 END) AS BIGINT) AS exact_lines,
       round(sum(CASE WHEN common = cluster_lines AND common = label_lines THEN common ELSE 0 END)
         / CAST(sum(common) AS DOUBLE), 4) AS accuracy
FROM counts""")
def grouping_accuracy(spark, sf_dir):
    return E.grouping_accuracy(*grouped_events(spark, sf_dir))


@query("grouping_errors", f"""
WITH {SQL_GROUPED}
SELECT cluster_id, event_id, CASE WHEN labels_inside > 1 THEN 'impure' ELSE 'incomplete' END
         AS error, common, cluster_lines, label_lines, label_lines - common AS missing
FROM counts WHERE labels_inside > 1 OR cluster_lines < label_lines""")
def grouping_errors(spark, sf_dir):
    return E.grouping_errors(*grouped_events(spark, sf_dir))


@query("missing_lines", """
SELECT event_id AS line_id FROM events WHERE event_type = 'error' AND value < 50""")
def missing_lines(spark, sf_dir):
    """Lines labelled ``error`` that the cluster ``error`` lacks."""
    return E.missing_lines(*grouped_events(spark, sf_dir), "error", "error").select("line_id")


def datasets(spark, sf_dir) -> list[Dataset]:
    events = I.event_lines(spark, sf_dir).select(
        "line_id", "text", F.col("event_type").alias("event_id"))
    headers = I.header_lines(spark, sf_dir).select(
        "line_id", "text", F.col("o_orderpriority").alias("event_id"))
    orders = I.order_lines(spark, sf_dir).select(
        "line_id", "text", F.col("o_orderstatus").alias("event_id"))
    return [Dataset("events", events, replace=[r"\d+(?:\.\d+)?"]),
            Dataset("headers", headers, HEADER, replace=[r"\d+(?:\.\d+)?"]),
            Dataset("orders", orders, "order <Id> <Content>", delete=[r"priority: .* on "],
                    replace=[r"\d+(?:\.\d+)?", r"-"])]


def sql_scored(dataset: str, lines: str, text: str, label: str, where: str = "", rejected: str = "0") -> str:
    """Score of one dataset: lines cleaned, mined at 0.4, compared with their labels."""
    tokens = I.sql_tokens(text)
    return f"""SELECT * FROM (WITH RECURSIVE {lines},
{I.sql_shapes(tokens).replace("FROM lines)", f"FROM lines {where})")}, {sql_mined()}, {SQL_MEMBERS},
tagged AS (SELECT {label} AS label, {I.sql_id(tokens)} AS shape_id FROM lines {where}),
joint AS (SELECT template_id, label, count(*) AS common FROM tagged JOIN members USING (shape_id) GROUP BY ALL),
counts AS (SELECT *, sum(common) OVER (PARTITION BY template_id) AS pc, sum(common) OVER (PARTITION BY label) AS gc FROM joint),
exact AS (SELECT *, CASE WHEN common = pc AND common = gc THEN common ELSE 0 END AS hit FROM counts)
SELECT '{dataset}' AS dataset, CAST(sum(common) AS BIGINT) AS lines, CAST(sum(hit) AS BIGINT) AS exact_lines,
       round(sum(hit) / CAST(sum(common) AS DOUBLE), 4) AS accuracy, count(DISTINCT template_id) AS clusters,
       CAST(({rejected}) AS BIGINT) AS rejected FROM exact)"""


NUMBERS = r"\d+(?:\.\d+)?"
SQL_SCORES = " UNION ALL ".join((
    sql_scored("events", I.SQL_EVENTS, f"regexp_replace(text, '{NUMBERS}', '<*>', 'g')", "event_type"),
    sql_scored("headers", I.SQL_HEADERS, f"regexp_replace(regexp_extract(text, '{SQL_HEADER}', 7), '{NUMBERS}', '<*>', 'g')",
               "o_orderpriority", f"WHERE regexp_matches(text, '{SQL_HEADER}')",
               f"SELECT count_if(NOT regexp_matches(text, '{SQL_HEADER}')) FROM lines"),
    sql_scored("orders", I.SQL_ORDERS, "regexp_replace(regexp_replace(regexp_replace(regexp_extract(text, "
               f"'^order (.*?) (.*)$', 2), 'priority: .* on ', '', 'g'), '{NUMBERS}', '<*>', 'g'), '-', '<*>', 'g')",
               "o_orderstatus")))


@query("benchmark_run", SQL_SCORES)
def benchmark(spark, sf_dir):
    """Three datasets in one job, mined at 0.4."""
    scores, _ = benchmark_run(datasets(spark, sf_dir), I.PLAIN)
    return scores


@query("result_table", """
WITH s AS (SELECT event_type || '-log.txt' AS dataset, CAST(sum(CAST(value AS DECIMAL(18,2))) / 100 AS DECIMAL(30,2))
             AS d, count(*) AS n, count(DISTINCT user_id) AS c,
             CAST(count_if(value < 50) / CAST(count(*) AS DOUBLE) AS DECIMAL(30,4)) AS a
           FROM events GROUP BY event_type)
SELECT dataset, CAST(a AS DOUBLE) AS group_accuracy, CAST(d AS DOUBLE) AS duration_sec,
       n AS line_number, CAST(CAST(n / CAST(d AS DOUBLE) AS DECIMAL(30,1)) AS DOUBLE)
         AS lines_per_sec, c AS clusters FROM s""")
def result_table(spark, sf_dir):
    """Summary lines per event type, written as text and parsed back."""
    value = F.col("value").cast("decimal(18,2)")
    stats = I.table(spark, sf_dir, "events").groupBy(
        F.concat("event_type", F.lit("-log.txt")).alias("dataset")).agg(
        (F.count_if(F.col("value") < 50) / F.count("*")).alias("accuracy"),
        (F.sum(value) / 100).cast("decimal(30,2)").cast("double").alias("duration"),
        F.count("*").alias("lines"), F.count_distinct("user_id").alias("clusters"))
    return E.result_table(stats.select(E.report_line().alias("text")))
