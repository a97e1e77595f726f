"""Line tables derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomline.functions import tokens as T
from loomline.operators.lines import distinct_shapes, with_tokens
from loomline.options import DEFAULT_MASKS, MinerOptions
from loomline.sources.lines import split_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)").cast("string")


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd")


def event_text() -> Column:
    return F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" "), "event_type",
                    F.lit(" value "), money("value"), F.lit(" props "), "props")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_id"), "event_type", event_text().alias("text"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" customer="),
        F.col("o_custkey").cast("string"), F.lit(" status:"), "o_orderstatus", F.lit(" total="),
        money("o_totalprice"), F.lit(", priority: "), "o_orderpriority", F.lit(" on "),
        day("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_id"), "o_orderstatus", "o_orderpriority", "o_orderdate",
        text.alias("text"))


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines behind a header with an optional process id; orders of low
    priority lack the colon and do not fit the format."""
    text = F.concat(
        day("o_orderdate"), F.lit("  12:00:00 "), "o_orderstatus", F.lit(" store"),
        F.when(F.col("o_orderstatus") == "O", F.concat(
            F.lit("["), F.col("o_custkey").cast("string"), F.lit("]"))).otherwise(F.lit("")),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" ")).otherwise(F.lit(": ")),
        F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" for "), money("o_totalprice"),
        F.lit(" has priority "), "o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_id"), "o_orderstatus", "o_orderpriority", "o_orderdate",
        text.alias("text"))


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" from supplier "),
        F.col("l_suppkey").cast("string"), F.lit(" quantity "), money("l_quantity"),
        F.lit(" price "), money("l_extendedprice"), F.lit(" flag "), "l_returnflag",
        F.lit(" status "), "l_linestatus", F.lit(" shipped "), day("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_returnflag",
        text.alias("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = split_text(table(spark, sf_dir, "documents"), "doc_id")
    return lines.select("doc_id", "line_no",
                        (F.col("doc_id") * (1 << 24) + F.col("line_no")).alias("line_id"), "text")


PLAIN = MinerOptions()
NUMBERED = MinerOptions(masks=DEFAULT_MASKS, sim_th=0.9)


def document_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_shapes(with_tokens(document_lines(spark, sf_dir), PLAIN))


def conversation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of all turns."""
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 4096 + F.col("turn")).alias("turn_id"), "text")
    lines = split_text(turns, "turn_id").withColumn("line_id", F.col("turn_id") * (1 << 20) + F.col("line_no"))
    return distinct_shapes(with_tokens(lines, PLAIN))


def event_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_shapes(with_tokens(event_lines(spark, sf_dir), NUMBERED))


def text_of(name: str = "tokens") -> Column:
    return T.token_text(F.col(name))


# --- the same tables for the checking SQL ---------------------------------

SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
DG = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]"


def sql_tokens(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace({text}, '^{SP}+|{SP}+$', '', 'g'), "
            f"'{SP}+'), lambda t: t <> '')")


def sql_money(name: str) -> str:
    return f"CAST(CAST({name} AS DECIMAL(18,2)) AS VARCHAR)"


def sql_day(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d')"


SQL_EVENTS = f"""lines AS (
  SELECT event_id AS line_id, event_type,
         'user ' || user_id || ' ' || event_type || ' value ' || {sql_money('value')}
         || ' props ' || props AS text
  FROM events)"""

SQL_ORDERS = f"""lines AS (
  SELECT o_orderkey AS line_id, o_orderstatus, o_orderpriority, o_orderdate,
         'order ' || o_orderkey || ' customer=' || o_custkey || ' status:' || o_orderstatus
         || ' total=' || {sql_money('o_totalprice')} || ', priority: ' || o_orderpriority
         || ' on ' || {sql_day('o_orderdate')} AS text
  FROM orders)"""

SQL_HEADERS = f"""lines AS (
  SELECT o_orderkey AS line_id, o_orderstatus, o_orderpriority, o_orderdate,
         {sql_day('o_orderdate')} || '  12:00:00 ' || o_orderstatus || ' store'
         || CASE WHEN o_orderstatus = 'O' THEN '[' || o_custkey || ']' ELSE '' END
         || CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE ': ' END
         || 'order ' || o_orderkey || ' for ' || {sql_money('o_totalprice')}
         || ' has priority ' || o_orderpriority AS text
  FROM orders)"""

SQL_ITEMS = f"""lines AS (
  SELECT l_orderkey * 10 + l_linenumber AS line_id, l_returnflag,
         'part ' || l_partkey || ' from supplier ' || l_suppkey || ' quantity '
         || {sql_money('l_quantity')} || ' price ' || {sql_money('l_extendedprice')} || ' flag '
         || l_returnflag || ' status ' || l_linestatus || ' shipped ' || {sql_day('l_shipdate')}
         AS text
  FROM lineitem)"""

SQL_DOCUMENTS = f"""lines AS (
  SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, doc_id * 16777216 + line_no AS line_id,
         regexp_replace(line, '{SP}+$', '') AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM documents))"""


SQL_CONVERSATIONS = f"""lines AS (
  SELECT (conv_id * 4096 + turn) * 1048576 + line_no AS line_id, regexp_replace(line, '{SP}+$', '') AS text
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM conversations))"""


def sql_id(tokens: str) -> str:
    """The content id of a list of tokens."""
    return f"md5(array_to_string(list_transform({tokens}, lambda t: length(t) || ':' || t), ''))"


def sql_shapes(tokens: str) -> str:
    """Distinct shapes of the CTE ``lines``."""
    return f"""shapes AS (
  SELECT {sql_id("tokens")} AS shape_id, len(tokens) AS n, tokens,
         count(*) AS cnt, min(line_id) AS first_id, max(line_id) AS last_id
  FROM (SELECT line_id, {tokens} AS tokens FROM lines) GROUP BY tokens)"""


SQL_NUM = r"regexp_replace(text, '\d+(\.\d+)?', '<NUM>', 'g')"
SQL_DOCUMENT_SHAPES = SQL_DOCUMENTS + ", " + sql_shapes(sql_tokens("text"))
SQL_EVENT_SHAPES = SQL_EVENTS + ", " + sql_shapes(sql_tokens(SQL_NUM))


def sql_key(tokens: str, length: str, numeric: bool = True) -> str:
    """Leading tokens as one text, tokens with digits as the wildcard."""
    head = f"{tokens}[1:{length}]"
    if numeric:
        head = (f"list_transform({head}, lambda t: "
                f"CASE WHEN regexp_matches(t, '{DG}') THEN '<*>' ELSE t END)")
    return f"array_to_string({head}, chr(1))"


def sql_prefix_length(depth: int, n: str = "n") -> str:
    return f"greatest(least({depth - 2}, {n}) - 1, 0)"


def sql_suffix_length(depth: int, n: str = "n") -> str:
    half = f"CASE WHEN {n} % 2 = 0 THEN {n} // 2 + 1 ELSE ({n} + 1) // 2 END"
    return f"CASE WHEN {n} = 0 THEN 0 ELSE least({half}, {n}, {max(depth - 3, 1)}) END"


def sql_fold(source: str, groups: str, name: str = "folded") -> str:
    """Position-wise fold of ``tokens`` per group."""
    return f"""{name}_places AS (
  SELECT {groups}, unnest(CASE WHEN len(tokens) = 0 THEN [NULL] ELSE tokens END) AS tok,
         generate_subscripts(CASE WHEN len(tokens) = 0 THEN [NULL] ELSE tokens END, 1) AS pos FROM {source}),
{name}_marks AS (
  SELECT {groups}, pos, CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '<*>' END AS tok
  FROM {name}_places GROUP BY {groups}, pos),
{name} AS (
  SELECT {groups}, list_filter(list(tok ORDER BY pos), lambda t: t IS NOT NULL) AS tokens FROM {name}_marks GROUP BY {groups})"""
