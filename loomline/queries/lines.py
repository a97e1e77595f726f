"""Sources, sinks and line transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import masks as K
from loomline.functions import tokens as T
from loomline.operators import lines as L
from loomline.options import Mask, TUNED_MASKS
from loomline.queries import inputs as I
from loomline.queries.registry import query
from loomline.session import fresh_dir
from loomline.sources import lines as SL
from loomline.sources import tables as ST


@query("read_lines", f"WITH {I.SQL_ORDERS} SELECT text FROM lines")
def read_lines(spark, sf_dir):
    """Order lines written as text files and read back."""
    path = fresh_dir(spark, "text")
    I.order_lines(spark, sf_dir).select(F.concat("text", F.lit("  \t"))).write.text(path)
    return SL.read_lines(spark, path).select("text")


@query("number_file_lines", f"""
WITH {I.SQL_ORDERS}
SELECT row_number() OVER (ORDER BY o_orderdate, line_id) AS "LineId", text FROM lines""")
def number_file_lines(spark, sf_dir):
    """Text files written in order, numbered in file order."""
    path = fresh_dir(spark, "text")
    (I.order_lines(spark, sf_dir).repartitionByRange("o_orderdate", "line_id")
     .sortWithinPartitions("o_orderdate", "line_id").select("text").write.text(path))
    return SL.number_file_lines(SL.read_lines(spark, path)).select("LineId", "text")


@query("split_text", f"WITH {I.SQL_DOCUMENTS} SELECT doc_id, line_no, text FROM lines")
def split_text(spark, sf_dir):
    return I.document_lines(spark, sf_dir).select("doc_id", "line_no", "text")


@query("strip_header", f"""
WITH raw AS (
  SELECT o_orderkey AS line_id, {I.sql_day('o_orderdate')} || ' '
         || CASE o_orderstatus WHEN 'F' THEN 'PO-' WHEN 'O' THEN 'fsp-' ELSE 'nd-' END
         || o_custkey || ' a b c ' || o_orderpriority || ' ' || o_orderkey AS text
  FROM orders)
SELECT line_id, CASE WHEN regexp_matches(lower(string_split(text, ' ')[2]), '^(po-|fsp-)')
                THEN array_to_string(string_split(text, ' ')[6:], ' ') ELSE text END AS text
FROM raw""")
def strip_header(spark, sf_dir):
    kind = (F.when(F.col("o_orderstatus") == "F", "PO-").when(F.col("o_orderstatus") == "O", "fsp-")
            .otherwise("nd-"))
    text = F.concat(I.day("o_orderdate"), F.lit(" "), kind, F.col("o_custkey").cast("string"),
                    F.lit(" a b c "), "o_orderpriority", F.lit(" "),
                    F.col("o_orderkey").cast("string"))
    return I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_id"), SL.strip_header(text).alias("text"))


HEADER = r"<Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>"
SQL_HEADER = r"^(.*?)\s+(.*?)\s+(.*?)\s+(.*?)(\[(.*?)\])?:\s+(.*?)$"


@query("parse_format", f"""
WITH {I.SQL_HEADERS}
SELECT line_id, regexp_extract(text, '{SQL_HEADER}', 1) AS "Date",
       regexp_extract(text, '{SQL_HEADER}', 2) AS "Time",
       regexp_extract(text, '{SQL_HEADER}', 3) AS "Level",
       regexp_extract(text, '{SQL_HEADER}', 4) AS "Component",
       regexp_extract(text, '{SQL_HEADER}', 6) AS "PID",
       regexp_extract(text, '{SQL_HEADER}', 7) AS "Content"
FROM lines WHERE regexp_matches(text, '{SQL_HEADER}')""")
def parse_format(spark, sf_dir):
    parsed, _ = SL.parse_format(I.header_lines(spark, sf_dir), HEADER, keep=["line_id"])
    return parsed


@query("parse_rejects", f"""
WITH {I.SQL_HEADERS}
SELECT line_id, text FROM lines WHERE NOT regexp_matches(text, '{SQL_HEADER}')""")
def parse_rejects(spark, sf_dir):
    _, rejected = SL.parse_format(I.header_lines(spark, sf_dir), HEADER)
    return rejected.select("line_id", "text")


@query("number_lines", f"""
WITH {I.SQL_HEADERS}
SELECT row_number() OVER (ORDER BY o_orderdate, line_id) AS "LineId", line_id
FROM lines WHERE regexp_matches(text, '{SQL_HEADER}')""")
def number_lines(spark, sf_dir):
    parsed, _ = SL.parse_format(I.header_lines(spark, sf_dir), HEADER,
                                keep=["line_id", "o_orderdate"])
    return SL.number_lines(parsed, ["o_orderdate", "line_id"]).select("LineId", "line_id")


@query("read_labels", f"""
WITH {I.SQL_EVENTS}
SELECT line_id, event_type AS "EventId", {I.SQL_NUM} || ', "' || event_type || '"'
       AS "EventTemplate" FROM lines""")
def read_labels(spark, sf_dir):
    path = fresh_dir(spark, "labels")
    template = F.concat(K.mask_text(F.col("text"), I.NUMBERED.masks), F.lit(', "'),
                        "event_type", F.lit('"'))
    # Columns in another order and one that is not asked for: they are read by name.
    ST.write_csv(I.event_lines(spark, sf_dir).select(
        F.col("event_type").alias("EventId"), F.col("text").alias("Content"),
        template.alias("EventTemplate"), "line_id"), path)
    return ST.read_labels(spark, path)


@query("write_results", f"""
WITH {I.SQL_EVENTS}
SELECT to_json({{'line_id': line_id, 'event_type': event_type, 'text': text}})
       AS value FROM lines""")
def write_results(spark, sf_dir):
    path = fresh_dir(spark, "results")
    ST.write_results(I.event_lines(spark, sf_dir).select("line_id", "event_type", "text"), path)
    return spark.read.text(path)


DELETE = [r"\(\d+\)", r"[\"'][a-z]+[\"']:"]
REPLACE = [r"[a-z]+-\d+", r"\d+\.\d+", r"\b\d{2,}\b"]


def _sql_chain(text: str, patterns: list[str], to: str) -> str:
    for p in patterns:
        p = p.replace("'", "''")
        text = f"regexp_replace({text}, '{p}', '{to}', 'g')"
    return text


@query("delete_patterns", f"""
WITH {I.SQL_EVENTS} SELECT line_id, {_sql_chain('text', DELETE, '')} AS text FROM lines""")
def delete_patterns(spark, sf_dir):
    return I.event_lines(spark, sf_dir).select(
        "line_id", K.delete_patterns(F.col("text"), DELETE).alias("text"))


@query("replace_patterns", f"""
WITH {I.SQL_ORDERS} SELECT line_id, {_sql_chain('text', REPLACE, '<*>')} AS text FROM lines""")
def replace_patterns(spark, sf_dir):
    return I.order_lines(spark, sf_dir).select(
        "line_id", K.replace_patterns(F.col("text"), REPLACE).alias("text"))


BY_NAME = {m.name: m for m in TUNED_MASKS}
CHAIN = [BY_NAME["DATE"], BY_NAME["*"], BY_NAME["URL"], BY_NAME["NUM"], BY_NAME["UNIT"]]
W = r"[\p{L}\p{N}_-]"
SQL_DATE = (r"(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
            r"\s+(\d{1,2})\s+(\d{1,2}:\d{1,2}:\d{1,2})(?:\s+[A-Z]+)?\s+(\d{4})")
SQL_STARS = r"(<\*>)(?:\s+<\*>)+"
SQL_URL = rf"({W}+\.){{2,}}{W}+"
UNITS = "('B', 'KB', 'MB', 'GB', 'sec', 'secs', 'kbps')"
# A bounded match is a whole run of letters and digits; NUM also takes the sign
# before it unless that sign alone follows another run.
SQL_MASKED = f"""
m1 AS (SELECT *, regexp_replace(text, '{SQL_DATE}', '<DATE>', 'g') AS t1 FROM lines),
m2 AS (SELECT *, regexp_replace(t1, '{SQL_STARS}', '<*>', 'g') AS t2 FROM m1),
m3 AS (SELECT *, regexp_replace(t2, '{SQL_URL}', '<URL>', 'g') AS t3 FROM m2),
r3 AS (SELECT *, regexp_extract_all(t3, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS runs FROM m3),
m4 AS (SELECT *, array_to_string(list_transform(runs, lambda x, i: CASE
         WHEN regexp_full_match(x, '\\d+') THEN '<NUM>'
         WHEN regexp_full_match(coalesce(runs[i + 1], ''), '\\d+') AND right(x, 1) IN ('-', '+')
              AND (length(x) > 1 OR i = 1) THEN left(x, length(x) - 1)
         ELSE x END), '') AS t4 FROM r3),
r4 AS (SELECT *, regexp_extract_all(t4, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS runs4 FROM m4),
m5 AS (SELECT *, array_to_string(list_transform(runs4, lambda x:
         CASE WHEN x IN {UNITS} THEN '<UNIT>' ELSE x END), '') AS t5 FROM r4)"""


@query("mask_lines", f"""
WITH {I.SQL_DOCUMENTS}, {SQL_MASKED} SELECT line_id, t5 AS text FROM m5""")
def mask_lines(spark, sf_dir):
    return I.document_lines(spark, sf_dir).select(
        "line_id", K.mask_text(F.col("text"), CHAIN).alias("text"))


@query("mask_profile", f"""
WITH {I.SQL_DOCUMENTS}, {SQL_MASKED},
hits AS (
  SELECT 1 AS first_step, 'DATE' AS mask_name, len(regexp_extract_all(text, '{SQL_DATE}')) AS hits
  FROM m5
  UNION ALL SELECT 2, '*', len(regexp_extract_all(t1, '{SQL_STARS}')) FROM m5
  UNION ALL SELECT 3, 'URL', len(regexp_extract_all(t2, '{SQL_URL}')) FROM m5
  UNION ALL SELECT 4, 'NUM', len(list_filter(runs, lambda x: regexp_full_match(x, '\\d+'))) FROM m5
  UNION ALL SELECT 5, 'UNIT', len(list_filter(runs4, lambda x: x IN {UNITS})) FROM m5)
SELECT CAST(first_step AS INTEGER) AS first_step, mask_name, CAST(count_if(hits > 0) AS BIGINT) AS lines_hit,
       CAST(sum(hits) AS BIGINT) AS matches
FROM hits GROUP BY first_step, mask_name""")
def mask_profile(spark, sf_dir):
    return L.mask_profile(I.document_lines(spark, sf_dir), CHAIN)


@query("tokenize", f"""
WITH {I.SQL_DOCUMENTS}, t AS (
  SELECT line_id, {I.sql_tokens("replace(replace(text, '_', ' '), '.', ' ')")} AS tokens FROM lines)
SELECT line_id, len(tokens) AS n, array_to_string(tokens, '|') AS tokens FROM t""")
def tokenize(spark, sf_dir):
    lines = I.document_lines(spark, sf_dir).withColumn(
        "tokens", T.tokenize(F.col("text"), ["_", "."]))
    return lines.select("line_id", F.size("tokens").cast("long").alias("n"),
                        F.array_join("tokens", "|").alias("tokens"))


# Cut the core at the first separators found by position, not by pattern.
SQL_PUNCT = r"""
words AS (
  SELECT line_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS wi FROM
    (SELECT line_id, {tokens} AS toks FROM lines)),
cores AS (
  SELECT *, regexp_extract(w, '^[,.!?;:]+') AS front,
         regexp_replace(w, '^[,.!?;:]+', '') AS rest FROM words),
ends AS (
  SELECT *, regexp_extract(rest, '[,.!?;:]+$') AS back,
         regexp_replace(rest, '[,.!?;:]+$', '') AS core FROM cores),
spots AS (
  SELECT *, strpos(core, '=') AS e, strpos(core, ':') AS c,
         length(core) - length(replace(core, '=', '')) AS es,
         length(core) - length(replace(core, ':', '')) AS cs FROM ends),
parts AS (
  SELECT line_id, wi, CASE
    WHEN regexp_matches(w, '^\d{{1,3}}(\.\d{{1,3}}){{3}}(:\d{{1,5}})?$|^\d{{1,2}}:\d{{2}}(:\d{{2}})?$|^<[^:]+>$')
      THEN [w]
    WHEN e > 0 AND c > 0 THEN
      [front, left(core, least(e, c) - 1), CASE WHEN e < c THEN '=' ELSE ':' END,
       substr(core, least(e, c) + 1, greatest(
         strpos(substr(core, least(e, c) + 1), CASE WHEN e < c THEN ':' ELSE '=' END) - 1, 0)),
       CASE WHEN e < c THEN ':' ELSE '=' END,
       substr(core, least(e, c) + 1 + strpos(
         substr(core, least(e, c) + 1), CASE WHEN e < c THEN ':' ELSE '=' END)), back]
    WHEN es = 1 THEN [front, left(core, e - 1), '=', substr(core, e + 1), back]
    WHEN cs = 1 THEN [front, left(core, c - 1), ':', substr(core, c + 1), back]
    ELSE [front, core, back] END AS p FROM spots)
SELECT line_id, coalesce(CAST(sum(len(list_filter(p, lambda x: x <> ''))) AS BIGINT), 0) AS n,
       coalesce(string_agg(array_to_string(list_filter(p, lambda x: x <> ''), '|'), '|' ORDER BY wi), '')
         AS tokens
FROM lines LEFT JOIN parts USING (line_id) GROUP BY line_id"""


@query("tokenize_punct", f"""
WITH {I.SQL_ORDERS}, {SQL_PUNCT.format(tokens=I.sql_tokens('text'))}""")
def tokenize_punct(spark, sf_dir):
    lines = I.order_lines(spark, sf_dir).withColumn("tokens", T.tokenize_punct(F.col("text")))
    return lines.select("line_id", F.size("tokens").cast("long").alias("n"),
                        F.array_join("tokens", "|").alias("tokens"))


@query("tokenize_punct_documents", f"""
WITH {I.SQL_DOCUMENTS}, {SQL_PUNCT.format(tokens=I.sql_tokens('text'))}""")
def tokenize_punct_documents(spark, sf_dir):
    lines = I.document_lines(spark, sf_dir).withColumn("tokens", T.tokenize_punct(F.col("text")))
    return lines.select(
        "line_id", F.size("tokens").cast("long").alias("n"),
        F.array_join("tokens", "|").alias("tokens"))


@query("numeric_tokens", f"""
WITH {I.SQL_DOCUMENTS}, t AS (SELECT line_id, {I.sql_tokens('text')} AS tokens FROM lines)
SELECT line_id, array_to_string(list_transform(tokens, lambda t:
         CASE WHEN regexp_matches(t, '{I.DG}') THEN '<*>' ELSE t END), ' ') AS text FROM t""")
def numeric_tokens(spark, sf_dir):
    tokens = T.numeric_to_wildcard(T.tokenize(F.col("text")))
    return I.document_lines(spark, sf_dir).select("line_id", T.token_text(tokens).alias("text"))


@query("token_classes", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, t AS (SELECT unnest(tokens) AS token, cnt FROM shapes)
SELECT token, CAST(sum(cnt) AS BIGINT) AS occurrences,
       NOT regexp_matches(token, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AS all_caps,
       regexp_matches(token, '^[a-z]+(_[a-z]+)+$')
         OR regexp_matches(token, '^[a-zA-Z]+([A-Z][a-z0-9]+)+$') AS snake_or_camel,
       regexp_matches(token, '^<[^:]+>') AS mask,
       regexp_matches(token, '^[^:]+::[^:]+$') AS scoped_name,
       contains(token, '_') OR contains(token, '/') AS path_mark,
       regexp_matches(token, '{I.DG}') AS digit
FROM t GROUP BY token""")
def token_classes(spark, sf_dir):
    return L.token_classes(I.document_shapes(spark, sf_dir))


@query("token_dictionary", f"""
WITH {I.SQL_DOCUMENT_SHAPES},
t AS (SELECT unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos, shape_id, cnt
      FROM shapes),
per_line AS (SELECT DISTINCT token, shape_id, cnt FROM t),
l AS (SELECT token, CAST(sum(cnt) AS BIGINT) AS lines FROM per_line GROUP BY token),
p AS (SELECT token, CAST(sum(cnt) AS BIGINT) AS occurrences, count(DISTINCT pos) AS positions
      FROM t GROUP BY token)
SELECT token, occurrences, positions, lines,
       lines >= 2 AND regexp_full_match(token, '\\p{{L}}+') AS in_vocab
FROM p JOIN l USING (token)""")
def token_dictionary(spark, sf_dir):
    return L.token_dictionary(I.document_shapes(spark, sf_dir))


@query("distinct_shapes", f"""
WITH {I.SQL_EVENT_SHAPES}
SELECT shape_id, n, array_to_string(tokens, ' ') AS text, cnt, first_id, last_id FROM shapes""")
def distinct_shapes(spark, sf_dir):
    return I.event_shapes(spark, sf_dir).select(
        "shape_id", F.col("n").cast("long").alias("n"), I.text_of().alias("text"), "cnt",
        "first_id", "last_id")


@query("distinct_document_shapes", f"""
WITH {I.SQL_DOCUMENT_SHAPES}
SELECT shape_id, n, cnt, first_id, last_id FROM shapes""")
def distinct_document_shapes(spark, sf_dir):
    return I.document_shapes(spark, sf_dir).select(
        "shape_id", F.col("n").cast("long").alias("n"), "cnt", "first_id", "last_id")
