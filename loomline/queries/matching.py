"""Matching and parameter extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomline.operators import matching as M
from loomline.operators import params as P
from loomline.operators.lines import distinct_shapes, with_tokens
from loomline.options import MinerOptions
from loomline.plans.mining import assign_lines, mine_templates
from loomline.queries import inputs as I
from loomline.queries.blocking import block_templates, sql_block_templates
from loomline.queries.registry import query
from loomline.session import drop_shuffles, stage

PLAIN = MinerOptions()

SQL_LEAF = (f"CASE WHEN n < 2 THEN '' WHEN regexp_matches(tokens[1], '{I.DG}') THEN '<*>' "
            f"ELSE tokens[1] END")


@query("match_lines", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {sql_block_templates(5)},
cat AS (SELECT *, {SQL_LEAF} AS leaf FROM templates),
nodes AS (SELECT DISTINCT n, leaf FROM cat),
walk AS (SELECT s.*, CASE WHEN s.n < 2 THEN '' WHEN l.leaf IS NOT NULL THEN tokens[1]
           WHEN w.leaf IS NOT NULL THEN '<*>' END AS leaf
         FROM shapes s LEFT JOIN nodes l ON l.n = s.n AND l.leaf = tokens[1]
         LEFT JOIN nodes w ON w.n = s.n AND w.leaf = '<*>'),
pairs AS (SELECT s.shape_id, c.template_id, s.leaf = c.leaf AS near,
                 len(list_filter(c.tokens, lambda t: t = '<*>')) AS params
          FROM walk s JOIN cat c ON s.n = c.n
          WHERE len(list_filter(range(1, s.n + 1), lambda i:
                    NOT (c.tokens[i] = '<*>' OR c.tokens[i] = s.tokens[i]))) = 0),
always AS (SELECT shape_id, template_id FROM pairs QUALIFY row_number() OVER
           (PARTITION BY shape_id ORDER BY params DESC, template_id) = 1),
never AS (SELECT shape_id, template_id FROM pairs WHERE near QUALIFY row_number() OVER
          (PARTITION BY shape_id ORDER BY params DESC, template_id) = 1)
SELECT 'always' AS strategy, * FROM always
UNION ALL SELECT 'never', * FROM never
UNION ALL SELECT 'fallback', shape_id, coalesce(n.template_id, a.template_id)
FROM always a LEFT JOIN never n USING (shape_id)""")
def match_lines(spark, sf_dir):
    """Document shapes against templates folded from finer blocks. Each strategy is written
    before the next, so that the shuffle files of one lie on the disks at a time."""
    shapes = stage(I.document_shapes(spark, sf_dir), "shapes")
    catalog = stage(block_templates(shapes, MinerOptions(depth=5)), "catalog")
    parts = []
    for s in ("always", "never", "fallback"):
        drop_shuffles(spark)
        parts.append(stage(M.match_lines(shapes, catalog, PLAIN, s).select(
            F.lit(s).alias("strategy"), "shape_id", "template_id"), "matched"))
    return reduce(DataFrame.unionByName, parts)


def event_catalog(lines, options: MinerOptions):
    mined = mine_templates(lines, options)
    tagged = assign_lines(lines, mined, options)
    templates = mined.templates.select("template_id", I.text_of().alias("template"))
    return tagged, templates


@query("extract_parameters", f"""
WITH {I.SQL_EVENTS}
SELECT line_id, regexp_replace(text, '\\d+(\\.\\d+)?', '<NUM>', 'g') AS template,
       array_to_string(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), '|') AS param_values,
       'NUM|NUM|NUM' AS mask_names
FROM lines""")
def extract_parameters(spark, sf_dir):
    tagged, templates = event_catalog(I.event_lines(spark, sf_dir), I.NUMBERED)
    out = P.extract_parameters(tagged, templates, I.NUMBERED)
    return out.select(
        "line_id", "template",
        F.array_join(F.transform("parameters", lambda p: p["value"]), "|").alias("param_values"),
        F.array_join(F.transform("parameters", lambda p: p["mask_name"]), "|").alias("mask_names"))


@query("parameter_values", f"""
WITH {I.SQL_ORDERS}, t AS (SELECT line_id, string_split(text, ' ') AS w FROM lines)
SELECT line_id, array_to_string(list_filter(w, lambda x: NOT x IN
         ('order', 'priority:', 'on', '4-NOT', 'SPECIFIED')), '|') AS param_values
FROM t""")
def parameter_values(spark, sf_dir):
    """Order lines against their mined templates, matched loosely."""
    lines = stage(I.order_lines(spark, sf_dir).select("line_id", "text"), "lines")
    options = PLAIN.with_(sim_th=0.3)
    tagged, templates = event_catalog(lines, options)
    out = P.parameter_values(tagged, templates, options)
    return out.select("line_id", F.array_join("values", "|").alias("param_values"))


@query("parameter_table", f"""
WITH {I.SQL_EVENTS},
v AS (SELECT {I.sql_id(f"string_split({I.SQL_NUM}, ' ')")} AS template_id,
             unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS value,
             generate_subscripts(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), 1) AS pos
      FROM lines),
c AS (SELECT template_id, pos, value, count(*) AS value_lines FROM v GROUP BY ALL)
SELECT template_id, pos, 'NUM' AS mask_name, value, value_lines,
       row_number() OVER (PARTITION BY template_id, pos ORDER BY value_lines DESC, value) AS rank,
       CAST(sum(value_lines) OVER (PARTITION BY template_id, pos) AS BIGINT) AS lines,
       count(*) OVER (PARTITION BY template_id, pos) AS distinct_values
FROM c QUALIFY rank <= 3""")
def parameter_table(spark, sf_dir):
    tagged, templates = event_catalog(I.event_lines(spark, sf_dir), I.NUMBERED)
    table = P.parameter_table(P.extract_parameters(tagged, templates, I.NUMBERED), top=3)
    return table.select("template_id", F.col("pos").cast("long").alias("pos"), "mask_name",
                        "value", "value_lines", F.col("rank").cast("long").alias("rank"), "lines",
                        "distinct_values")
