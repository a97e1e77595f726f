"""Block keys and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import similarity as S
from loomline.functions import tokens as T
from loomline.operators import blocks as B
from loomline.operators import matching as M
from loomline.operators.merging import merge_group
from loomline.options import MinerOptions
from loomline.queries import inputs as I
from loomline.queries.registry import query
from loomline.session import stage

TWO_TOKENS = MinerOptions(depth=5)
FEW_CHILDREN = MinerOptions(depth=5, max_children=8)
HALF = MinerOptions(depth=6)


@query("block_by_length", f"""
WITH {I.SQL_DOCUMENT_SHAPES}
SELECT n, count(*) AS shapes, CAST(sum(cnt) AS BIGINT) AS lines FROM shapes GROUP BY n""")
def block_by_length(spark, sf_dir):
    return (B.block_by_length(I.document_shapes(spark, sf_dir))
            .withColumn("n", F.col("n").cast("long")))


@query("block_by_prefix", f"""
WITH {I.SQL_DOCUMENT_SHAPES}
SELECT shape_id, n, {I.sql_key('tokens', I.sql_prefix_length(5))} AS key FROM shapes""")
def block_by_prefix(spark, sf_dir):
    keyed = B.with_prefix_key(I.document_shapes(spark, sf_dir), TWO_TOKENS)
    return keyed.select("shape_id", F.col("n").cast("long").alias("n"),
                        B.key_text(F.col("prefix_key")).alias("key"))


@query("block_by_suffix", f"""
WITH {I.SQL_DOCUMENT_SHAPES}
SELECT shape_id, n, {I.sql_key('list_reverse(tokens)', I.sql_suffix_length(6))} AS key
FROM shapes""")
def block_by_suffix(spark, sf_dir):
    keyed = B.with_suffix_key(I.document_shapes(spark, sf_dir), HALF)
    return keyed.select("shape_id", F.col("n").cast("long").alias("n"),
                        B.key_text(F.col("suffix_key")).alias("key"))


@query("cap_children", f"""
WITH {I.SQL_DOCUMENT_SHAPES},
keyed AS (SELECT shape_id, n, cnt, string_split({I.sql_key('tokens', I.sql_prefix_length(5))}, chr(1))
            AS k, {I.sql_prefix_length(5)} AS len FROM shapes),
two AS (SELECT shape_id, n, cnt, len, CASE WHEN len >= 1 THEN k[1] END AS a,
               CASE WHEN len >= 2 THEN k[2] END AS b FROM keyed),
rank1 AS (SELECT n, a, row_number() OVER (PARTITION BY n ORDER BY sum(cnt) DESC, a) AS rn
          FROM two WHERE a IS NOT NULL AND a <> '<*>' GROUP BY n, a),
cap1 AS (SELECT two.*, CASE WHEN two.a IS NULL THEN NULL WHEN rn <= 7 THEN two.a ELSE '<*>' END AS a2
         FROM two LEFT JOIN rank1 ON two.n = rank1.n AND two.a = rank1.a),
rank2 AS (SELECT n, a2, b, row_number() OVER (PARTITION BY n, a2 ORDER BY sum(cnt) DESC, b) AS rn
          FROM cap1 WHERE b IS NOT NULL AND b <> '<*>' GROUP BY n, a2, b)
SELECT shape_id, c.n, concat_ws(chr(1), c.a2, CASE WHEN c.b IS NULL THEN NULL
         WHEN rn <= 7 THEN c.b ELSE '<*>' END) AS key
FROM cap1 c LEFT JOIN rank2 r ON c.n = r.n AND c.a2 = r.a2 AND c.b = r.b""")
def cap_children(spark, sf_dir):
    keyed = B.with_prefix_key(I.document_shapes(spark, sf_dir), FEW_CHILDREN, "key").drop("tokens")
    capped = B.cap_children(stage(keyed, "keyed"), "key", 2, FEW_CHILDREN)
    return capped.select("shape_id", F.col("n").cast("long").alias("n"),
                         B.key_text(F.col("key")).alias("key"))


SIX_LEVELS = FEW_CHILDREN.with_(depth=9, max_children=3)


def sql_capped(depth: int, kept: int) -> str:
    """Keys of ``shapes`` with rare children replaced, one pair of steps per level."""
    parts = [f"""c0 AS (SELECT shape_id, n, cnt, {I.sql_prefix_length(depth)} AS len, '' AS path,
  string_split({I.sql_key('tokens', I.sql_prefix_length(depth))}, chr(1)) AS k FROM shapes)"""]
    for i in range(1, depth - 2):
        parts.append(f"""r{i} AS (
  SELECT n, path, k[{i}] AS t, row_number() OVER (PARTITION BY n, path ORDER BY sum(cnt) DESC, k[{i}]) AS rn
  FROM c{i - 1} WHERE len >= {i} AND k[{i}] <> '<*>' GROUP BY n, path, k[{i}]),
c{i} AS (
  SELECT c.shape_id, c.n, c.cnt, c.len, c.k, CASE WHEN c.len < {i} THEN c.path ELSE c.path
         || CASE WHEN {i} > 1 THEN chr(1) ELSE '' END
         || CASE WHEN r.rn <= {kept} THEN c.k[{i}] ELSE '<*>' END END AS path
  FROM c{i - 1} c LEFT JOIN r{i} r ON c.n = r.n AND c.path = r.path AND c.len >= {i} AND c.k[{i}] = r.t)""")
    return ", ".join(parts)


@query("cap_children_deep", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {sql_capped(9, 2)}
SELECT shape_id, n, path AS key FROM c6""")
def cap_children_deep(spark, sf_dir):
    """Six levels, two children and the wildcard at each."""
    keyed = B.with_prefix_key(I.document_shapes(spark, sf_dir), SIX_LEVELS, "key").drop("tokens")
    capped = B.cap_children(stage(keyed, "keyed"), "key", 6, SIX_LEVELS)
    return capped.select("shape_id", F.col("n").cast("long").alias("n"),
                         B.key_text(F.col("key")).alias("key"))


def block_leaders(keyed, key_col: str, values=()):
    """The top ranked shape of each ``(n, key)`` block, as its template, with its ``leader``
    tokens and other arrays as ``leader_<value>``."""
    order = F.struct((-F.col("cnt")).alias("c"), "first_id", "shape_id")
    first = keyed.groupBy("n", key_col).agg(F.min(order).alias("l")).select(
        "n", key_col, F.col("l.shape_id").alias("template_id"))
    texts = keyed.select(F.col("shape_id").alias("template_id"), F.col("tokens").alias("leader"),
                         *[F.col(v).alias(f"leader_{v}") for v in values])
    return first.join(texts, "template_id")


def with_leaders(keyed, key_col: str, values=()):
    """Every shape next to the top ranked shape of its block. Sequences of tokens or tags
    are shuffled as one text."""
    texts = ["tokens", *[v for v in values if dict(keyed.dtypes)[v] == "array<string>"]]
    slim = keyed.select("shape_id", "n", "cnt", "first_id", key_col, *[
        T.pack_tokens(F.col(c)).alias(c) if c in texts else F.col(c) for c in ("tokens", *values)])
    leaders = block_leaders(slim, key_col, values)
    return slim.drop("cnt", "first_id").join(leaders, ["n", key_col]).withColumns({
        c: T.unpack_tokens(F.col(c)) for t in texts for c in (t, "leader" if t == "tokens" else f"leader_{t}")})


def sql_leaders(key: str, name: str) -> str:
    return f"""{name} AS (
  SELECT n, {key} AS key, arg_min({{'id': shape_id, 'tokens': tokens}},
         {{'a': -cnt, 'b': first_id, 'c': shape_id}}) AS leader FROM shapes GROUP BY n, {key})"""


SQL_SAME = """len(list_filter(range(1, n + 1), lambda i: tokens[i] = leader.tokens[i] AND
              leader.tokens[i] <> '<*>'))"""


@query("two_way_candidates", f"""
WITH {I.SQL_DOCUMENT_SHAPES},
keyed AS (SELECT *, {I.sql_key('tokens', I.sql_prefix_length(5))} AS pk,
                 {I.sql_key('list_reverse(tokens)', I.sql_suffix_length(6))} AS sk FROM shapes),
{sql_leaders(I.sql_key('tokens', I.sql_prefix_length(5)), 'heads')},
{sql_leaders(I.sql_key('list_reverse(tokens)', I.sql_suffix_length(6)), 'tails')},
cand AS (
  SELECT k.*, leader, 0 AS side FROM keyed k JOIN heads h ON k.n = h.n AND k.pk = h.key
  UNION ALL
  SELECT k.*, leader, 1 AS side FROM keyed k JOIN tails t ON k.n = t.n AND k.sk = t.key),
scored AS (SELECT shape_id, leader.id AS template_id, {SQL_SAME} / CAST(n AS DOUBLE) AS sim, side
           FROM cand)
SELECT shape_id, template_id, sim, CASE side WHEN 0 THEN 'prefix' ELSE 'suffix' END AS side
FROM scored QUALIFY row_number() OVER (PARTITION BY shape_id ORDER BY sim DESC, side) = 1""")
def two_way_candidates(spark, sf_dir):
    shapes = stage(I.document_shapes(spark, sf_dir), "shapes")
    sides = []
    for kind, add in (("prefix_key", B.with_prefix_key), ("suffix_key", B.with_suffix_key)):
        options = TWO_TOKENS if kind == "prefix_key" else HALF
        keyed = add(shapes, options).withColumn(kind, B.key_text(F.col(kind)))
        pairs = with_leaders(keyed, kind)
        sides.append(pairs.select("shape_id", "template_id", S.positional_similarity(
            F.col("leader"), F.col("tokens")).alias("m")).select("shape_id", "template_id", "m.*"))
    return M.two_way_candidates(sides[0], sides[1], ["shape_id"]).select(
        "shape_id", "template_id", "sim", "side")


def block_templates(shapes, options: MinerOptions):
    """One folded template per prefix block; its id is the key's hash."""
    keyed = B.with_prefix_key(shapes, options).withColumn(
        "key", B.key_text(F.col("prefix_key")))
    ids = F.md5(F.concat_ws("|", F.col("n").cast("string"), "key"))
    keyed = keyed.withColumn("template_id", ids)
    folded = merge_group(keyed, ["template_id"], options.wildcard).withColumn("tokens", T.pack_tokens(F.col("tokens")))
    sizes = keyed.groupBy("template_id", "n").agg(
        F.sum("cnt").alias("size"), F.count("*").alias("shapes"),
        F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    return sizes.join(folded, "template_id").withColumn("tokens", T.unpack_tokens(F.col("tokens")))


def sql_block_templates(depth: int) -> str:
    return f"""keyed AS (
  SELECT *, md5(n || '|' || {I.sql_key('tokens', I.sql_prefix_length(depth))}) AS template_id
  FROM shapes),
{I.sql_fold('keyed', 'template_id')},
templates AS (
  SELECT k.template_id, k.n, CAST(sum(cnt) AS BIGINT) AS size, count(*) AS shapes,
         min(first_id) AS first_id, max(last_id) AS last_id, any_value(f.tokens) AS tokens
  FROM keyed k JOIN folded f USING (template_id) GROUP BY k.template_id, k.n)"""


@query("wildcard_edges", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {sql_block_templates(5)},
keys AS (
  SELECT template_id, n, {I.sql_key('tokens', I.sql_prefix_length(5), False)} AS key,
         'literal' AS kind FROM templates
  UNION
  SELECT template_id, n, {I.sql_key('tokens', I.sql_prefix_length(5))}, 'wildcard' FROM templates),
tried AS (
  SELECT shape_id, n, {I.sql_key('tokens', I.sql_prefix_length(5), False)} AS key,
         'literal' AS kind FROM shapes
  UNION ALL
  SELECT shape_id, n, {I.sql_key('tokens', I.sql_prefix_length(5))}, 'wildcard' FROM shapes),
found AS (SELECT shape_id, template_id, kind FROM tried JOIN keys USING (n, key, kind))
SELECT * FROM found f WHERE kind = 'literal' OR NOT EXISTS (
  SELECT 1 FROM found g WHERE g.shape_id = f.shape_id AND g.kind = 'literal')""")
def wildcard_edges(spark, sf_dir):
    shapes = stage(I.document_shapes(spark, sf_dir), "shapes")
    templates = stage(block_templates(shapes, TWO_TOKENS), "templates")
    return B.wildcard_edges(shapes, B.template_keys(templates, TWO_TOKENS), TWO_TOKENS)


@query("block_report", f"""
WITH {I.SQL_DOCUMENT_SHAPES},
t AS (SELECT n, cnt, coalesce(tokens[1], '') AS tok1, coalesce(tokens[2], '') AS tok2 FROM shapes)
SELECT CAST(CASE WHEN grouping(n) = 1 THEN 0 WHEN grouping(tok1) = 1 THEN 1
       WHEN grouping(tok2) = 1 THEN 2 ELSE 3 END AS BIGINT) AS level, coalesce(n, -1) AS n,
       coalesce(tok1, '*') AS tok1, coalesce(tok2, '*') AS tok2, count(*) AS shapes,
       CAST(sum(cnt) AS BIGINT) AS lines, max(cnt) AS largest
FROM t GROUP BY ROLLUP (n, tok1, tok2)""")
def block_report(spark, sf_dir):
    return B.block_report(I.document_shapes(spark, sf_dir))
