"""Similarity, vetoes and best match (M1-M7, G1)."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from loomline.functions import similarity as S
from loomline.functions import tokens as T
from loomline.operators import blocks as B
from loomline.operators.lines import annotate_tokens, token_dictionary
from loomline.operators.matching import best_match, near_pairs
from loomline.operators.merging import merge_group
from loomline.operators.seen import seen_similarity, seen_tokens
from loomline.options import MinerOptions
from loomline.queries import inputs as I
from loomline.queries.blocking import (
    block_templates, sql_block_templates, sql_leaders, with_leaders)
from loomline.queries.registry import query
from loomline.session import drop_shuffles, release, stage

ONE_TOKEN = MinerOptions(depth=4)
SQL_BLOCK = I.sql_key("tokens", I.sql_prefix_length(4))


def _shapes(spark, sf_dir):
    return stage(I.document_shapes(spark, sf_dir), "shapes")


def _keyed(shapes):
    return B.with_prefix_key(shapes, ONE_TOKEN, "key").withColumn("key", B.key_text(F.col("key")))


def _leader_pairs(shapes, values=()):
    """Every shape next to the top ranked shape of its block."""
    return with_leaders(_keyed(shapes), "key", values)


SQL_LEADER_PAIRS = f"""{sql_leaders(SQL_BLOCK, 'leaders')},
pairs AS (SELECT s.shape_id, s.n, s.tokens AS x, l.leader.id AS template_id, l.leader.tokens AS t
          FROM (SELECT *, {SQL_BLOCK} AS key FROM shapes) s JOIN leaders l
          ON s.n = l.n AND s.key = l.key)"""


@query("positional_similarity", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {sql_block_templates(4)},
pairs AS (SELECT k.shape_id, k.template_id, k.n, k.tokens AS x, t.tokens AS t
          FROM keyed k JOIN templates t USING (template_id)),
marks AS (SELECT *, len(list_filter(t, lambda v: v = '<*>')) AS params,
          len(list_filter(range(1, n + 1), lambda i: x[i] = t[i] AND t[i] <> '<*>')) AS same
          FROM pairs)
SELECT shape_id, template_id, params, same / CAST(n AS DOUBLE) AS sim,
       (same + params) / CAST(n AS DOUBLE) AS sim_with_params FROM marks""")
def positional_similarity(spark, sf_dir):
    shapes = _shapes(spark, sf_dir)
    ids = F.md5(F.concat_ws("|", F.col("n").cast("string"), "key"))
    pairs = _keyed(shapes).withColumn("template_id", ids).join(
        block_templates(shapes, ONE_TOKEN).select("template_id", F.col("tokens").alias("t")),
        "template_id")
    plain = S.positional_similarity(F.col("t"), F.col("tokens"))
    full = S.positional_similarity(F.col("t"), F.col("tokens"), include_params=True)
    return pairs.select("shape_id", "template_id", plain["params"].cast("long").alias("params"),
                        plain["sim"].alias("sim"), full["sim"].alias("sim_with_params"))


@query("seen_token_similarity", f"""
WITH spoken AS (WITH {I.SQL_CONVERSATIONS}, {I.sql_shapes(I.sql_tokens('text'))} SELECT * FROM shapes),
said AS (SELECT n, {SQL_BLOCK} AS key, cnt, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM spoken),
places AS (SELECT n, key, pos, list(DISTINCT tok) AS seen,
           CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '<*>' END AS t FROM said GROUP BY n, key, pos),
{I.SQL_DOCUMENT_SHAPES},
words AS (SELECT shape_id, n, {SQL_BLOCK} AS key, unnest(tokens) AS x, generate_subscripts(tokens, 1) AS pos FROM shapes),
hits AS (SELECT shape_id, n, x = t AS same,
         x <> t AND (regexp_matches(t, '^<[^:]+>') OR regexp_matches(x, '^<[^:]+>')) AND list_contains(seen, x) AS param
         FROM words JOIN places USING (n, key, pos))
SELECT shape_id, CAST(sum(CASE WHEN param THEN 1 ELSE 0 END) AS BIGINT) AS params,
       CAST(sum(CASE WHEN same OR param THEN 1 ELSE 0 END) AS BIGINT) / CAST(n AS DOUBLE) AS sim
FROM hits GROUP BY shape_id, n""")
def seen_token_similarity(spark, sf_dir):
    """Lines of documents next to the block templates of all lines of conversations, with
    the tokens that the lines of conversations had at each place."""
    spoken = _keyed(stage(I.conversation_shapes(spark, sf_dir), "shapes")).withColumn(
        "template_id", F.md5(F.concat_ws("|", F.col("n").cast("string"), "key")))
    templates = stage(spoken.select("template_id", "n", "key").distinct().join(
        merge_group(spoken, ["template_id"]).withColumnRenamed("tokens", "t"), "template_id"), "templates")
    drop_shuffles(spark)
    state = stage(seen_tokens(spoken), "seen")
    shapes = _shapes(spark, sf_dir)
    drop_shuffles(spark)
    pairs = _keyed(shapes).filter("n > 0").join(templates, ["n", "key"]).select(
        "template_id", "shape_id", "t", "tokens")
    return seen_similarity(pairs, state).select("shape_id", "params", "sim")


CAPS = r"'[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]'"


def _sql_caps(token: str) -> str:
    return f"NOT regexp_matches({token}, {CAPS})"


def _sql_snake(token: str) -> str:
    return (f"(regexp_matches({token}, '^[a-z]+(_[a-z]+)+$') OR "
            f"regexp_matches({token}, '^[a-zA-Z]+([A-Z][a-z0-9]+)+$'))")


# One row per position where two different literals meet, with the neighbours.
SQL_PLACES = f"""
spots AS (SELECT shape_id, template_id, n, t, x, unnest(range(1, n + 1)) AS i FROM pairs),
views AS (SELECT shape_id, template_id, n, i, t[i] AS a, x[i] AS b, coalesce(t[i - 1], '') AS pa,
          coalesce(x[i - 1], '') AS pb, coalesce(t[i + 1], '') AS na, coalesce(x[i + 1], '') AS nb
          FROM spots),
places AS (SELECT *, {_sql_caps('a')} AS ca, {_sql_caps('b')} AS cb FROM views
  WHERE a <> b AND NOT regexp_matches(a, '<[^:]+>') AND NOT regexp_matches(b, '<[^:]+>')
  AND ((NOT regexp_matches(a, '{I.DG}') AND NOT regexp_matches(b, '{I.DG}'))
       OR ({_sql_caps('a')} AND {_sql_caps('b')})))"""


@query("static_position_veto", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {SQL_LEADER_PAIRS}, {SQL_PLACES},
hits AS (SELECT DISTINCT shape_id FROM places WHERE
  n = 1 OR ({_sql_snake('a')} AND {_sql_snake('b')})
  OR (i > 1 AND i < n AND nb IN ('=', ':'))
  OR (i = 1 AND (nb IN ('=', ':') OR regexp_matches(a, '^[^:]+::[^:]+$')
                 OR regexp_matches(b, '^[^:]+::[^:]+$')))
  OR (i > 1 AND i < n AND (pa = ':' OR pb = ':')
      AND NOT (na IN (',', '.', ':') OR nb IN (',', '.', ':')) AND ca AND cb)
  OR (i = n AND i > 1 AND (pa = ':' OR pb = ':') AND ca AND cb)
  OR ca OR cb)
SELECT p.shape_id, p.template_id, h.shape_id IS NOT NULL AS veto
FROM pairs p LEFT JOIN hits h USING (shape_id)""")
def static_position_veto(spark, sf_dir):
    pairs = _leader_pairs(_shapes(spark, sf_dir))
    return pairs.select("shape_id", "template_id", S.static_position_veto(
        F.col("leader"), F.col("tokens")).alias("veto"))


def _with_values(shapes, lexicon, values):
    """Leader pairs with lexicon arrays for both sides. What only the tagged shapes were made
    from leaves the disks."""
    drop_shuffles(shapes.sparkSession)
    tagged = stage(annotate_tokens(shapes, lexicon, values), "tagged")
    release(shapes, lexicon)
    drop_shuffles(shapes.sparkSession)
    return _leader_pairs(tagged, values)


SQL_VOCAB = """
tk AS (SELECT DISTINCT unnest(tokens) AS token, shape_id, cnt FROM shapes),
vocab AS (SELECT token FROM tk WHERE regexp_full_match(token, '\\p{L}+')
          GROUP BY token HAVING sum(cnt) >= 2)"""


@query("dictionary_veto", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {SQL_LEADER_PAIRS}, {SQL_PLACES}, {SQL_VOCAB},
hits AS (SELECT DISTINCT shape_id FROM places
  WHERE i > 1 AND i < n AND a IN (SELECT token FROM vocab) AND b IN (SELECT token FROM vocab)
  AND ((pa = pb AND na = nb)
       OR ((pa IN ('=', ':') OR pb IN ('=', ':'))
           AND (na IN (',', '.', ':') OR nb IN (',', '.', ':')))))
SELECT p.shape_id, p.template_id, h.shape_id IS NOT NULL AS veto
FROM pairs p LEFT JOIN hits h USING (shape_id)""")
def dictionary_veto(spark, sf_dir):
    shapes = _shapes(spark, sf_dir)
    words = token_dictionary(shapes).filter("in_vocab").select("token", "in_vocab")
    pairs = _with_values(shapes, stage(words, "vocabulary"), ["in_vocab"])
    return pairs.select("shape_id", "template_id", S.dictionary_veto(
        F.col("leader"), F.col("tokens"), F.col("leader_in_vocab"),
        F.col("in_vocab")).alias("veto"))


TAGS = ("NN", "VB", "JJ", "IN", "DT", "NNS", "CD", "RB")
SQL_LINK = "('IN', 'TO')"


@query("pos_veto", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {SQL_LEADER_PAIRS},
tag AS (SELECT DISTINCT tk AS token, {list(TAGS)}[length(tk) % 8 + 1] AS tag
        FROM (SELECT unnest(tokens) AS tk FROM shapes)),
{SQL_PLACES},
tagged AS (SELECT p.*, ta.tag AS ga, tb.tag AS gb, coalesce(tpa.tag, '') AS gpa,
           coalesce(tpb.tag, '') AS gpb, coalesce(tna.tag, '') AS gna, coalesce(tnb.tag, '') AS gnb
  FROM places p JOIN tag ta ON ta.token = a JOIN tag tb ON tb.token = b
  LEFT JOIN tag tpa ON tpa.token = pa LEFT JOIN tag tpb ON tpb.token = pb
  LEFT JOIN tag tna ON tna.token = na LEFT JOIN tag tnb ON tnb.token = nb),
hits AS (SELECT DISTINCT shape_id FROM tagged WHERE
  ga IN ('IN', 'DT', 'RB') OR gb IN ('IN', 'DT', 'RB') OR left(ga, 1) <> left(gb, 1)
  OR ((ga IN ('NN', 'NNS', 'VB', 'JJ') OR gb IN ('NN', 'NNS', 'VB', 'JJ')) AND (
    (i = 1 AND gna <> 'VB' AND gnb <> 'VB' AND NOT regexp_matches(a || b, '[_/]'))
    OR (i > 1 AND pa NOT IN (':', '=') AND gpa NOT IN {SQL_LINK} AND pb NOT IN (':', '=')
        AND gpb NOT IN {SQL_LINK} AND NOT regexp_matches(a || b, '[_/]')
        AND NOT (regexp_matches(a, '{I.DG}') AND regexp_matches(b, '{I.DG}'))
        AND NOT (pa = pb AND (gpa IN ('JJ', 'VB') OR gpb IN ('JJ', 'VB'))))
    OR (i > 1 AND ga = 'VB' AND gpa IN {SQL_LINK}))))
SELECT p.shape_id, p.template_id, h.shape_id IS NOT NULL AS veto
FROM pairs p LEFT JOIN hits h USING (shape_id)""")
def pos_veto(spark, sf_dir):
    """The lexicon of the check gives a tag by word length."""
    shapes = _shapes(spark, sf_dir)
    lexicon = shapes.select(F.explode("tokens").alias("token")).distinct().withColumn(
        "tag", F.element_at(F.array(*[F.lit(t) for t in TAGS]), F.length("token") % 8 + 1))
    pairs = _with_values(shapes, stage(lexicon, "lexicon"), ["tag"])
    return pairs.select("shape_id", "template_id", S.pos_veto(
        F.col("leader"), F.col("tokens"), F.col("leader_tag"), F.col("tag")).alias("veto"))


@query("dynamic_threshold", f"""
WITH {I.SQL_DOCUMENT_SHAPES}
SELECT shape_id, n, CASE WHEN n = 0 THEN 1.0 ELSE round(CAST(1 AS DOUBLE) - log2(n) / n, 1) END
       AS sim_th FROM shapes""")
def dynamic_threshold(spark, sf_dir):
    return I.document_shapes(spark, sf_dir).select(
        "shape_id", F.col("n").cast("long").alias("n"),
        S.dynamic_threshold(F.col("n")).alias("sim_th"))


@query("best_match", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {sql_block_templates(6)},
blocked AS (SELECT template_id, n, tokens AS t, {SQL_BLOCK} AS key FROM templates),
pairs AS (SELECT k.shape_id, k.n, b.template_id, len(list_filter(b.t, lambda v: v = '<*>')) AS params,
          CASE WHEN k.n = 0 THEN 1.0 ELSE len(list_filter(range(1, k.n + 1), lambda i: k.tokens[i] = b.t[i]
            AND b.t[i] <> '<*>')) / CAST(k.n AS DOUBLE) END AS sim
          FROM (SELECT *, {SQL_BLOCK} AS key FROM shapes) k JOIN blocked b ON k.n = b.n AND k.key = b.key)
SELECT shape_id, template_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY sim DESC, params DESC, template_id) AS best
  FROM pairs) WHERE best = 1 AND sim >= CASE WHEN n = 0 THEN 1.0 ELSE round(CAST(1 AS DOUBLE) - log2(n) / n, 1) END""")
def best_match_query(spark, sf_dir):
    """Each shape against all templates of three leading tokens that share its first one; in a
    crowded block against those that may reach the threshold."""
    shapes = _shapes(spark, sf_dir)
    templates = _keyed(stage(block_templates(shapes, MinerOptions(depth=6)), "templates"))
    drop_shuffles(spark)
    pairs = near_pairs(_keyed(shapes), templates, ["n", "key"], 0.0).select("shape_id", "n", "template_id", (
        S.positional_similarity(F.col("_t"), F.col("tokens"))).alias("m"))
    return best_match(pairs.select("shape_id", "n", "template_id", "m.*"), ["shape_id"], 0.0
                      ).select("shape_id", "template_id", "sim")


@query("merge_pair", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {SQL_LEADER_PAIRS}
SELECT shape_id, template_id, array_to_string(list_transform(range(1, n + 1), lambda i:
         CASE WHEN x[i] = t[i] THEN x[i] ELSE '<*>' END), ' ') AS template FROM pairs""")
def merge_pair(spark, sf_dir):
    pairs = _leader_pairs(_shapes(spark, sf_dir))
    return pairs.select("shape_id", "template_id", T.token_text(
        S.merge_pair(F.col("leader"), F.col("tokens"))).alias("template"))
