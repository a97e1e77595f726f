"""Template building."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import tokens as T
from loomline.functions.similarity import FUNCTION_TAGS
from loomline.operators import blocks as B
from loomline.operators import merging as G
from loomline.operators import paths as K
from loomline.operators.lines import distinct_shapes, with_tokens
from loomline.operators.seen import move_seen, seen_tokens
from loomline.options import MinerOptions
from loomline.plans.mining import assign_lines, mine_shapes, mine_templates
from loomline.queries import inputs as I
from loomline.queries.blocking import block_templates, sql_block_templates
from loomline.queries.comparing import CAPS, TAGS, _sql_snake
from loomline.queries.registry import query
from loomline.session import drop_shuffles, release, stage

PLAIN = MinerOptions()


@query("merge_group", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {sql_block_templates(4)}
SELECT template_id, n, array_to_string(tokens, ' ') AS template, size, shapes FROM templates""")
def merge_group(spark, sf_dir):
    templates = block_templates(stage(I.document_shapes(spark, sf_dir), "shapes"), PLAIN)
    return templates.select("template_id", F.col("n").cast("long").alias("n"),
                            I.text_of().alias("template"), "size", "shapes")


SQL_BITS = {
    1: f"regexp_matches(tok, '{I.DG}')", 2: f"NOT regexp_matches(tok, {CAPS})", 4: _sql_snake("tok"),
    8: "regexp_matches(tok, '^[^:]+::[^:]+$')", 16: "regexp_matches(tok, '<[^:]+>')",
    32: "contains(tok, '_') OR contains(tok, '/')", 64: "coalesce(known, false)",
    128: "regexp_matches(tag, '" + "|".join(t.replace("$", "\\$") for t in FUNCTION_TAGS) + "')",
    256: "regexp_matches(tag, 'VB|JJ|NN')", 512: "starts_with(tag, 'VB')", 1024: "contains(tag, 'VB')",
    2048: "tag IN ('IN', 'TO')", 4096: "regexp_matches(tag, '^(JJ|VB)')"}


def sql_facts(name: str, source: str) -> str:
    """Facts of the tokens of each node, from the CTE ``lexicon``."""
    bits = " + ".join(f"CASE WHEN coalesce({test}, false) THEN {bit} ELSE 0 END" for bit, test in SQL_BITS.items())
    return f"""
{name}t AS (SELECT id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM {source}),
{name} AS (SELECT id, list({{'b': {bits}, 'h': coalesce(tag[1], '')}} ORDER BY pos) AS facts
  FROM {name}t LEFT JOIN lexicon ON token = tok GROUP BY id),"""


def sql_veto(t: str, x: str, n: str) -> str:
    """The vetoes by dictionary and part of speech of a template ``t`` and a member ``x``."""
    def has(one: str, i: str, bit: int) -> str:
        return f"((coalesce({one}.facts[{i}].b, 0) & {bit}) <> 0)"

    def either(i: str, bit: int) -> str:
        return f"({has(t, i, bit)} OR {has(x, i, bit)})"

    def both(i: str, bit: int) -> str:
        return f"({has(t, i, bit)} AND {has(x, i, bit)})"

    def same(i: str) -> str:
        return f"(coalesce({t}.tokens[{i}], '') = coalesce({x}.tokens[{i}], ''))"

    def some(i: str, *tokens: str) -> str:
        listed = ", ".join(f"'{v}'" for v in tokens)
        return f"(coalesce({t}.tokens[{i}], '') IN ({listed}) OR coalesce({x}.tokens[{i}], '') IN ({listed}))"

    dictionary = (f"(i > 1 AND i < {n} AND {both('i', 64)} AND (({same('i - 1')} AND {same('i + 1')} AND NOT "
                  f"{has(t, 'i - 1', 2048)}) OR ({some('i - 1', '=', ':')} AND {some('i + 1', ',', '.', ':')})))")
    leads = f"(i = 1 AND NOT {either('i', 32)} AND NOT {either('i + 1', 512)})"
    unlinked = (f"(i > 1 AND NOT {either('i', 32)} AND NOT {some('i - 1', ':', '=')} AND NOT {either('i - 1', 2048)}"
                f" AND NOT {both('i', 1)} AND NOT ({same('i - 1')} AND {either('i - 1', 4096)}))")
    after_link = f"(i > 1 AND {has(t, 'i', 1024)} AND {has(t, 'i - 1', 2048)})"
    pos = (f"({either('i', 128)} OR coalesce({t}.facts[i].h, '') <> coalesce({x}.facts[i].h, '') OR "
           f"({either('i', 256)} AND ({leads} OR {unlinked} OR {after_link})))")
    comparable = f"({t}.tokens[i] <> {x}.tokens[i] AND (NOT {either('i', 1)} OR {both('i', 2)}) AND NOT {either('i', 16)})"
    return f"len(list_filter(range(1, {n} + 1), lambda i: {comparable} AND ({dictionary} OR {pos}))) > 0"


def sql_pass(i: int, source: str, key: str, sim_th: float, rules: bool = False) -> str:
    """One mining pass: leaders in rank order by recursion over the rank, best
    leader per member, fold. Nodes: (id, n, tokens, cnt, first_id, last_id)."""
    same = ("len(list_filter(range(1, {n} + 1), lambda i: {a}[i] = {b}[i] AND {a}[i] <> '<*>'))"
            " >= {th} * {n}")
    covered = same.format(n="r.n", a="l.tokens", b="r.tokens", th=sim_th)
    alike = "1.0"
    if rules:
        veto = sql_veto("l", "r", "r.n")
        alike = f"(CASE WHEN {covered} AND {veto} THEN 0.0 ELSE 1.0 END)"
        covered = f"{covered} AND NOT {veto}"
    facts = ", 'facts': {}.facts" if rules else ""
    return f"""{sql_facts(f'p{i}x', source) if rules else ''}
p{i}k AS (SELECT *, {key} AS key FROM {source} {f'LEFT JOIN p{i}x USING (id)' if rules else ''}),
p{i}r AS (SELECT *, row_number() OVER (PARTITION BY n, key ORDER BY cnt DESC, first_id, id) AS rn
          FROM p{i}k),
p{i}l(n, key, rn, leaders) AS (
  SELECT n, key, rn, [{{'rn': rn, 'id': id, 'tokens': tokens{facts.format(f'p{i}r')}}}] FROM p{i}r WHERE rn = 1
  UNION ALL
  SELECT r.n, r.key, r.rn, CASE WHEN len(list_filter(s.leaders, lambda l: {covered})) > 0
         THEN s.leaders ELSE list_append(s.leaders, {{'rn': r.rn, 'id': r.id, 'tokens': r.tokens{facts.format('r')}}})
         END
  FROM p{i}l s JOIN p{i}r r ON r.n = s.n AND r.key = s.key AND r.rn = s.rn + 1),
p{i}f AS (SELECT n, key, arg_max(leaders, rn) AS leaders FROM p{i}l GROUP BY n, key),
p{i}u AS (SELECT n, key, unnest(leaders) AS l FROM p{i}f),
p{i}a AS (
  SELECT r.id, r.n, r.tokens, r.cnt, r.first_id, r.last_id, arg_max(l.id, {{
           'a': CASE WHEN l.id = r.id THEN 2.0 WHEN r.n = 0 THEN 1.0 ELSE {alike} *
             len(list_filter(range(1, r.n + 1), lambda i: l.tokens[i] = r.tokens[i]
                 AND l.tokens[i] <> '<*>')) / CAST(r.n AS DOUBLE) END,
           'b': len(list_filter(l.tokens, lambda t: t = '<*>')), 'c': -l.rn}}) AS leader
  FROM p{i}r r JOIN p{i}u u ON r.n = u.n AND r.key = u.key
  GROUP BY r.id, r.n, r.tokens, r.cnt, r.first_id, r.last_id),
{I.sql_fold(f'p{i}a', 'leader', f'p{i}t')},
p{i} AS (
  SELECT a.leader AS id, a.n, any_value(t.tokens) AS tokens, sum(a.cnt) AS cnt,
         min(a.first_id) AS first_id, max(a.last_id) AS last_id
  FROM p{i}a a JOIN p{i}t t ON t.leader = a.leader GROUP BY a.leader, a.n)"""


def sql_mined(rules: bool = False) -> str:
    return f"""
heads AS (SELECT *, {I.sql_key('tokens', I.sql_prefix_length(4))} AS head FROM shapes),
frequent AS (SELECT n, head FROM heads WHERE n > 1 AND head <> '<*>' GROUP BY n, head
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY sum(cnt) DESC, head) <= 99),
nodes AS (SELECT shape_id AS id, n, tokens, cnt, first_id, last_id, CASE WHEN n < 2 THEN ''
  WHEN (n, head) IN (SELECT (n, head) FROM frequent) THEN head ELSE '<*>' END AS capped FROM heads),
{sql_pass(1, 'nodes', 'capped', 0.4, rules)},
{sql_pass(2, 'p1', I.sql_key('list_reverse(tokens)', I.sql_suffix_length(4)), 0.4, rules)},
{sql_pass(3, 'p2', "''", 0.4, rules)}"""


SQL_MINED = sql_mined()


@query("mine_templates", f"""
WITH RECURSIVE {I.SQL_DOCUMENT_SHAPES}, {SQL_MINED}
SELECT id AS template_id, n, array_to_string(tokens, ' ') AS template,
       CAST(cnt AS BIGINT) AS size, first_id, last_id FROM p3""")
def mine_document_templates(spark, sf_dir):
    """All document lines, three passes, threshold 0.4."""
    mined = mine_templates(I.document_lines(spark, sf_dir), PLAIN)
    return mined.templates.select(
        "template_id", F.col("n").cast("long").alias("n"), I.text_of().alias("template"), "size",
        "first_id", "last_id")


def benchmark_lexicon(spark, sf_dir):
    """A row for each word of the benchmark passages; the tag goes by its length."""
    words = I.table(spark, sf_dir, "benchmark").select(F.explode(T.tokenize(F.col("text"))).alias("token")).distinct()
    return words.select("token", (F.length("token") > 3).alias("known"), F.element_at(
        F.array(*[F.lit(t) for t in TAGS]), F.length("token") % 8 + 1).alias("tag"))


@query("mine_templates_rules", f"""
WITH RECURSIVE {I.SQL_DOCUMENT_SHAPES},
lexicon AS (SELECT DISTINCT token, length(token) > 3 AS known, {list(TAGS)}[length(token) % 8 + 1] AS tag
            FROM (SELECT unnest({I.sql_tokens('text')}) AS token FROM benchmark)),
{sql_mined(True)}
SELECT id AS template_id, n, array_to_string(tokens, ' ') AS template,
       CAST(cnt AS BIGINT) AS size, first_id, last_id FROM p3""")
def mine_templates_rules(spark, sf_dir):
    """All document lines; known words and parts of speech keep lines apart."""
    mined = mine_templates(I.document_lines(spark, sf_dir), PLAIN.with_(dictionary_veto=True, pos_veto=True),
                           lexicon=benchmark_lexicon(spark, sf_dir))
    return mined.templates.select(
        "template_id", F.col("n").cast("long").alias("n"), I.text_of().alias("template"), "size",
        "first_id", "last_id")


SQL_ITEM_TEXT = r"regexp_replace(text, '\d+(\.\d+)?', '<NUM>', 'g')"


@query("mine_item_templates", f"""
WITH {I.SQL_ITEMS}
SELECT 'items' AS dataset, array_to_string(list_transform(string_split(any_value(m), ' '),
         lambda t, i: CASE WHEN i IN (11, 13) THEN '<*>' ELSE t END), ' ') AS template,
       count(*) AS size, count(DISTINCT m) AS shapes
FROM (SELECT {SQL_ITEM_TEXT} AS m FROM lines)""")
def mine_item_templates(spark, sf_dir):
    """Masked line items become one template at the default threshold."""
    lines = I.item_lines(spark, sf_dir).withColumn("dataset", F.lit("items"))
    mined = mine_templates(lines, I.NUMBERED.with_(sim_th=0.4), ["dataset"])
    return mined.templates.select("dataset", I.text_of().alias("template"), "size", "shapes")


def block_links(shapes):
    """Each shape's template by leading and by trailing tokens."""
    links = []
    options = MinerOptions(depth=6)
    for kind, add in (("prefix_key", B.with_prefix_key), ("suffix_key", B.with_suffix_key)):
        key = F.md5(F.concat_ws("|", F.lit(kind), F.col("n").cast("string"),
                                B.key_text(F.col(kind))))
        links.append(add(shapes, options).select("shape_id", "tokens", "cnt",
                                                 key.alias("template_id")))
    return links[0].unionByName(links[1])


@query("fuse_templates", f"""
WITH RECURSIVE {I.SQL_DOCUMENT_SHAPES},
links AS (
  SELECT shape_id, tokens, cnt, md5('prefix_key|' || n || '|' ||
         {I.sql_key('tokens', I.sql_prefix_length(6))}) AS template_id FROM shapes
  UNION ALL
  SELECT shape_id, tokens, cnt, md5('suffix_key|' || n || '|' ||
         {I.sql_key('list_reverse(tokens)', I.sql_suffix_length(6))}) FROM shapes),
edges AS (SELECT DISTINCT a.template_id AS a, b.template_id AS b
          FROM links a JOIN links b USING (shape_id)),
cc(t, label) USING KEY (t) AS (
  SELECT DISTINCT template_id, template_id FROM links
  UNION
  SELECT e.b, min(c.label) FROM cc c JOIN edges e ON e.a = c.t
  JOIN recurring.cc r ON r.t = e.b WHERE c.label < r.label GROUP BY e.b),
labelled AS (SELECT l.*, cc.label AS fused_id FROM links l JOIN cc ON cc.t = l.template_id),
{I.sql_fold('labelled', 'fused_id')}
SELECT l.fused_id, len(any_value(f.tokens)) AS n, array_to_string(any_value(f.tokens), ' ')
         AS template, CAST(sum(cnt) AS BIGINT) AS size, count(DISTINCT template_id) AS members
FROM labelled l JOIN folded f USING (fused_id) GROUP BY l.fused_id""")
def fuse_templates(spark, sf_dir):
    shapes = stage(I.document_shapes(spark, sf_dir), "shapes")
    links = stage(block_links(shapes), "links")
    release(shapes)
    templates = stage(G.merge_group(links, ["template_id"]), "templates")
    drop_shuffles(spark)
    fused = G.fuse_templates(links, templates)
    return fused.select("fused_id", F.col("n").cast("long").alias("n"),
                        I.text_of().alias("template"), "size", "members")


@query("template_sizes", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {sql_block_templates(4)}
SELECT n, count(*) AS templates, CAST(sum(size) AS BIGINT) AS lines,
       CAST(count_if(size = 1) AS BIGINT) AS singletons, max(size) AS largest
FROM templates GROUP BY n""")
def template_sizes(spark, sf_dir):
    templates = block_templates(stage(I.document_shapes(spark, sf_dir), "shapes"), PLAIN)
    return G.template_sizes(templates, ["n"]).withColumn("n", F.col("n").cast("long"))


@query("top_templates", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {sql_block_templates(4)}
SELECT template_id, array_to_string(tokens, ' ') AS template, size FROM templates
ORDER BY size DESC, template_id LIMIT 25""")
def top_templates(spark, sf_dir):
    templates = block_templates(stage(I.document_shapes(spark, sf_dir), "shapes"), PLAIN)
    return G.top_templates(templates, 25).select(
        "template_id", I.text_of().alias("template"), "size")


CUT = "1998-01-01"


def order_templates(lines):
    shapes = distinct_shapes(with_tokens(lines, PLAIN))
    return block_templates(stage(shapes, "shapes"), MinerOptions(depth=6, numeric_tokens=True))


def _sql_order_templates(name: str, where: str) -> str:
    """Order templates of the lines before a day, as in sql_block_templates."""
    inner = I.sql_shapes(I.sql_tokens("text")).replace("FROM lines)", f"FROM lines {where})")
    return f"""{name} AS (
  WITH {inner}, {sql_block_templates(6)} SELECT * FROM templates)"""


@query("change_log", f"""
WITH {I.SQL_ORDERS},
{_sql_order_templates('old', f"WHERE o_orderdate < TIMESTAMP '{CUT}'")},
{_sql_order_templates('new', '')}
SELECT template_id, CASE WHEN old.n IS NULL THEN 'created' WHEN new.n IS NULL THEN 'removed'
         WHEN old.tokens <> new.tokens THEN 'changed' ELSE 'none' END AS change_type,
       array_to_string(coalesce(new.tokens, old.tokens), ' ') AS template_mined,
       coalesce(old.size, 0) AS size_before, coalesce(new.size, 0) AS size_after
FROM old FULL JOIN new USING (template_id)""")
def change_log(spark, sf_dir):
    """The catalog of all order lines against the one as of an earlier day."""
    lines = stage(I.order_lines(spark, sf_dir), "lines")
    before = order_templates(lines.filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp")))
    return G.change_log(before, order_templates(lines))


@query("line_results", f"""
WITH {I.SQL_EVENTS}, masked AS (SELECT line_id, {I.SQL_NUM} AS m FROM lines)
SELECT line_id, 'none' AS change_type, {I.sql_id("string_split(m, ' ')")} AS cluster_id,
       count(*) OVER (PARTITION BY m) AS cluster_size, m AS template_mined,
       (SELECT count(DISTINCT m) FROM masked) AS total_cluster_count
FROM masked""")
def line_results(spark, sf_dir):
    """Event lines with numbers masked; a threshold of 0.9 keeps types apart."""
    lines = I.event_lines(spark, sf_dir)
    mined = mine_templates(lines, I.NUMBERED)
    return G.line_results(assign_lines(lines, mined, I.NUMBERED), mined.templates)


@query("retain_templates", f"""
WITH {I.SQL_DOCUMENT_SHAPES}, {sql_block_templates(4)}
SELECT template_id, n, array_to_string(tokens, ' ') AS template, last_id FROM templates
QUALIFY row_number() OVER (PARTITION BY n ORDER BY last_id DESC, template_id) <= 10""")
def retain_templates(spark, sf_dir):
    """The ten most recently used templates of each length."""
    templates = block_templates(stage(I.document_shapes(spark, sf_dir), "shapes"), PLAIN)
    return G.retain_templates(templates, 10, ["n"]).select(
        "template_id", F.col("n").cast("long").alias("n"), I.text_of().alias("template"),
        "last_id")


@query("lineage", f"""
WITH RECURSIVE {I.SQL_DOCUMENT_SHAPES}, {SQL_MINED}
SELECT a.id AS shape_id, a.leader AS t1, b.leader AS t2, c.leader AS template_id
FROM p1a a JOIN p2a b ON b.id = a.leader JOIN p3a c ON c.id = b.leader""")
def lineage(spark, sf_dir):
    """Template of every shape after each pass."""
    mined = mine_shapes(I.document_shapes(spark, sf_dir), PLAIN)
    return mined.lineage.select("shape_id", "t1", "t2", "template_id")


SQL_MEMBERS = """members AS (SELECT a.id AS shape_id, a.n, a.tokens, a.cnt, c.leader AS template_id
  FROM p1a a JOIN p2a b ON b.id = a.leader JOIN p3a c ON c.id = b.leader)"""


@query("mine_seen_tokens", f"""
WITH RECURSIVE {I.SQL_DOCUMENT_SHAPES}, {SQL_MINED}, {SQL_MEMBERS}
SELECT template_id, pos - 1 AS pos, token, CAST(sum(cnt) AS BIGINT) AS lines FROM (
  SELECT template_id, cnt, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM members)
GROUP BY ALL""")
def mine_seen_tokens(spark, sf_dir):
    """Seen tokens of all members: the state of the first pass, carried through the others."""
    mined = mine_shapes(I.document_shapes(spark, sf_dir), PLAIN)
    lineage = mined.lineage.select("shape_id", "t1", "t2", "template_id")
    state = seen_tokens(mined.shapes.join(lineage, "shape_id").select(F.col("t1").alias("template_id"), "tokens", "cnt"))
    for before, after in (("t1", "t2"), ("t2", "template_id")):
        state = move_seen(state, lineage.select(F.col(before).alias("template_id"), F.col(after).alias("to_id")).distinct())
    return state.withColumn("pos", F.col("pos").cast("long"))


def sql_general(key: str) -> str:
    """A key of at most two tokens and what is more general."""
    return (f"CASE len({key}) WHEN 0 THEN [{key}] WHEN 1 THEN [{key}, ['<*>']] ELSE [{key}, ['<*>', {key}[2]], "
            f"[{key}[1], '<*>'], ['<*>', '<*>']] END")


SQL_HEAD = f"tokens[1:{I.sql_prefix_length(4)}]"
SQL_NUMBERED_HEAD = (f"list_transform({SQL_HEAD}, lambda t: CASE WHEN regexp_matches(t, '{I.DG}') "
                     "THEN '<*>' ELSE t END)")

@query("key_history", f"""
WITH RECURSIVE {I.SQL_DOCUMENT_SHAPES}, {SQL_MINED}, {SQL_MEMBERS},
every AS (SELECT DISTINCT template_id, m.n, CASE WHEN m.n < 2 THEN [] ELSE [capped] END AS key
          FROM members m JOIN nodes ON nodes.id = shape_id),
asked AS (SELECT template_id, n, key, unnest({sql_general('key')}) AS g FROM every),
covered AS (SELECT DISTINCT a.template_id, a.n, a.key FROM asked a JOIN every b
            ON b.template_id = a.template_id AND b.n = a.n AND b.key = a.g WHERE a.g <> a.key),
history AS (SELECT * FROM every ANTI JOIN covered USING (template_id, n, key)),
now AS (SELECT id AS template_id, n, {SQL_HEAD} AS key FROM p3
        UNION SELECT id, n, {SQL_NUMBERED_HEAD} FROM p3),
tried AS (SELECT shape_id, n, unnest(list_distinct({sql_general(SQL_HEAD)})) AS key FROM shapes),
old AS (SELECT DISTINCT shape_id, template_id FROM tried JOIN history USING (n, key)),
cur AS (SELECT DISTINCT shape_id, template_id FROM tried JOIN now USING (n, key))
SELECT shape_id, count(*) AS reached, CAST(count_if(cur.template_id IS NULL) AS BIGINT) AS by_old_keys
FROM old LEFT JOIN cur USING (shape_id, template_id) GROUP BY shape_id""")
def key_history(spark, sf_dir):
    """Templates that each shape reaches by the keys their members came by, and how many
    of them the keys of the folded tokens do not lead to."""
    mined = mine_shapes(I.document_shapes(spark, sf_dir), PLAIN)
    head = F.slice("tokens", F.lit(1), T.prefix_key_length(F.col("n"), PLAIN.depth)).alias("tokens")
    members = mined.shapes.select("shape_id", "n", head, "cnt").join(
        mined.lineage.select("shape_id", "template_id"), "shape_id").select("template_id", "n", "tokens", "cnt")
    history = stage(K.add_keys(None, K.member_keys(members, PLAIN, capped=True), PLAIN), "history")
    now = mined.templates.select("template_id", "n", "tokens")
    current = stage(K.member_keys(now, PLAIN).unionByName(K.member_keys(now, PLAIN.with_(numeric_tokens=False))).distinct(), "keys")
    return K.reached_counts(mined.shapes, history, current, PLAIN)
