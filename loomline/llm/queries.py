"""The registered queries of the operators, with their checking SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.llm import (
    html_text, jaccard_join, lattice_dedup, mixing, packing, phrase_mining, pii, quality_rules,
    suffix_tree, token_blocks, toxicity, warc, whitening)
from loomline.llm.common import crc_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PII_KEY = "loomline.llm.pii.key"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def vocabulary_path(name: str = packing.VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key(spark: SparkSession) -> str:
    """The key of the session. Where none is set a random one is drawn and kept in the
    session, so values are linked within it and nobody can undo them later."""
    key = spark.conf.get(PII_KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(PII_KEY, key)
    return key


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS to_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.id) AS n_links, min(to_id) AS component_id,
       id = min(to_id) AS kept FROM r GROUP BY id"""


@query("op1_lattice_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).drop("core_size")


@query("op2_html_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op3_suffix_tree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder("doc_id") == 1
    scored = suffix_tree.learn_and_score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)),
      lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT s, len(s) AS n, min(doc_id) AS id FROM s GROUP BY s),
e AS (SELECT id, n, unnest(s) AS x FROM c),
l AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id
      AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT id, id AS to_id FROM c UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id),
k AS (SELECT id, min(to_id) AS component FROM r GROUP BY id)
SELECT w.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, coalesce(k.component, w.doc_id) AS component_id
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c USING (s) LEFT JOIN k USING (id)"""


@query("op4_jaccard_join", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf_dir, "documents")).drop("class_id")


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target",
                          (F.col("size") * F.size("copies")).cast("long").alias("taken"))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), pii_key(spark))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_remainder("doc_id") != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (crc_remainder("doc_id") == 0).alias("held_out"), "score", "predicted")


OP9_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT *, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: list_slice(w, i, i + 4)) AS ws FROM t),
places AS (SELECT rowid_ AS r, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS k
        FROM (SELECT row_number() OVER () AS rowid_, * FROM win)),
dup AS (SELECT r, pos, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS prev
        FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, k) AS n FROM places) WHERE n > 1),
rep AS (SELECT r, sum(least(5, pos - coalesce(prev, -5)))::BIGINT AS n FROM dup GROUP BY r),
c AS (SELECT row_number() OVER () AS r, doc_id, len(w)::BIGINT AS n_words,
             length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
             len(list_filter(w, lambda x: list_contains({stop}, x))) AS stops FROM win),
f AS (SELECT c.*, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT coalesce(word_chars / nullif(n_words, 0)::DOUBLE NOT BETWEEN 2 AND 20, false)
       AND NOT coalesce(n_symbols / nullif(n_words, 0)::DOUBLE > 0.2, false)
       AND NOT coalesce(n_dup_lines / nullif(len(ls), 0)::DOUBLE > 0.5, false)
       AND NOT coalesce(n_words >= 50 AND stops / nullif(n_words, 0)::DOUBLE < 0.01, false) AS kept
FROM b""".replace("{stop}", "[" + ", ".join(sorted({
    f"'{f}'" for w in quality_rules.STOP_WORDS for f in (w, w.capitalize())})) + "]")


@query("op9_quality_rules", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d
           FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS original FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to
FROM m"""


@query("op10_warc", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(pages, warc.archive_folder(pages))
    return warc.read_archives(archives, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
t AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 2))) AS k FROM s),
f AS (SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, k, count(*) AS f
      FROM t GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS g, f AS a FROM f WHERE k > 1 AND f >= 30),
ks AS (SELECT lang, phrase, g, a, unnest(range(1, len(g))) AS k FROM c),
sides AS (SELECT lang, phrase, a, k, array_to_string(list_slice(g, 1, k), ' ') AS first,
                 array_to_string(list_slice(g, k + 1, len(g)), ' ') AS rest FROM ks),
cuts AS (SELECT s.lang, s.phrase, s.a, s.k, x.f AS l, y.f AS r, (2000000::HUGEINT * s.a) // (x.f + y.f) AS score
         FROM sides s JOIN f x ON x.lang = s.lang AND x.phrase = s.first
                      JOIN f y ON y.lang = s.lang AND y.phrase = s.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
starts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS i FROM c),
lens AS (SELECT lang, g, a, i, unnest(range(2, len(g) - i + 2)) AS k FROM starts),
parts AS (SELECT lang, a AS b, array_to_string(list_slice(g, i, i + k - 1), ' ') AS phrase
          FROM lens WHERE k < len(g)),
gone AS (SELECT DISTINCT best.lang, best.phrase FROM best JOIN parts USING (lang, phrase) WHERE 100 * b >= 80 * a),
top AS (SELECT lang, phrase, a, l, r, score::BIGINT AS score,
               row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
        FROM best ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM top JOIN n USING (lang) WHERE rank <= 2000"""


@query("op11_phrase_mining", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


@query("op12_token_blocks")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = token_blocks.write_blocks(docs, vocabulary_path(token_blocks.VOCABULARY),
                                        token_blocks.block_folder(docs))
    return token_blocks.read_blocks(written)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))
