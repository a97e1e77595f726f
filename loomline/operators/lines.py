"""From text lines to distinct token shapes."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from loomline.functions import tokens as T
from loomline.functions.masks import apply_mask, mask_text
from loomline.functions.patterns import jvm_pattern
from loomline.options import Mask, MinerOptions

PIECE_TOKENS = 1 << 18


def line_tokens(text: Column, options: MinerOptions) -> Column:
    """Mask and tokenise one text column; a null text is an empty line."""
    masked = mask_text(F.coalesce(text, F.lit("")), options.masks, options.mask_prefix, options.mask_suffix)
    if options.punctuation:
        return T.tokenize_punct(masked, options.extra_delimiters,
                                options.mask_prefix, options.mask_suffix)
    return T.tokenize(masked, options.extra_delimiters)


def with_tokens(lines: DataFrame, options: MinerOptions, text_col: str = "text") -> DataFrame:
    return lines.withColumn("tokens", line_tokens(F.col(text_col), options))


def distinct_shapes(tokenized: DataFrame, keys: Sequence[str] = (),
                    id_col: str = "line_id") -> DataFrame:
    """Distinct token sequences with count, first and last line id.

    Grouping on the tokens directly after masking keeps the regexes on the map
    side, once per line, and combines counts before the shuffle. Tokens are
    shuffled as one text.
    """
    packed = tokenized.select(*keys, F.col(id_col).alias("_id"), T.pack_tokens(F.col("tokens")).alias("_packed"))
    shapes = packed.groupBy(*keys, "_packed").agg(
        F.count("*").alias("cnt"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))
    return shapes.withColumn("tokens", T.unpack_tokens(F.col("_packed"))).select(
        *keys, T.content_id(F.col("tokens")).alias("shape_id"),
        F.size("tokens").alias("n"), "tokens", "cnt", "first_id", "last_id")


def mask_profile(lines: DataFrame, masks: Sequence[Mask], text_col: str = "text",
                 prefix: str = "<", suffix: str = ">") -> DataFrame:
    """Per mask name, in chain order: lines hit and matches found.

    Steps of the same name are summed. A mask behind a greedy one shows zero.
    """
    # One projection per step, so that each regex of the chain runs once.
    chain = lines.select(F.col(text_col).alias("_text"))
    steps = []
    for order, mask in enumerate(masks, start=1):
        after = apply_mask(F.col("_text"), mask, prefix, suffix)
        if mask.apply is not None:
            hits = (after != F.col("_text")).cast("long")
        else:
            hits = F.regexp_count("_text", F.lit(jvm_pattern(mask.pattern))).cast("long")
        steps.append(F.struct(F.lit(order).alias("step"), F.lit(mask.name).alias("mask_name"),
                              F.col(f"_h{order}").alias("hits")))
        chain = chain.select(after.alias("_text"), hits.alias(f"_h{order}"),
                             *[f"_h{i}" for i in range(1, order)])
    per_line = chain.select(F.explode(F.array(*steps)).alias("s")).select("s.*")
    return per_line.groupBy("mask_name").agg(
        F.min("step").alias("first_step"),
        F.count_if(F.col("hits") > 0).alias("lines_hit"),
        F.sum("hits").alias("matches"))


def token_flags(token: Column, prefix: str = "<", suffix: str = ">") -> dict[str, Column]:
    """Flags of one token."""
    return {
        "all_caps": T.is_all_caps(token),
        "snake_or_camel": T.is_snake_or_camel(token),
        "mask": T.is_mask(token, prefix, suffix),
        "scoped_name": T.is_scoped_name(token),
        "path_mark": T.holds_path_mark(token),
        "digit": T.has_digit(token),
    }


def token_classes(shapes: DataFrame, prefix: str = "<", suffix: str = ">") -> DataFrame:
    """Distinct tokens with their occurrences and flags."""
    counted = (shapes.select("cnt", F.explode("tokens").alias("token"))
               .groupBy("token").agg(F.sum("cnt").alias("occurrences")))
    flags = token_flags(F.col("token"), prefix, suffix)
    return counted.select("token", "occurrences", *[c.alias(n) for n, c in flags.items()])


def token_dictionary(shapes: DataFrame, min_lines: int = 2,
                     lexicon: DataFrame | None = None) -> DataFrame:
    """Corpus vocabulary: ``token, lines, occurrences, positions, in_vocab``.

    A token is known if ``lexicon(token)`` lists it, or, without a lexicon, if
    at least ``min_lines`` lines hold it and it has only letters.
    """
    placed = shapes.select("shape_id", "cnt", F.posexplode("tokens").alias("pos", "token"))
    per_place = placed.groupBy("token", "pos").agg(F.sum("cnt").alias("occurrences"))
    places = per_place.groupBy("token").agg(
        F.sum("occurrences").alias("occurrences"), F.count("*").alias("positions"))
    lines = (shapes.select("cnt", F.explode(F.array_distinct("tokens")).alias("token"))
             .groupBy("token").agg(F.sum("cnt").alias("lines")))
    words = places.join(lines, "token")
    if lexicon is None:
        known = (F.col("lines") >= min_lines) & F.col("token").rlike(r"^\p{L}+$")
        return words.withColumn("in_vocab", known)
    listed = lexicon.select("token").distinct().withColumn("in_vocab", F.lit(True))
    return (words.join(listed, "token", "left")
            .withColumn("in_vocab", F.coalesce("in_vocab", F.lit(False))))


def annotate_tokens(shapes: DataFrame, lexicon: DataFrame, values: Sequence[str],
                    id_col: str = "shape_id") -> DataFrame:
    """Add one array per ``values`` column of ``lexicon(token, ...)``, aligned
    with ``tokens``; unknown tokens are NULL.

    Shapes are dealt into pieces of about ``PIECE_TOKENS`` tokens by a hash of their
    id. The distinct tokens of a piece meet the lexicon on the token and come back to
    it, so no row is made for each place; inside a piece Arrow looks them up.
    """
    tokens = shapes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    piece = F.pmod(F.xxhash64(id_col), F.lit(tokens // PIECE_TOKENS + 1)).alias("_piece")
    words = shapes.select(piece, F.explode("tokens").alias("token")).distinct()
    found = words.join(lexicon.select("token", *values), "token")
    dealt = (shapes.select(piece, *[c for c in shapes.columns if c != "tokens"], T.pack_tokens(F.col("tokens")).alias("tokens"))
             .repartition("_piece").withColumn("tokens", T.unpack_tokens(F.col("tokens"))))
    kinds = dict(lexicon.dtypes)
    schema = StructType([*[f for f in dealt.schema if f.name != "_piece" and f.name not in values],
                         *[StructField(v, ArrayType(lexicon.schema[v].dataType)) for v in values]])

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        tokens = rows["tokens"].combine_chunks()
        at = pc.index_in(tokens.flatten(), value_set=known["token"].combine_chunks())
        ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(
            pc.fill_null(pc.list_value_length(tokens), 0)).cast(pa.int32())])
        out = rows.drop_columns([c for c in rows.column_names if c == "_piece" or c in values])
        for value in values:
            out = out.append_column(value, pa.ListArray.from_arrays(ends, known[value].combine_chunks().take(at)))
        return out

    found = found.select("_piece", "token", *values)
    named = dealt.groupBy("_piece").cogroup(found.groupBy("_piece")).applyInArrow(look_up, schema)
    return named.select(*[c for c in shapes.columns if c not in values], *[F.coalesce(
        v, F.array().cast(f"array<{kinds[v]}>")).alias(v) for v in values])
