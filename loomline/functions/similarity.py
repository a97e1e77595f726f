"""Position-wise comparison of token sequences of equal length (M1-M6)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomline.functions import tokens as T
from loomline.functions.patterns import mask_token

# Parts of speech of function words, tested as substrings of a tag.
FUNCTION_TAGS = ("CC", "DT", "EX", "FW", "IN", "LS", "MD", "PDT", "POS", "PRP", "PRP$",
                 "RB", "RBR", "RBS", "RP", "SYM", "TO", "UH")


def _count(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x))


def merge_pair(a: Column, b: Column, wildcard: str = "<*>") -> Column:
    """Keep a token where both agree, else the wildcard."""
    return F.zip_with(a, b, lambda x, y: F.when(x == y, y).otherwise(F.lit(wildcard)))


def positional_similarity(template: Column, line: Column, wildcard: str = "<*>",
                          include_params: bool = False) -> Column:
    """``struct(sim, params)``; wildcards of the template are parameters."""
    n = F.size(template)
    params = _count(F.transform(template, lambda t: t == wildcard))
    same = _count(F.zip_with(template, line, lambda t, x: (t == x) & (t != wildcard)))
    hits = same + params if include_params else same
    sim = F.when(n == 0, F.lit(1.0)).otherwise(hits.cast("double") / n)
    return F.struct(sim.alias("sim"), params.alias("params"))


def seen_token_similarity(template: Column, line: Column, seen: Column,
                          include_params: bool = True,
                          prefix: str = "<", suffix: str = ">") -> Column:
    """Like M1, but a masked position counts only if the line's token was seen
    there before. ``seen`` is an array of token arrays, one per position."""
    n = F.size(template)
    same = _count(F.zip_with(template, line, lambda t, x: t == x))
    masked = F.transform(
        F.arrays_zip(template.alias("t"), line.alias("x"), seen.alias("s")),
        lambda z: (z["t"] != z["x"])
        & (T.is_mask(z["t"], prefix, suffix) | T.is_mask(z["x"], prefix, suffix))
        & F.coalesce(F.array_contains(z["s"], z["x"]), F.lit(False)))
    params = _count(masked)
    hits = same + params if include_params else same
    sim = F.when(n == 0, F.lit(1.0)).otherwise(hits.cast("double") / n)
    return F.struct(sim.alias("sim"), params.alias("params"))


def _at(tokens: Column, i: Column) -> Column:
    """Token at 1-based ``i``, empty outside the line."""
    return F.coalesce(F.try_element_at(tokens, i), F.lit(""))


def _comparable(t: Column, x: Column, prefix: str, suffix: str) -> Column:
    """Positions the vetoes look at: different literals without masks, and
    either both without digits or both in capitals."""
    anywhere = mask_token(prefix, suffix)
    return ((t != x)
            & ((~T.has_digit(t) & ~T.has_digit(x)) | (T.is_all_caps(t) & T.is_all_caps(x)))
            & ~t.rlike(anywhere) & ~x.rlike(anywhere))


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _veto(template: Column, line: Column, rule, prefix: str, suffix: str) -> Column:
    n = F.size(template)

    def at(i: Column) -> Column:
        t, x = _at(template, i), _at(line, i)
        return _comparable(t, x, prefix, suffix) & rule(i, n, t, x)

    return F.exists(_positions(n), at)


def static_position_veto(template: Column, line: Column,
                         prefix: str = "<", suffix: str = ">") -> Column:
    """True when two different literals stand where the line looks fixed."""

    def rule(i, n, t, x):
        inner = (i > 1) & (i < n)
        after_colon = (_at(template, i - 1) == ":") | (_at(line, i - 1) == ":")
        before_mark = (_at(template, i + 1).isin(",", ".", ":")
                       | _at(line, i + 1).isin(",", ".", ":"))
        names_value = _at(line, i + 1).isin("=", ":")
        t_caps, x_caps = T.is_all_caps(t), T.is_all_caps(x)
        return ((n == 1)
                | (T.is_snake_or_camel(t) & T.is_snake_or_camel(x))
                | (inner & names_value)
                | ((i == 1) & (names_value | T.is_scoped_name(t) | T.is_scoped_name(x)))
                | (inner & after_colon & ~before_mark & t_caps & x_caps)
                | ((i == n) & (i > 1) & after_colon & t_caps & x_caps)
                | t_caps | x_caps)

    return _veto(template, line, rule, prefix, suffix)


def dictionary_veto(template: Column, line: Column, template_vocab: Column, line_vocab: Column,
                    template_tags: Column | None = None,
                    prefix: str = "<", suffix: str = ">") -> Column:
    """Two different known words between equal neighbours, or as the value
    between ``=``/``:`` and a mark. ``*_vocab`` are boolean arrays."""

    def rule(i, n, t, x):
        inner = (i > 1) & (i < n)
        known = (F.coalesce(F.try_element_at(template_vocab, i), F.lit(False))
                 & F.coalesce(F.try_element_at(line_vocab, i), F.lit(False)))
        same_neighbours = ((_at(template, i - 1) == _at(line, i - 1))
                           & (_at(template, i + 1) == _at(line, i + 1)))
        if template_tags is not None:
            same_neighbours &= ~_at(template_tags, i - 1).isin("IN", "TO")
        value_place = ((_at(template, i - 1).isin("=", ":") | _at(line, i - 1).isin("=", ":"))
                       & (_at(template, i + 1).isin(",", ".", ":")
                          | _at(line, i + 1).isin(",", ".", ":")))
        return inner & known & (same_neighbours | value_place)

    return _veto(template, line, rule, prefix, suffix)


def pos_veto(template: Column, line: Column, template_tags: Column, line_tags: Column,
             prefix: str = "<", suffix: str = ">") -> Column:
    """Two different words whose parts of speech say the place is fixed.

    ``*_tags`` are tag arrays from a lexicon of the caller, aligned with the
    tokens; see ``operators.tokens.annotate_tokens``.
    """
    function_word = "|".join(tag.replace("$", r"\$") for tag in FUNCTION_TAGS)

    def rule(i, n, t, x):
        tag_t, tag_x = _at(template_tags, i), _at(line_tags, i)
        prev_t, prev_x = _at(template, i - 1), _at(line, i - 1)
        prev_tag_t, prev_tag_x = _at(template_tags, i - 1), _at(line_tags, i - 1)
        content_word = tag_t.rlike("VB|JJ|NN") | tag_x.rlike("VB|JJ|NN")
        plain = ~T.holds_path_mark(t) & ~T.holds_path_mark(x)
        leads = ((i == 1) & plain
                 & ~_at(template_tags, i + 1).startswith("VB")
                 & ~_at(line_tags, i + 1).startswith("VB"))
        same_lead_in = (prev_t == prev_x) & (prev_tag_t.rlike("^(JJ|VB)")
                                             | prev_tag_x.rlike("^(JJ|VB)"))
        unlinked = ((i > 1) & plain
                    & ~prev_t.isin(":", "=") & ~prev_tag_t.isin("IN", "TO")
                    & ~prev_x.isin(":", "=") & ~prev_tag_x.isin("IN", "TO")
                    & (~T.has_digit(t) | ~T.has_digit(x))
                    & ~same_lead_in)
        verb_after_link = (i > 1) & tag_t.contains("VB") & prev_tag_t.isin("IN", "TO")
        return (tag_t.rlike(function_word) | tag_x.rlike(function_word)
                | (F.substring(tag_t, 1, 1) != F.substring(tag_x, 1, 1))
                | (content_word & (leads | unlinked | verb_after_link)))

    return _veto(template, line, rule, prefix, suffix)


def dynamic_threshold(n: Column) -> Column:
    """``round(1 - log2(n)/n, 1)``; 1.0 for an empty line."""
    size = n.cast("double")
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.round(F.lit(1.0) - F.log2(size) / size, 1))


def threshold(n: Column, sim_th: float) -> Column:
    return dynamic_threshold(n) if sim_th == 0.0 else F.lit(float(sim_th))
