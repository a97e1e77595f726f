"""Tokenising and per-token flags (T5-T8) and block keys of one line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from loomline.functions.patterns import DIGIT, SPACE, WHITESPACE, mask_token

SEP = "\u0001"

ESCAPE = "\u0002"


def escape_marks(text: Column) -> Column:
    """``text`` without the separator, so that values can be written next to each other."""
    return F.when(text.rlike(f"[{SEP}{ESCAPE}]"), F.replace(
        F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(SEP), F.lit(ESCAPE + "a"))
    ).otherwise(text)


def unescape_marks(value: Column) -> Column:
    return F.when(F.contains(value, F.lit(ESCAPE)), F.replace(
        F.replace(value, F.lit(ESCAPE + "a"), F.lit(SEP)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))
    ).otherwise(value)


# Token shapes that punctuation splitting leaves whole.
WHOLE_ADDRESS = r"^\d{1,3}(\.\d{1,3}){3}(:\d{1,5})?$"
WHOLE_CLOCK = r"^\d{1,2}:\d{2}(:\d{2})?$"
EDGE_MARKS = r"[,.!?;:]"


def strip_space(text: Column) -> Column:
    """``str.strip`` with its Unicode notion of whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip_space(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def tokenize(text: Column, extra_delimiters: Sequence[str] = ()) -> Column:
    """Trim, turn each extra delimiter (literal) into a space, split on
    whitespace. An empty line has no tokens."""
    out = strip_space(text)
    for delimiter in extra_delimiters:
        out = F.replace(out, F.lit(delimiter), F.lit(" "))
    parts = F.split(out, f"{SPACE}+")
    if extra_delimiters:
        return F.filter(parts, lambda t: t != "")
    # After trimming only the empty line leaves an empty part.
    return F.when(out == "", F.array().cast("array<string>")).otherwise(parts)


def split_punctuation(token: Column, whole_mask: str) -> Column:
    """One token to its parts: edge marks apart, the core split at ``=``/``:``.

    The cut points are marked with a separator by anchored rewrites, at most
    one of the four core rewrites fits a token.
    """
    front = f"((?:{EDGE_MARKS}+{SEP})?)"
    back = f"((?:{SEP}{EDGE_MARKS}+)?)"
    no_eq_colon = f"([^=:{SEP}]*)"
    marked = F.regexp_replace(token, f"^({EDGE_MARKS}+)", f"$1{SEP}")
    marked = F.regexp_replace(marked, f"({EDGE_MARKS}+)$", f"{SEP}$1")
    cores = (
        (f"^{front}{no_eq_colon}=([^:{SEP}]*):([^{SEP}]*){back}$",
         f"$1$2{SEP}={SEP}$3{SEP}:{SEP}$4$5"),
        (f"^{front}{no_eq_colon}:([^={SEP}]*)=([^{SEP}]*){back}$",
         f"$1$2{SEP}:{SEP}$3{SEP}={SEP}$4$5"),
        (f"^{front}{no_eq_colon}={no_eq_colon}{back}$", f"$1$2{SEP}={SEP}$3$4"),
        (f"^{front}{no_eq_colon}:{no_eq_colon}{back}$", f"$1$2{SEP}:{SEP}$3$4"),
    )
    for pattern, replacement in cores:
        marked = F.regexp_replace(marked, pattern, replacement)
    keep = f"(?U)(?:{WHOLE_ADDRESS}|{WHOLE_CLOCK}|^{whole_mask}$)"
    return F.when(token.rlike(keep), F.array(token)).otherwise(F.split(marked, SEP))


def tokenize_punct(text: Column, extra_delimiters: Sequence[str] = (),
                   mask_prefix: str = "<", mask_suffix: str = ">") -> Column:
    """Tokenise and split punctuation off; empty parts are dropped."""
    whole_mask = mask_token(mask_prefix, mask_suffix)
    parts = F.transform(tokenize(text, extra_delimiters),
                        lambda t: split_punctuation(t, whole_mask))
    return F.filter(F.flatten(parts), lambda p: p != "")


def has_digit(token: Column) -> Column:
    return token.rlike(DIGIT)


def is_all_caps(token: Column) -> Column:
    """Every letter is upper case; true for a token without letters."""
    return ~token.rlike(r"[\p{L}&&[^\p{Lu}]]")


def is_snake_or_camel(token: Column) -> Column:
    return token.rlike(r"^[a-z]+(_[a-z]+)+$") | token.rlike(r"^[a-zA-Z]+([A-Z][a-z0-9]+)+$")


def is_scoped_name(token: Column) -> Column:
    return token.rlike(r"^[^:]+::[^:]+$")


def is_mask(token: Column, prefix: str = "<", suffix: str = ">") -> Column:
    """Token starts with a mask."""
    return token.rlike("^" + mask_token(prefix, suffix))


def holds_mask(token: Column, prefix: str = "<", suffix: str = ">") -> Column:
    return token.rlike(mask_token(prefix, suffix))


def holds_path_mark(token: Column) -> Column:
    return token.rlike("[_/]")


def numeric_to_wildcard(tokens: Column, wildcard: str = "<*>") -> Column:
    """Tokens with a digit become the wildcard (only in block keys)."""
    return F.transform(tokens, lambda t: F.when(has_digit(t), F.lit(wildcard)).otherwise(t))


def prefix_key_length(n: Column, depth: int) -> Column:
    """How many leading tokens form the block key: min(depth-2, n) - 1."""
    return F.greatest(F.least(F.lit(depth - 2), n) - 1, F.lit(0))


def suffix_key_length(n: Column, depth: int) -> Column:
    """How many trailing tokens form the block key: half the line, by depth."""
    half = F.when(n % 2 == 0, n / 2 + 1).otherwise((n + 1) / 2).cast("int")
    return F.when(n == 0, F.lit(0)).otherwise(
        F.least(half, n, F.lit(max(depth - 3, 1))))


def prefix_key(tokens: Column, n: Column, depth: int, numeric_tokens: bool = True,
               wildcard: str = "<*>") -> Column:
    head = F.slice(tokens, F.lit(1), prefix_key_length(n, depth))
    return numeric_to_wildcard(head, wildcard) if numeric_tokens else head


def suffix_key(tokens: Column, n: Column, depth: int, numeric_tokens: bool = True,
               wildcard: str = "<*>") -> Column:
    tail = F.slice(F.reverse(tokens), F.lit(1), suffix_key_length(n, depth))
    return numeric_to_wildcard(tail, wildcard) if numeric_tokens else tail


def content_id(tokens: Column) -> Column:
    """128-bit content hash of a token sequence; stable under retry. Every token is
    written behind its length, so no two sequences are written alike."""
    return F.md5(F.array_join(F.transform(
        tokens, lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), ""))


def token_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def pack_tokens(tokens: Column) -> Column:
    """A token sequence as one text with its length, which shuffles and sorts at a fraction
    of the size of the array. Where a token holds the separator the text is JSON."""
    n, text = F.size(tokens), F.array_join(tokens, SEP)
    plain = F.length(text) - F.length(F.replace(text, F.lit(SEP), F.lit(""))) == F.greatest(n - 1, F.lit(0))
    clear = F.coalesce(plain, F.lit(False))
    return F.struct(n.alias("n"), clear.alias("plain"),
                    F.when(clear, text).otherwise(F.to_json(tokens)).alias("text"))


def unpack_tokens(packed: Column) -> Column:
    """The sequence that ``pack_tokens`` wrote."""
    return (F.when(~packed["plain"], F.from_json(packed["text"], "array<string>"))
            .when(packed["n"] == 0, F.array().cast("array<string>"))
            .otherwise(F.split(packed["text"], SEP, -1)))
