"""Ordered regex steps over a text column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from loomline.functions.patterns import ASCII_FLAGS, FLAGS, jvm_pattern, quote_replacement
from loomline.options import Mask


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _steps(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """Run (pattern, replacement) steps in order. Unicode classes make a regex
    several times slower and change nothing on ASCII text, so ASCII lines, the
    common case, go through the plain patterns."""
    def run(flags: str) -> Column:
        return reduce(lambda c, s: F.regexp_replace(c, jvm_pattern(s[0], flags), s[1]),
                      steps, text)

    if not steps:
        return text
    if not all(to.isascii() for _, to in steps):
        return run(FLAGS)
    return F.when(is_ascii(text), run(ASCII_FLAGS)).otherwise(run(FLAGS))


def delete_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """Remove every match of each pattern, in order."""
    return _steps(text, [(p, "") for p in patterns])


def replace_patterns(text: Column, patterns: Sequence[str], wildcard: str = "<*>") -> Column:
    """Replace every match of each pattern by the wildcard, in order."""
    return _steps(text, [(p, quote_replacement(wildcard)) for p in patterns])


def mask_text(text: Column, masks: Sequence[Mask], prefix: str = "<", suffix: str = ">") -> Column:
    """Run the masks in order; each one reads the output of the one before."""
    steps: list[tuple[str, str]] = []
    for mask in masks:
        if mask.apply is None:
            steps.append((mask.pattern, quote_replacement(f"{prefix}{mask.name}{suffix}")))
        else:
            text, steps = mask.apply(_steps(text, steps)), []
    return _steps(text, steps)


def apply_mask(text: Column, mask: Mask, prefix: str = "<", suffix: str = ">") -> Column:
    return mask_text(text, [mask], prefix, suffix)
