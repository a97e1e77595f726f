"""Parameter values of matched lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomline.functions.patterns import quote
from loomline.functions.tokens import SEP, escape_marks, unescape_marks
from loomline.operators.ranking import top_per_group
from loomline.options import MinerOptions, mask_names

PARAMETERS = "array<struct<value:string,mask_name:string>>"


def _capture_patterns(options: MinerOptions, exact: bool) -> dict[str, str]:
    """Per mask name the body of its capture group. Inner named groups carry a
    marker that is replaced by the number of the occurrence."""
    bodies: dict[str, str] = {}
    for name in mask_names(options.masks):
        allowed = []
        for mask in options.masks:
            if not exact or mask.name != name:
                continue
            if mask.apply is not None:
                allowed.append(".+?")
                continue
            body = re.sub(r"\(\?P<(\w+)>", r"(?<\1x@x>", mask.pattern)
            body = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1x@x>", body)
            allowed.append(re.sub(r"\\(?!0)\d{1,2}", "(?:.+?)", body))
        if not exact or name == "*":
            allowed.append(".+?")
        bodies[name] = "|".join(allowed)
    bodies.setdefault("*", ".+?")
    return bodies


def extraction_patterns(templates: DataFrame, options: MinerOptions, exact: bool = True,
                        template_col: str = "template") -> DataFrame:
    """Add the extraction regex of each template, once per catalog row.

    Adds ``names`` (mask names in order), ``regex`` (anchored, one named group
    per parameter) and ``pick`` (a replacement: a separator, which no escaped line
    holds, and the groups).
    """
    bodies = _capture_patterns(options, exact)
    prefix, suffix = options.mask_prefix, options.mask_suffix
    any_mask = (f"{quote(prefix)}({'|'.join(quote(n) for n in bodies)}){quote(suffix)}")
    template = escape_marks(F.col(template_col))
    names = F.regexp_extract_all(template, F.lit(any_mask), F.lit(1))
    literals = F.transform(
        F.split(template, any_mask, -1),
        lambda s: F.concat(F.lit(r"\Q"), F.replace(
            F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(" "), F.lit(r"\E\s+\Q")),
            F.lit(r"\E")))
    bodies_map = F.create_map(*[F.lit(x) for pair in bodies.items() for x in pair])
    groups = F.transform("names", lambda n, i: F.concat(
        F.lit("(?<p"), i.cast("string"), F.lit(">"),
        F.replace(F.element_at(bodies_map, n), F.lit("x@x"), F.concat(F.lit("x"), i.cast("string"))),
        F.lit(")")))
    pieces = F.zip_with(literals, groups, lambda s, g: F.concat(s, F.coalesce(g, F.lit(""))))
    return (templates.withColumn("names", names)
            .withColumn("regex", F.concat(F.lit("(?Ud)^"), F.array_join(pieces, ""), F.lit("$")))
            .withColumn("pick", F.concat(F.lit(SEP), F.array_join(F.transform(
                "names", lambda n, i: F.concat(F.lit("${p"), i.cast("string"), F.lit("}"))), SEP))))


def _call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def extract_parameters(lines: DataFrame, templates: DataFrame, options: MinerOptions,
                       exact: bool = True, keys: Sequence[str] = (),
                       text_col: str = "text", template_col: str = "template") -> DataFrame:
    """Add ``parameters``: ordered ``(value, mask_name)``, NULL if the line does
    not fit its template.

    ``lines(template_id, text)`` join ``templates(template_id, template)``. One
    match tells whether the line fits and yields all values: the result starts with
    a separator only then, and the groups behind it are split. Rows are grouped by template inside each partition so
    that a compiled regex serves a run of lines; a template with most of the
    lines still spreads over all partitions.
    """
    catalog = extraction_patterns(
        templates.select(*keys, "template_id", template_col), options, exact, template_col)
    text = escape_marks(F.col(text_col))
    for delimiter in options.extra_delimiters:
        text = F.replace(text, F.lit(delimiter), F.lit(" "))
    joined = lines.join(catalog, [*keys, "template_id"]).sortWithinPartitions("template_id")
    # An array of one, exploded: the match is not computed again where it is used twice.
    found = joined.withColumn("_found", F.explode(F.array(
        _call("regexp_replace", text, F.col("regex"), F.col("pick")))))
    values = F.slice(F.split("_found", SEP, -1), 2, 1 << 30)
    parameters = F.when(
        F.col("_found").startswith(SEP),
        F.when(F.size("names") == 0, F.array().cast(PARAMETERS)).otherwise(
            F.zip_with(values, F.col("names"), lambda v, m: F.struct(
                unescape_marks(v).alias("value"), m.alias("mask_name")))))
    return found.withColumn("parameters", parameters).drop("names", "regex", "pick", "_found")


def parameter_values(lines: DataFrame, templates: DataFrame, options: MinerOptions,
                     keys: Sequence[str] = (), text_col: str = "text",
                     template_col: str = "template") -> DataFrame:
    """Values only, matched loosely; an empty array if the line does not fit."""
    out = extract_parameters(lines, templates, options, False, keys, text_col, template_col)
    values = F.transform("parameters", lambda p: p["value"])
    return out.withColumn(
        "values", F.coalesce(values, F.array().cast("array<string>"))).drop("parameters")


def parameter_table(extracted: DataFrame, top: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Per template and parameter: lines, distinct values and the ``top`` most
    frequent values with their rank."""
    place = [*keys, "template_id", "pos", "mask_name"]
    values = extracted.select(*keys, "template_id", F.posexplode("parameters").alias("_p", "p"))
    counted = (values.select(*keys, "template_id", (F.col("_p") + 1).alias("pos"), "p.*")
               .groupBy(*place, "value").agg(F.count("*").alias("value_lines")))
    totals = counted.groupBy(*place).agg(
        F.sum("value_lines").alias("lines"), F.count("*").alias("distinct_values"))
    order = [F.desc("value_lines"), F.asc("value")]
    ranked = top_per_group(counted, place, order, top, F.col("value"), "rank")
    return ranked.join(totals, place)
