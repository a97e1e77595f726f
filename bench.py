"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores. Each table is
one Parquet row group, which one task reads, so before the clock starts the tables are
written again as a file a core, as a user would keep them.
Every query is run to its end by an aggregate over all of its columns, so that
nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomline.functions import masks as K  # noqa: E402
from loomline.functions import tokens as T  # noqa: E402
from loomline.operators import merging as G  # noqa: E402
from loomline.operators import params as P  # noqa: E402
from loomline.operators.lines import distinct_shapes, with_tokens  # noqa: E402
from loomline.operators.matching import match_lines  # noqa: E402
from loomline.options import DEFAULT_MASKS, MinerOptions, TUNED_MASKS  # noqa: E402
from loomline.plans.benchmark import benchmark_run  # noqa: E402
from loomline.plans.mining import assign_lines, mine_templates  # noqa: E402
from loomline.queries import QUERIES  # noqa: E402
from loomline.queries import inputs as I  # noqa: E402
from loomline.queries.evaluating import datasets  # noqa: E402
from loomline.session import fresh_dir, local_session, stage  # noqa: E402

MASKED = MinerOptions(masks=DEFAULT_MASKS)
TUNED = MinerOptions(masks=TUNED_MASKS, punctuation=True, static_veto=True, sim_th=0.0)


def spread_tables(spark, sf: str, files: int) -> str:
    """A folder with the tables of the bench, each in ``files`` files."""
    folder = fresh_dir(spark, "bench")
    for name in ("lineitem", "events", "orders"):
        I.table(spark, sf, name).repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def drain(df: DataFrame) -> int:
    row = df.select(F.xxhash64(*df.columns).alias("h")).agg(
        F.count("*").alias("rows"), F.bit_xor("h")).first()
    return row["rows"]


def mask_items(spark, sf):
    return I.item_lines(spark, sf).select(
        "line_id",
        K.mask_text(F.col("text"), TUNED_MASKS).alias("text"))


def tokenize_items(spark, sf):
    return I.item_lines(spark, sf).select(
        "line_id",
        T.tokenize_punct(F.col("text")).alias("tokens"))


def shapes_items(spark, sf):
    return distinct_shapes(with_tokens(I.item_lines(spark, sf), MASKED))


def mine_items(spark, sf):
    lines = I.item_lines(spark, sf)
    mined = mine_templates(lines, MASKED)
    return G.line_results(assign_lines(lines, mined, MASKED), mined.templates)


def mine_items_tuned(spark, sf):
    lines = I.item_lines(spark, sf)
    mined = mine_templates(lines, TUNED)
    return G.line_results(assign_lines(lines, mined, TUNED), mined.templates)


def mine_items_unmasked(spark, sf):
    return mine_templates(I.item_lines(spark, sf), MinerOptions()).templates


def match_items(spark, sf):
    shapes = stage(distinct_shapes(with_tokens(I.item_lines(spark, sf), MinerOptions())), "shapes")
    catalog = mine_templates(I.event_lines(spark, sf).unionByName(
        I.item_lines(spark, sf), allowMissingColumns=True), MASKED).templates
    wide = catalog.withColumn("tokens", F.transform("tokens", lambda t: F.when(
        t.contains("<"), "<*>").otherwise(t)))
    return match_lines(shapes, wide, MinerOptions(), "fallback")


def extract_items(spark, sf):
    lines = I.item_lines(spark, sf)
    mined = mine_templates(lines, MASKED)
    tagged = assign_lines(lines, mined, MASKED)
    return P.extract_parameters(tagged, mined.templates.select(
        "template_id", I.text_of().alias("template")), MASKED)


def score_datasets(spark, sf):
    return benchmark_run(datasets(spark, sf), MinerOptions())[0]


HEADLINE = {
    "mask_items": mask_items,
    "tokenize_punct_items": tokenize_items,
    "distinct_shapes_items": shapes_items,
    "mine_items": mine_items,
    "mine_items_tuned": mine_items_tuned,
    "mine_items_unmasked": mine_items_unmasked,
    "match_items": match_items,
    "extract_items": extract_items,
    "benchmark_run": score_datasets,
    "stream_match": QUERIES["stream_match"],
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    item_lines = I.table(spark, sf, "lineitem").count()
    tables = spread_tables(spark, sf, int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    for name, fn in HEADLINE.items():
        if only and name not in only:
            continue
        start = time.time()
        drain(fn(spark, tables))
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    rates = {n: round(item_lines / s, 1) for n, s in times.items() if "items" in n}
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")),
        "lines_per_sec": rates}))


if __name__ == "__main__":
    main()
