"""Large groups meet the one row of their group in parts."""

from pyspark.sql import functions as F

from loomline.operators import merging
from loomline.options import MinerOptions
from loomline.plans import mining
from loomline.session import stage


def test_a_large_group_meets_its_one_row_in_parts(spark, monkeypatch):
    monkeypatch.setattr(merging, "PART_ROWS", 20)
    rows = spark.createDataFrame(
        [("a" if i % 3 else None, f"w{i % 150}") for i in range(600)] + [("b", "x")], "g string, _packed string")
    one = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("c", 4)], "g string, name long")
    met = merging.match_groups(*merging.deal_groups(rows, one, ["g"], "_packed"), ["g", "_part"])
    got = met.groupBy("g", "name").count().collect()
    assert {(r["g"], r["name"], r["count"]) for r in got} == {("a", 1, 400), (None, 2, 200), ("b", 3, 1)}
    assert met.groupBy("g", "_part").count().agg(F.max("count")).first()[0] < 60


def test_members_of_one_block_are_not_one_task(spark, monkeypatch):
    """Lines of one block meet its leaders in many tasks, and fold to one template."""
    monkeypatch.setattr(merging, "PART_ROWS", 100, raising=False)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}
    for name, value in small.items():
        spark.conf.set(name, value)
    largest = []

    def kept(df, label="stage"):
        out = stage(df, label)
        if label == "members" and out.count() == 4000:
            largest.append(out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(mining, "stage", kept)
    try:
        lines = spark.createDataFrame(
            [(i, f"order {i} customer {i % 7} ok") for i in range(4000)], "line_id long, text string")
        mined = mining.mine_templates(lines, MinerOptions())
        assert [(r["tokens"], r["size"]) for r in mined.templates.collect()] == [
            (["order", "<*>", "customer", "<*>", "ok"], 4000)]
        assert largest and largest[0] < 2000
    finally:
        for name in small:
            spark.conf.unset(name)
