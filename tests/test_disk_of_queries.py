"""What queries leave on the disks while they go on."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.queries import comparing, matching
from loomline.session import stage


@pytest.fixture
def documents(spark, tmp_path):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choice("red blue door opens of 7".split()) for _ in range(rng.randint(0, 5)))
                       for _ in range(4)) for _ in range(40)]
    spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").write.parquet(
        f"file://{tmp_path}/documents.parquet")
    return f"file://{tmp_path}"


def test_each_strategy_is_written_before_the_next(spark, documents, monkeypatch):
    steps = []

    def kept(df, label="stage"):
        steps.append(label)
        return stage(df, label)

    monkeypatch.setattr(matching, "stage", kept)
    monkeypatch.setattr(matching, "drop_shuffles", lambda spark: steps.append("dropped"), raising=False)
    counted = {r["strategy"]: r["count"] for r in matching.match_lines(spark, documents).groupBy("strategy").count().collect()}
    assert steps[2:] == ["dropped", "matched"] * 3
    assert counted["always"] == counted["fallback"] >= counted["never"] > 0


@pytest.mark.parametrize("name", ["pos_veto", "dictionary_veto"])
def test_vetoes_keep_the_tagged_shapes_only(spark, documents, monkeypatch, name):
    written = {}

    def kept(df, label="stage"):
        written[label] = stage(df, label)
        return written[label]

    monkeypatch.setattr(comparing, "stage", kept)
    found = getattr(comparing, name)(spark, documents)

    def exists(label):
        path = spark._jvm.org.apache.hadoop.fs.Path(written[label]._staged_at)
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    assert [label for label in written if exists(label)] == ["tagged"]
    assert found.count() == found.select(F.col("shape_id")).distinct().count() > 50


def test_spoken_lines_are_folded_before_the_last_join(spark, documents, monkeypatch):
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(["red door of", "red blue of\nopens", "", None])],
                          "conv_id long, turn int, role string, text string").write.parquet(f"{documents}/conversations.parquet")
    steps = []

    def kept(df, label="stage"):
        steps.append(label)
        return stage(df, label)

    monkeypatch.setattr(comparing, "stage", kept)
    monkeypatch.setattr(comparing, "drop_shuffles", lambda spark: steps.append("dropped"))
    found = comparing.seen_token_similarity(spark, documents)
    assert steps == ["shapes", "templates", "dropped", "seen", "shapes", "dropped"]
    assert found.count() == found.select("shape_id").distinct().count() > 5
