import json
import os

from pyspark.sql import functions as F

from loomline.operators import evaluate as E
from loomline.plans.benchmark import Dataset, benchmark_run
from loomline.options import MinerOptions
from loomline.session import fresh_dir, stage, work_dir
from loomline.sources import lines as SL
from loomline.sources import tables as ST


def test_read_and_number(spark, tmp_path):
    for name, rows in (("b.log", [b"three  \n", b"fo\xffur\t\n"]), ("a.log", [b"one\n", b"\n"])):
        (tmp_path / name).write_bytes(b"".join(rows))
    lines = SL.number_file_lines(SL.read_lines(spark, str(tmp_path)))
    got = [(r["LineId"], r["text"]) for r in lines.orderBy("LineId").collect()]
    assert got == [(1, "one"), (2, ""), (3, "three"), (4, "four")]


def test_number_lines(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit("same").alias("day"))
    out = SL.number_lines(df.repartition(5), ["day", "k"])
    assert out.count() == 1000
    assert out.filter(F.col("LineId") != F.col("k") + 1).count() == 0


def test_strip_header(spark):
    rows = [("x PO-1 c d e f g",), ("x other c",), ("x fsp-2 a b c",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(SL.strip_header(F.col("t"))).collect()]
    assert got == ["f g", "x other c", "", ""]


FORMATS = [
    (r"<Date> <Time> <Pid> <Level> <Component>: <Content>", "081109 203615 148 INFO dfs.X: a b: c",
     ["081109", "203615", "148", "INFO", "dfs.X", "a b: c"]),
    (r"<Time>\|<Component>\|<Pid>\|<Content>", "t|c|3|msg | x", ["t", "c", "3", "msg | x"]),
    (r"\[<Time>\] \[<Level>\] <Content>", "[now then] [warn] it is", ["now then", "warn", "it is"]),
    (r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
     "Jun 14 15:16 combo sshd(x)[19]: fail", ["Jun", "14", "15:16", "combo", "sshd(x)", "19", "fail"]),
    (r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
     "Jun 14 15:16 combo su: fail", ["Jun", "14", "15:16", "combo", "su", "", "fail"]),
    (r"<Date> <Time>, <Level>                  <Component>    <Content>",
     "2016 04, Info   CBS  x", ["2016", "04", "Info", "CBS", "x"]),
]


def test_header_formats(spark):
    for log_format, line, want in FORMATS:
        df = spark.createDataFrame([(line,), ("nope",)], "text string")
        parsed, rejected = SL.parse_format(df, log_format)
        assert [list(r) for r in parsed.collect()] == [want]
        assert [r["text"] for r in rejected.collect()] == ["nope"]


def test_labels_round_trip(spark, tmp_path):
    rows = [(1, "E1", 'say "hi", <*>'), (2, "E2", "two\nlines")]
    path = str(tmp_path / "labels")
    ST.write_csv(spark.createDataFrame(rows, ST.LABEL_SCHEMA), path)
    assert sorted(tuple(r) for r in ST.read_labels(spark, path).collect()) == rows


def test_write_results(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, 'a "b"')], "dataset string, line_id long, text string")
    ST.write_results(df, str(tmp_path / "out"), partition_by=["dataset"])
    part = tmp_path / "out" / "dataset=d"
    files = [f for f in os.listdir(part) if f.endswith(".json")]
    assert json.loads((part / files[0]).read_text()) == {"line_id": 1, "text": 'a "b"'}
    record = df.select(ST.json_record("line_id").alias("j")).first()["j"]
    assert json.loads(record) == {"line_id": 1}


def test_work_dir_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert work_dir(spark) == configured.rstrip("/")
    first, second = fresh_dir(spark, "x"), fresh_dir(spark, "x")
    assert first != second and first.startswith(work_dir(spark))
    assert stage(spark.range(3)).count() == 3


def scored(spark, clusters, labels):
    grouped = spark.createDataFrame(list(enumerate(clusters)), "line_id int, cluster_id string")
    truth = spark.createDataFrame(list(enumerate(labels)), "line_id int, event_id string")
    return grouped, truth


def test_grouping_accuracy(spark):
    pair = scored(spark, "11233", "AABBC")
    row = E.grouping_accuracy(*pair).first()
    assert (row["lines"], row["exact_lines"], row["accuracy"]) == (5, 2, 0.4)
    errors = {(r["cluster_id"], r["event_id"], r["error"], r["missing"])
              for r in E.grouping_errors(*pair).collect()}
    assert errors == {("2", "B", "incomplete", 1), ("3", "B", "impure", 1), ("3", "C", "impure", 0)}
    assert [r["line_id"] for r in E.missing_lines(*pair, "2", "B").collect()] == [3]


def test_result_table(spark):
    text = ("Evaluation on Dataset: HDFS, Group Accuracy: 1.0000, Duration: 0.36 sec, "
            "Total of 2000 lines, rate 5606.6 lines/sec, 14 clusters")
    df = spark.createDataFrame([(text,), ("other",)], "text string")
    assert [tuple(r) for r in E.result_table(df).collect()] == [
        ("HDFS", 1.0, 0.36, 2000, 5606.6, 14)]


def test_benchmark_drops_lines_without_shifting_labels(spark):
    rows = [(1, "h: up 1", "A"), (2, "no header", "B"), (3, "h: up 2", "A"), (4, "h: down x y", "C")]
    lines = spark.createDataFrame(rows, "line_id long, text string, event_id string")
    scores, mined = benchmark_run(
        [Dataset("one", lines, "<Head>: <Content>", replace=[r"\d+"])], MinerOptions())
    row = scores.first()
    assert (row["lines"], row["accuracy"], row["clusters"]) == (3, 1.0, 2)
    assert mined.templates.count() == 2
