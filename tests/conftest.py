import functools
import os
import sys
import tempfile

import pytest

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomline.session import local_session  # noqa: E402


@functools.cache
def session():
    folder = tempfile.mkdtemp(prefix="loomline-tests-")
    made = local_session("tests", 8, spark__sql__shuffle__partitions="4",
                         spark__checkpoint__dir=f"file://{folder}",
                         spark__ui__showConsoleProgress="false")
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture
def spark():
    return session()


# Own lines: equal lines, several lengths, leading tokens that differ, singletons.
GOLDEN_LINES = """pump three started by operator anna
pump three started by operator anna
pump seven started by operator boris
valve three started by operator anna
valve nine closed by operator carla
backup finished in 12 minutes
backup finished in 47 minutes
backup aborted in 3 minutes
queue empty
queue full
cache empty
job 17 moved from rack a1 to rack b2
job 18 moved from rack a1 to rack c9
task 19 moved from rack d4 to rack b2
ready""".split("\n")

# Traced by hand at a threshold of 0.4: the pumps share 4 of 6 tokens, the valves 3,
# pumps and valves 2; jobs and the task share 5 of 9 once they meet by their ends.
GOLDEN_TEMPLATES = {
    ("pump <*> started by operator <*>", 3),
    ("valve <*> <*> by operator <*>", 2),
    ("backup <*> in <*> minutes", 3),
    ("queue <*>", 2),
    ("cache empty", 1),
    ("<*> <*> moved from rack <*> to rack <*>", 3),
    ("ready", 1),
}


@functools.cache
def golden_lines():
    rows = [(i, t) for i, t in enumerate(GOLDEN_LINES, 1)]
    return session().createDataFrame(rows, "line_id long, text string").cache()


@pytest.fixture
def golden(spark):
    return golden_lines()


def texts(df, column="tokens"):
    """{(template text, size)} of a catalog."""
    return {(" ".join(r[column]), r["size"]) for r in df.collect()}
