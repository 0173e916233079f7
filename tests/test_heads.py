"""Bytes that header and sample reads take from large files, by Spark's event log."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.sources import files, heads, tables

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import sys
from granary.session import build_session
from granary.sources import files, tables
from pyspark.sql import functions as F

spark = build_session(
    "bytes", "local[2]", spark__eventLog__enabled="true", spark__eventLog__dir=f"file://{sys.argv[2]}",
    spark__eventLog__compress="false", spark__eventLog__rolling__enabled="false", spark__checkpoint__dir=sys.argv[3],
    spark__sql__files__maxPartitionBytes="4m", spark__sql__shuffle__partitions=2, spark__ui__showConsoleProgress="false",
)
spark.sparkContext.setLogLevel("ERROR")
headers = files.checked_headers(files.discover_files(spark, sys.argv[1]))
spark.sparkContext.setJobDescription("then the sample")
rows = tables.sample_files(spark, n=700, headers=headers, positions=True)
print({r["name"]: r["count"] for r in rows.groupBy(F.element_at(F.split("source", "/"), -1).alias("name")).count().collect()})
spark.sparkContext.setJobDescription("then the profile")
print(tables.row_size_profile(spark.read.text(f"{sys.argv[1]}/large.csv"), 700).first().asDict())
spark.stop()
"""


@pytest.fixture(scope="module")
def read(tmp_path_factory):
    """Printed lines, and bytes read from the files by step, over one file of 40 MB and three small ones."""
    root, log, shared = (tmp_path_factory.mktemp(name) for name in ("in", "log", "shared"))
    with open(root / "large.csv", "w") as f:
        f.write("a,b,Label\n")
        for i in range(800_000):
            f.write(f'{i},"two, words and more of them {i}",x\n')
    for name in "pqr":
        (root / f"{name}.csv").write_text("\n\na,c\n" + "1,2\n" * 5)
    done = subprocess.run([sys.executable, "-c", RUN, str(root), str(log), str(shared)], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    events = [json.loads(line) for line in next(log.iterdir()).open()]
    step, of_stage, total = "headers", {}, {}
    for e in events:
        if e["Event"] == "SparkListenerJobStart":
            step = (e.get("Properties") or {}).get("spark.job.description") or "headers"
            of_stage |= dict.fromkeys(e["Stage IDs"], step)
        if e["Event"] == "SparkListenerTaskEnd":
            took = (e.get("Task Metrics") or {}).get("Input Metrics", {}).get("Bytes Read", 0)
            total.setdefault(of_stage[e["Stage ID"]], []).append(took)
    return done.stdout.splitlines(), total, (root / "large.csv").stat().st_size


def test_headers_read_one_block_start_per_file(read):
    _, total, size = read
    assert size > 30_000_000 and sum(total["headers"]) < 400_000


def test_sample_reads_as_much_as_it_returns(read):
    lines, total, _ = read
    assert json.loads(lines[0].replace("'", '"')) == {"large.csv": 700, "p.csv": 5, "q.csv": 5, "r.csv": 5}
    assert sum(total["then the sample"]) < 1_000_000


def test_profile_reads_the_beginning(read):
    lines, total, _ = read
    assert "'sampled_rows': 700" in lines[1] and sum(total["then the profile"]) < 1_000_000


def test_first_rows_go_on_to_the_next_files(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"part {i:02d}+é.txt").write_text("".join(f"{i}-{k}\n" for k in range(3)))
    table = spark.read.text(str(tmp_path)).select(F.upper("value").alias("line"))
    want = [f"{i}-{k}" for i in range(12) for k in range(3)]
    for n in (0, 1, 3, 4, 20, 36, 50):
        assert sorted(r.line for r in heads.first_rows(table, n).collect()) == sorted(want[:n])
    assert heads.first_rows(spark.range(3), 2) is None


def test_settings_come_back(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\n1\n")
    before = dict(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.conf().getAll()))
    files.checked_headers(files.discover_files(spark, str(tmp_path)))
    tables.sample_files(spark, str(tmp_path), 1).collect()
    after = dict(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.conf().getAll()))
    assert before == after


def test_multi_line_and_quotes_in_samples(spark, tmp_path):
    rows = [f'{i},"quoted ""{i}"", and more"\n' for i in range(2000)]
    (tmp_path / "a.csv").write_text("\ufeffa,b\n" + "".join(rows))
    got = tables.sample_files(spark, str(tmp_path), 1500, positions=True).orderBy("_block", "_row").collect()
    assert [(r.a, r.b) for r in got] == [(str(i), f'quoted "{i}", and more') for i in range(1500)]
