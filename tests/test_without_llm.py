"""The case queries stand without the operators for training data."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
from pyspark.sql import SparkSession

import __spark_entry__ as entry

assert {names} == [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
assert "k1_open_case_metrics" in entry.oracle_sql()
spark = (
    SparkSession.builder.master("local[2]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2")
    .config("spark.driver.memory", "1g")
    .getOrCreate()
)
assert entry.queries()["k5_latest_employees"](spark, "/root/testdata/sf0.001").count() > 0
"""


@pytest.mark.parametrize("gone", [("casemetrics/llm", "corpus_pipeline.py"), ("casemetrics/llm",)])
def test_a_copy_without_the_folders_imports_and_answers(tmp_path, gone):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", *(g for g in gone if "/" not in g))
    shutil.copytree(ROOT, copy, ignore=skip)
    assert not any((copy / g).exists() for g in gone)
    code = [sys.executable, "-c", RUN.format(names=[])]
    done = subprocess.run(code, cwd=copy, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-3000:]
