"""Queries with Python workers run from any working directory."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from kinetable.session import release, staged
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert entry.queries()["quality_state"](spark, {FOLDER!r}).count() > 0
kept = staged(spark.range(3))
assert kept.count() == 3 and release(spark) >= 1 and release(spark) == 0
print("fine")
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_workers_import_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
