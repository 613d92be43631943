"""The entry in a session with Spark's own settings, as another program may begin it."""

from __future__ import annotations

import os
import subprocess
import sys

from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
PROGRAM = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
assert __spark_entry__.queries()["n01_normalize_whitespace"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_a_plain_session_will_do(tmp_path):
    env = {**os.environ, "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
