"""The driver imports __spark_entry__ from another directory with its own plain
session: Python workers must still import the package (pandas UDFs)."""

import subprocess
import sys

SCRIPT = r"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
assert E.entry(spark).count() == 11
assert E.queries()["mean_ci"](spark, "/root/testdata/sf0.001").count() == 3
assert E.queries()["keyword_topk"](spark, "/root/testdata/sf0.001").count() > 0
print("OK")
"""


def test_queries_run_from_foreign_cwd(tmp_path):
    import os
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, capture_output=True,
                         text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-2000:]
