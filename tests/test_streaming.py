import tempfile

from pyspark.sql import functions as F


def test_run_on_new_files_profiles_each_batch(spark, sf_small):
    from tablelens.operators.agg import segment_rate
    from tablelens.streaming import run_on_new_files
    src = tempfile.mkdtemp(prefix="tl-src-")
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    li.where(F.col("l_linenumber") <= 3).write.mode("overwrite").parquet(f"{src}/part1")
    out, ckpt = tempfile.mkdtemp(prefix="tl-out-"), tempfile.mkdtemp(prefix="tl-ckpt-")
    q = run_on_new_files(spark, f"{src}/part1", li.schema,
                         lambda d: segment_rate(d, "l_returnflag", "l_linestatus", "F"), out, ckpt)
    q.awaitTermination(120)
    res = spark.read.parquet(out)
    assert res.count() == 3 and set(res.columns) == {"label", "value", "batch_id"}
