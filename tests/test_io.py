import os
import tempfile

from pyspark.sql import functions as F

from tablelens.sources import io


def test_csv_json_roundtrip_and_counts(spark, sf_small):
    src = spark.read.parquet(f"{sf_small}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    d = tempfile.mkdtemp(prefix="tl-io-")
    io.write_result(src, os.path.join(d, "csv"), "csv")
    io.write_result(src, os.path.join(d, "json"), "json")
    io.write_result(src, os.path.join(d, "pq"), "parquet")
    n = src.count()
    csv = io.read_csv(spark, os.path.join(d, "csv"))
    assert csv.count() == n and dict(csv.dtypes)["o_totalprice"] == "double"
    assert io.read_json(spark, os.path.join(d, "json")).count() == n
    assert io.read_table(spark, os.path.join(d, "pq"), "parquet").count() == n
    lines = spark.read.text(os.path.join(d, "csv"))
    header_rows = lines.where(F.col("value").startswith("o_orderkey")).count()
    assert io.source_row_count(spark, os.path.join(d, "csv"), "csv").first()["rows"] == lines.count() - 1
    assert header_rows >= 1


def test_json_array_document(spark):
    d = tempfile.mkdtemp(prefix="tl-json-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    assert io.read_json(spark, d, array_document=True).count() == 2


def test_proportional_sample_is_deterministic(spark, sf_small):
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    a = io.proportional_sample(li, 0.3, ["l_orderkey", "l_linenumber"]).collect()
    b = io.proportional_sample(li, 0.3, ["l_orderkey", "l_linenumber"]).collect()
    assert a == b and 0.2 * li.count() < len(a) < 0.4 * li.count()
