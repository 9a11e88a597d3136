"""tablelens — automated tabular analytics as Spark DataFrame operators.

Every operator is a plain function ``op(df, **params) -> DataFrame`` (or a fitted
``pyspark.ml`` model).  Nothing here collects data rows to the driver; operators
that need a statistic first run one aggregate job and embed the resulting
scalars as literals.
"""

from tablelens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
