"""Incremental ingestion.

The reference has no stream operators (no watermarks, windows or state): its
"stream" is a server pushing events to a browser, and its chunked reader only
samples big files.  The one Spark-native counterpart kept here is running a
batch operator over files as they arrive, with Structured Streaming's
file source and ``foreachBatch`` — each micro-batch is an ordinary DataFrame,
so every operator in :mod:`tablelens.operators` applies unchanged, and the
checkpoint makes the run restartable after a failure.
"""

from tablelens.streaming.files import run_on_new_files  # noqa: F401
