from tablelens.sources.io import (  # noqa: F401
    read_table, read_csv, read_parquet, read_json, source_row_count,
    proportional_sample, write_result,
)
