from .files import (  # noqa: F401
    collect_periods, collect_period_files, conform_table, lower_columns, read_many, read_partition, stage,
    write_partitioned,
)
