"""Sources and sinks (S01-S05, S07, P21) and driver-table stand-ins."""

from stayframe.sources.tables import (  # noqa: F401
    fixed_size_sample, load_feature_spec, read_csv, read_jdbc, read_table,
    to_timestamp_ntz, use_namespace, write_table,
)
