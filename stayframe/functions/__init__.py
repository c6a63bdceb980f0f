"""Scalar column functions (pure Column -> Column builders, all JVM-side)."""

from stayframe.functions.time import (  # noqa: F401
    DAY_US, HOUR_US, age_years, delay_seconds, epoch_us, floor_days, hour_of, hours_between,
)
from stayframe.functions.recode import (  # noqa: F401
    binary_map, contains_any, dict_recode, keep_list, stringify_null, substring_recode,
    three_way_label, truncate_int,
)
