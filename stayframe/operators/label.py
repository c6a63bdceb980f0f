"""Label stage (P12, P13, W01-W03, F04-F07): night anchors, day-offset
values and the three-class trend label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.functions.recode import three_way_label
from stayframe.functions.time import hour_of
from stayframe.operators.asof import DEFAULT_HOT_ROWS
from stayframe.operators.offsets import DAY_FRAMES, DEFAULT_BUCKET_US, range_max


def hour_filter(df: DataFrame, time_col: str, first: int = 0, last: int = 5) -> DataFrame:
    """Keep rows whose hour of day is in [first, last] (05:59:59 kept)."""
    return df.where(hour_of(time_col).between(first, last))


def day_offsets(df: DataFrame, stay: str, time_col: str, value_col: str, row_id: list[str],
                bucket_us: int = DEFAULT_BUCKET_US, hot_rows: int | None = DEFAULT_HOT_ROWS,
                materialize: bool = True) -> DataFrame:
    """W01-W03 + A04: max value of the same stay on the next day, the previous
    day and the day before (whole days by floor of the difference)."""
    return range_max(df, [stay], time_col, value_col, row_id, DAY_FRAMES, bucket_us, prefix=f"{value_col}_",
                     materialize=materialize, hot_rows=hot_rows)


def add_labels(df: DataFrame, stay: str = "icustay_id", time_col: str = "creatinine_time",
               value_col: str = "creatinine", band: float = 0.15, hours: tuple[int, int] = (0, 5),
               drop_unlabelled: bool = True, drop_work_columns: bool = True,
               bucket_us: int = DEFAULT_BUCKET_US, hot_rows: int | None = DEFAULT_HOT_ROWS,
               materialize: bool = True) -> DataFrame:
    """Night filter, next/previous day values, ``label`` and (P13) the drop of
    unlabelled rows. Output keeps ``<v>_yesterday`` and ``<v>_before_yesterday``."""
    night = hour_filter(df, time_col, *hours)
    off = day_offsets(night, stay, time_col, value_col, [stay, time_col], bucket_us, hot_rows, materialize)
    diff = F.col(f"{value_col}_tomorrow") - F.col(value_col)                  # F07
    out = off.withColumn("label", three_way_label(diff, band))                # F06
    if drop_unlabelled:
        out = out.dropna(subset=["label"])
    if drop_work_columns:
        out = out.drop(time_col, f"{value_col}_tomorrow")
    return out
