"""Time arithmetic (F01-F05). All computed in integer microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
SECONDS_PER_YEAR = 60.0 * 60.0 * 24.0 * 365.242


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(c) -> Column:
    """Microseconds since 1970-01-01 for TIMESTAMP or TIMESTAMP_NTZ input.

    For TIMESTAMP_NTZ the wall clock is read as UTC, independent of the session
    zone; TIMESTAMP input is cast to NTZ in the session zone first (keep the
    session zone at UTC, as Spark's defaults in this package do).
    """
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                           _col(c).cast("timestamp_ntz"))


def hours_between(start, end) -> Column:
    """EXTRACT(EPOCH FROM end - start) / 3600, fractional."""
    return (epoch_us(end) - epoch_us(start)) / F.lit(float(HOUR_US))


def delay_seconds(earlier, later) -> Column:
    """seconds from ``earlier`` to ``later``, fractional."""
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(1e6)


def age_years(birth, at) -> Column:
    """years of 365.242 days between ``birth`` and ``at``."""
    return (epoch_us(at) - epoch_us(birth)) / F.lit(1e6) / F.lit(SECONDS_PER_YEAR)


def hour_of(c) -> Column:
    """hour of the day (wall clock)."""
    return F.hour(_col(c))


def floor_days(delta_us) -> Column:
    """whole days of a microsecond difference, rounded toward -inf
    (a difference of -1 s is day -1, unlike EXTRACT(day ...))."""
    return F.floor(_col(delta_us) / F.lit(DAY_US)).cast("long")
