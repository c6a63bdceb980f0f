"""Profile a table: a repeatable fixed-size sample, then the column profile
and per-column frequency / histogram tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stayframe.operators import profile as PR
from stayframe.operators.clean import NUMERIC
from stayframe.sources.tables import fixed_size_sample


def explore(df: DataFrame, key_cols: list[str], sample_n: int | None = 5000, seed: int = 42,
            bins: int = 50) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Returns the profile (one row per column) and, per usable column, a
    histogram (numeric) or category counts / top-10 (other types)."""
    data = fixed_size_sample(df, sample_n, key_cols, seed) if sample_n else df
    data = data.checkpoint() if sample_n else data
    prof = PR.profile(data)
    verdicts = {r["column"]: r["verdict"] for r in prof.select("column", "verdict").collect()}
    types = {f.name: f.dataType for f in data.schema.fields}
    tables = {}
    for c, v in verdicts.items():
        if v != "ok":
            continue
        tables[c] = PR.histogram(data, c, bins) if isinstance(types[c], NUMERIC) else PR.category_counts(data, c)
    return prof, tables
