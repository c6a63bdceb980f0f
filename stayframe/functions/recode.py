"""Label and text recodes."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def three_way_label(diff, band: float) -> Column:
    """diff > band -> 0 (increase); diff < -band -> 1 (decrease);
    NULL -> NULL; otherwise 2 (stable)."""
    d = _col(diff)
    return (F.when(d.isNull(), F.lit(None).cast("int"))
            .when(d > band, F.lit(0))
            .when(d < -band, F.lit(1))
            .otherwise(F.lit(2)))


def contains_any(c, needles: list[str]) -> Column:
    """literal, case-sensitive substring test against any needle."""
    return reduce(lambda a, b: a | b, [_col(c).contains(n) for n in needles])


def substring_recode(c, rules: list[tuple[list[str], str]]) -> Column:
    """replace the whole text by the target of the first rule whose
    needles occur in it; otherwise keep the text."""
    out = None
    for needles, target in rules:
        cond = contains_any(c, needles)
        out = F.when(cond, F.lit(target)) if out is None else out.when(cond, F.lit(target))
    return out.otherwise(_col(c)) if out is not None else _col(c)


def keep_list(c, keep: list[str], other: str = "OTHER") -> Column:
    """values outside ``keep`` (NULL included) become ``other``."""
    return F.when(_col(c).isin(keep), _col(c)).otherwise(F.lit(other))


def dict_recode(c, mapping: dict) -> Column:
    """map lookup; keys absent from the map give NULL."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(m, _col(c))


def binary_map(c, mapping: dict) -> Column:
    """two-value map (e.g. F -> 1, M -> 0), anything else NULL."""
    out = None
    for k, v in mapping.items():
        out = F.when(_col(c) == k, F.lit(v)) if out is None else out.when(_col(c) == k, F.lit(v))
    return out


def truncate_int(c) -> Column:
    """truncate toward zero."""
    return _col(c).cast("long")


def stringify_null(c, text: str = "nan") -> Column:
    """F16: text form where NULL becomes the literal ``text``."""
    return F.coalesce(_col(c).cast("string"), F.lit(text))
