"""Null-exact numeric helpers (missing stays NULL; NaN never leaks out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_double(c, dtype=None) -> Column:
    """``to_numeric(errors='coerce')``: unparsable text -> NULL, NaN -> NULL.

    ``try_cast`` turns ``'nan'`` into NaN, and NaN poisons ``sum``/``max``,
    so NaN is mapped to NULL as well.
    """
    col = _as_col(c)
    if dtype is not None and isinstance(dtype, NumericType):
        casted = col.cast("double")
    else:
        casted = col.try_cast("double") if dtype is None or isinstance(dtype, StringType) else col.cast("double")
    return F.nanvl(casted, F.lit(None).cast("double"))


def lenient_int(c, dtype=None) -> Column:
    """Lenient integer: goes through double (``'7.0'`` parses) and truncates."""
    d = lenient_double(c, dtype)
    return F.when(d.between(-2147483648.0, 2147483647.0), d.cast("int"))


def clip_lower(c, lower: float = 0.0) -> Column:
    """``clip(lower=0)`` keeping NULL as NULL (``greatest(NULL, 0)`` would give 0)."""
    col = _as_col(c)
    return F.when(col < F.lit(lower), F.lit(lower)).otherwise(col)


def safe_ratio(num, den) -> Column:
    """``num/den if den > 0 else 0`` without ANSI divide-by-zero errors."""
    n, d = _as_col(num), _as_col(den)
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def null_if_sentinel(c, sentinel: float = -999.0) -> Column:
    col = _as_col(c)
    return F.when(col == F.lit(sentinel), F.lit(None).cast("double")).otherwise(col)
