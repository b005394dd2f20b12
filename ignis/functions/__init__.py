"""Column-level building blocks: every function returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen (no UDFs)."""

from ignis.functions.columns import (  # noqa: F401
    clip_lower, lenient_double, lenient_int, null_if_sentinel, safe_ratio,
)
from ignis.functions.dates import (  # noqa: F401
    day_of_week, day_of_year, doy_cos, doy_sin, safe_date, weekend_flag,
)
from ignis.functions.geo import EARTH_RADIUS_KM, haversine_km  # noqa: F401
