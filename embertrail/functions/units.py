"""Units and rounding that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binary byte units, and suffixes of memory settings with the bytes each stands for.
KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
SUFFIXES = {"b": 1, "k": KIB, "kb": KIB, "m": MIB, "mb": MIB, "g": GIB, "gb": GIB, "t": 1 << 40, "tb": 1 << 40, "p": 1 << 50, "pb": 1 << 50}
MS_PER_HOUR = 3_600_000


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards positive infinity."""
    m = 10**digits
    return F.floor(x * m + 0.5) / m if digits else F.floor(x + 0.5)


def byte_size(text: Column, default_unit: str = "b") -> Column:
    """Bytes of a setting such as 10MB, 1g or 384m; a bare number is in `default_unit`. Null if it is no size."""
    t = F.lower(F.trim(text))
    number, suffix = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$", 1), F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$", 2)
    unit = F.create_map(*[F.lit(x) for k, v in SUFFIXES.items() for x in (k, v)])
    size = F.try_element_at(unit, F.when(suffix == "", default_unit).otherwise(suffix))
    return F.when(number != "", F.floor(number.cast("double") * size)).cast("long")


