"""Column-level building blocks, all built-in JVM expressions."""

from barloom.functions.casts import day_from_text, lenient_double, nan_to_null, strict_double
from barloom.functions.codes import base_code, clean_code
from barloom.functions.days import compact_day, next_weekday, previous_weekday
from barloom.functions.prices import (
    broken_bar,
    filled_adj_close,
    inverse_multiplier,
    is_adjustment_event,
)

__all__ = [
    "base_code",
    "broken_bar",
    "clean_code",
    "compact_day",
    "day_from_text",
    "filled_adj_close",
    "inverse_multiplier",
    "is_adjustment_event",
    "lenient_double",
    "nan_to_null",
    "next_weekday",
    "previous_weekday",
    "strict_double",
]
