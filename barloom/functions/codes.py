"""Security code helpers (PRJ15, JN4)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_LENGTH = 4


def clean_code(code: Column) -> Column:
    """The code without white space of any kind around it."""
    return F.regexp_replace(code.cast("string"), r"(?U)\A\s+|\s+\z", "")


def base_code(code: Column) -> Column:
    """The part of a code that does not depend on the share class."""
    return F.substring(code, 1, BASE_LENGTH)
