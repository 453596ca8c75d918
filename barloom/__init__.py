"""barloom: daily price-bar analytics expressed as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; only ``sources``,
``sinks`` and ``plans.lake`` touch storage.
"""

from barloom.plans.lake import PriceLake
from barloom.plans.security import Security, search_securities

__all__ = ["PriceLake", "Security", "search_securities"]
