"""provisio — non-life technical provisions (PE, PREC, PA, CU, SAP, IBNR, PSAP) on Spark.

Every operator is a ``DataFrame (+ parameters) -> DataFrame`` function built
from the public DataFrame API.  Big inputs (policy rows, claim rows) are only
ever touched by projections, filters, map-literal lookups and one partial
(map-side combined) aggregation on the (Branche, Exercice) key; everything
after that works on per-cell aggregates whose size is bounded by
#branches x #years.
"""

from provisio.params import ReservingParams  # noqa: F401

__all__ = ["ReservingParams"]
