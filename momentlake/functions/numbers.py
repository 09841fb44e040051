"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int) -> Column:
    """A double rounded in double arithmetic, as SQL engines and most languages do: times 10^digits, to the nearest whole
    number (halves away from zero), divided again.  Spark's round rounds the shortest decimal of the double instead, which
    is another number where the product is just beside a half."""
    scale = float(10**digits)
    return F.round((F.col(x) if isinstance(x, str) else x) * scale) / scale
