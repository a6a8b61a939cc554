"""Shannon entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon_entropy(value: Column) -> Column:
    """Bits per character; 0 for an empty text, null for null."""
    n = F.length(value).cast("double")
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n
    total = F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda h, c: h - F.when(c == "", F.lit(0.0)).otherwise(share(c) * F.log2(share(c))))
    return F.when(value == "", F.lit(0.0)).otherwise(total)
