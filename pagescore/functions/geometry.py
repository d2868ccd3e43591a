"""Box expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: str, b: str) -> Column:
    """Intersection over union of boxes in columns {prefix}x0, y0, x1, y1; 0 without intersection; null if a side is null."""
    col = lambda side, name: F.col(f"{side}{name}")
    zero = F.lit(0.0)
    width = F.greatest(F.least(col(a, "x1"), col(b, "x1")) - F.greatest(col(a, "x0"), col(b, "x0")), zero)
    height = F.greatest(F.least(col(a, "y1"), col(b, "y1")) - F.greatest(col(a, "y0"), col(b, "y0")), zero)
    both = width * height
    area = lambda side: F.greatest(col(side, "x1") - col(side, "x0"), zero) * F.greatest(col(side, "y1") - col(side, "y0"), zero)
    union = area(a) + area(b) - both
    known = col(a, "x0").isNotNull() & col(b, "x0").isNotNull()
    return F.when(~known, F.lit(None).cast("double")).when((both <= 0) | (union <= 0), zero).otherwise(both / union)


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole as doubles, `empty` where whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / whole.cast("double"))
