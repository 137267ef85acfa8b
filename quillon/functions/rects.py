"""Areas, overlaps and distances of rectangles x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}" if side else name)


def area(side: str) -> Column:
    return (_c(side, "x2") - _c(side, "x1")) * (_c(side, "y2") - _c(side, "y1"))


def overlap(a: str, b: str) -> Column:
    x = F.least(_c(a, "x2"), _c(b, "x2")) - F.greatest(_c(a, "x1"), _c(b, "x1"))
    y = F.least(_c(a, "y2"), _c(b, "y2")) - F.greatest(_c(a, "y1"), _c(b, "y1"))
    return F.greatest(F.lit(0.0), x) * F.greatest(F.lit(0.0), y)


def iou(a: str, b: str) -> Column:
    shared = overlap(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def contained(a: str, b: str) -> Column:
    """Overlap over the smaller area."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, overlap(a, b) / smaller).otherwise(0.0)


_X = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1))"
_Y = "greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
SQL_OVERLAP = f"({_X} * {_Y})"
SQL_AREA = {s: f"(({s}.x2 - {s}.x1) * ({s}.y2 - {s}.y1))" for s in "ab"}
SQL_IOU = f"({SQL_OVERLAP} / ({SQL_AREA['a']} + {SQL_AREA['b']} - {SQL_OVERLAP}))"
SQL_CONTAINED = f"({SQL_OVERLAP} / least({SQL_AREA['a']}, {SQL_AREA['b']}))"
