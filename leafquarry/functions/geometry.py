"""Rectangles as structs (xmin, ymin, xmax, ymax) and page geometry, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("xmin", "ymin", "xmax", "ymax")


def rect(xmin, ymin, xmax, ymax) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(SIDES, (xmin, ymin, xmax, ymax), strict=True)])


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return rect(x, y, x + width, y + height)


def is_empty(r: Column) -> Column:
    return (r.xmin >= r.xmax) | (r.ymin >= r.ymax)


def contains_point(r: Column, x: Column, y: Column) -> Column:
    return (x >= r.xmin) & (x < r.xmax) & (y >= r.ymin) & (y < r.ymax)


def contains(outer: Column, inner: Column) -> Column:
    return (inner.xmin >= outer.xmin) & (inner.ymin >= outer.ymin) & (inner.xmax <= outer.xmax) & (inner.ymax <= outer.ymax)


def intersect(a: Column, b: Column) -> Column:
    """The common part; the empty rectangle at 0 where there is none."""
    r = rect(F.greatest(a.xmin, b.xmin), F.greatest(a.ymin, b.ymin), F.least(a.xmax, b.xmax), F.least(a.ymax, b.ymax))
    return F.when(is_empty(r), rect(*[F.lit(0).cast("int")] * 4)).otherwise(r)


def hull(a: Column, b: Column) -> Column:
    """The least rectangle around both; an empty one does not count."""
    both = rect(F.least(a.xmin, b.xmin), F.least(a.ymin, b.ymin), F.greatest(a.xmax, b.xmax), F.greatest(a.ymax, b.ymax))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def hull_of(r: Column) -> Column:
    """The hull of a group, as an aggregate."""
    return rect(F.min(r.xmin), F.min(r.ymin), F.max(r.xmax), F.max(r.ymax))


def inflate(r: Column, dx: int, dy: int) -> Column:
    return rect(r.xmin - dx, r.ymin - dy, r.xmax + dx, r.ymax + dy)


def translate(r: Column, dx: int, dy: int) -> Column:
    return rect(r.xmin + dx, r.ymin + dy, r.xmax + dx, r.ymax + dy)


def flip(y: Column, height: Column, page_height: Column) -> Column:
    """y of a box seen from the other horizontal edge of the page."""
    return page_height - y - height


def reduction(width: Column, height: Column, small_width: Column, small_height: Column) -> Column:
    """The least factor of 1 to 15 by which a layer is smaller than its page (sizes rounded up), else 16."""
    up = lambda a, k: F.floor((a + k - 1) / k)
    fits = F.filter(F.sequence(F.lit(1), F.lit(15)), lambda k: (up(width, k) == small_width) & (up(height, k) == small_height))
    return F.coalesce(F.array_min(fits), F.lit(16))


def legal_subsample(s: int) -> int:
    if not 1 <= s <= 12:
        raise ValueError("a subsample factor is 1 to 12")
    return s
