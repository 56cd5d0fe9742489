"""Box arithmetic. A box is ``(l, t, r, b)`` with pixel coordinates."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = namedtuple("Box", "l t r b")


def box(prefix: str = "") -> Box:
    """Columns ``<prefix>l`` ... ``<prefix>b`` as a :class:`Box`."""
    return Box(*[F.col(prefix + side) for side in "ltrb"])


def grow(bx: Box, by: int) -> Box:
    return Box(bx.l - by, bx.t - by, bx.r + by, bx.b + by)


def area(bx: Box) -> Column:
    return (bx.r - bx.l) * (bx.b - bx.t)


def point_in_box(bx: Box, x: Column, y: Column) -> Column:
    return (x >= bx.l) & (x <= bx.r) & (y >= bx.t) & (y <= bx.b)


def boxes_overlap(a: Box, b: Box) -> Column:
    """Closed intervals meet on both axes."""
    return (a.l <= b.r) & (b.l <= a.r) & (a.t <= b.b) & (b.t <= a.b)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.r, b.r) - F.greatest(a.l, b.l)
    h = F.least(a.b, b.b) - F.greatest(a.t, b.t)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def coverage(region: Box, bx: Box) -> Column:
    """Share of ``bx`` inside ``region``."""
    return F.when(area(bx) != 0, intersection(region, bx) / area(bx))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    return F.when(area(a) + area(b) - inter != 0, inter / (area(a) + area(b) - inter))


def letterbox(bx: Box, page_h: Column, page_w: Column, height: int, width: int, centre: bool = True) -> Box:
    """Map a box of a page into a ``height x width`` frame, aspect kept."""
    scale = F.least(F.lit(float(height)) / page_h, F.lit(float(width)) / page_w)
    new_h, new_w = F.floor(page_h * scale), F.floor(page_w * scale)
    pad_t = F.floor((height - new_h) / 2) if centre else F.lit(0)
    pad_l = F.floor((width - new_w) / 2) if centre else F.lit(0)
    return Box(bx.l * scale + pad_l, bx.t * scale + pad_t, bx.r * scale + pad_l, bx.b * scale + pad_t)


def cells_of(lo: Column, hi: Column, size: int) -> Column:
    """Grid indices a closed interval touches."""
    return F.sequence(F.floor(lo / size), F.floor(hi / size))
