"""Boxes and composition as column arithmetic; integer truncation as in the stored results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    iw = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    ih = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = (iw * ih).cast("double")
    return inter / (aw * ah + bw * bh - inter + F.lit(1e-9))


def crop_rect(x: Column, y: Column, w: Column, h: Column, width: int, height: int, margin: float = 0.25) -> dict[str, Column]:
    """A square of the longer side plus margin around the centre, cut at the borders."""
    size = (F.greatest(w, h) * F.lit(1.0 + margin)).cast("int")
    x0 = F.greatest(F.lit(0), (x + w / F.lit(2.0) - size / F.lit(2.0)).cast("int"))
    y0 = F.greatest(F.lit(0), (y + h / F.lit(2.0) - size / F.lit(2.0)).cast("int"))
    return {"x0": x0, "y0": y0, "x1": F.least(F.lit(width), x0 + size), "y1": F.least(F.lit(height), y0 + size)}


def body_rect(x: Column, y: Column, w: Column, h: Column, width: int, height: int, wide: float = 1.8, high: float = 3.0) -> dict[str, Column]:
    """The face box grown to a body, kept inside by shifting."""
    nw, nh = F.greatest(F.lit(1.0), w * F.lit(wide)).cast("int"), F.greatest(F.lit(1.0), h * F.lit(high)).cast("int")
    y0 = F.greatest(F.lit(0.0), y - F.lit(0.3) * h).cast("int")
    x0 = F.greatest(F.lit(0), (x + w / F.lit(2.0) - nw / F.lit(2.0)).cast("int"))
    bottom, right = y0 + nh > height, x0 + nw > width
    y1, x1 = F.when(bottom, height).otherwise(y0 + nh), F.when(right, width).otherwise(x0 + nw)
    y0, x0 = F.when(bottom, F.greatest(F.lit(0), height - nh)).otherwise(y0), F.when(right, F.greatest(F.lit(0), width - nw)).otherwise(x0)
    return {"bx": x0, "by": y0, "bw": F.greatest(F.lit(1), x1 - x0), "bh": F.greatest(F.lit(1), y1 - y0)}


def padded_even(x: Column, y: Column, w: Column, h: Column, width: int, height: int, pad: float = 0.2) -> dict[str, Column]:
    """A box padded on all sides, cut at the borders, its size made even."""
    x0, y0 = F.greatest(F.lit(0), (x - w * F.lit(pad)).cast("int")), F.greatest(F.lit(0), (y - h * F.lit(pad)).cast("int"))
    x1, y1 = F.least(F.lit(width), (x + w * F.lit(1 + pad)).cast("int")), F.least(F.lit(height), (y + h * F.lit(1 + pad)).cast("int"))
    return {"px": x0, "py": y0, "pw": (x1 - x0) - (x1 - x0) % 2, "ph": (y1 - y0) - (y1 - y0) % 2}


def composition(sx: Column, sy: Column) -> dict[str, Column]:
    """Thirds, centre and edge scores of a subject's place, and their mean out of 100."""
    third = F.least(*[F.sqrt((sx - a / 3.0) * (sx - a / 3.0) + (sy - b / 3.0) * (sy - b / 3.0)) for a in (1.0, 2.0) for b in (1.0, 2.0)])
    thirds = _unit(1.0 - third / 0.25)
    centred = _unit(1.0 - (F.abs(sx - 0.5) + F.abs(sy - 0.5)) / 0.2)
    edge = _unit(F.least(sx, 1.0 - sx, sy, 1.0 - sy) / 0.1)
    return {"thirds": thirds, "centred": centred, "edge": edge, "composition_score": 100.0 * (((0.5 * thirds + 0.5 * centred) + edge) / 2.0)}


def face_size_score(area: Column, low: float = 0.05, high: float = 0.40) -> Column:
    return _unit(F.when(area <= 0, 0.0).when(area < low, area / low).when(area > high, F.greatest(F.lit(0.0), 1.0 - (area - high) / high)).otherwise(1.0))


def face_quality(conf: Column, area: Column) -> Column:
    return 100.0 * (0.6 * conf + 0.4 * face_size_score(area))


def tilt(dy: Column, dx: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))
