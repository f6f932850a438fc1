"""Coordinates and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGNED = r"^([+-][0-9]+(?:\.[0-9]+)?)([+-][0-9]+(?:\.[0-9]+)?)([+-][0-9]+(?:\.[0-9]+)?)?"


def dms_to_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60.0 + s / 3600.0
    return F.coalesce(F.when(ref.isin("S", "W"), -value).otherwise(value), F.lit(0.0))


def iso6709(text: Column) -> Column:
    """``struct<lat, lon>`` of a location such as ``+35.6812+139.7671+040/``."""
    return F.struct(
        F.regexp_extract(text, _SIGNED, 1).try_cast("double").alias("lat"),
        F.regexp_extract(text, _SIGNED, 2).try_cast("double").alias("lon"),
    )


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes x1, y1, x2, y2; 0 if the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float, pad: float = 0.3) -> dict[str, Column]:
    """The box with ``pad`` of its sides around it, inside the picture, in whole pixels."""
    w, h = x2 - x1, y2 - y1
    floor = lambda c: F.floor(c).cast("int")
    return {
        "left": floor(F.greatest(F.lit(0.0), x1 - w * pad)),
        "top": floor(F.greatest(F.lit(0.0), y1 - h * pad)),
        "right": floor(F.least(F.lit(float(width)), x2 + w * pad)),
        "bottom": floor(F.least(F.lit(float(height)), y2 + h * pad)),
    }


def thumb_scale(width: Column, height: Column, side: float = 256.0) -> Column:
    return F.least(F.lit(side) / width, F.lit(side) / height)


def frame_positions(total: Column, n: int) -> Column:
    """``n`` evenly spaced frames of ``total``, none at the ends."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.floor(total * i / (n + 1)).cast("int"))
