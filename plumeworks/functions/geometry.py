"""Boxes, regions of interest and coordinate maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the exhaust region: band height, side and downward margins, as shares.
BAND, SIDE, DOWN = 0.45, 0.30, 0.30


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of two box structs; 0 for missing fields, empty sides or no overlap."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = w * h
    fields = [s[c] for s in (a, b) for c in "xywh"]
    whole = fields[0].isNotNull()
    for f in fields[1:]:
        whole = whole & f.isNotNull()
    valid = whole & (a["w"] > 0) & (a["h"] > 0) & (b["w"] > 0) & (b["h"] > 0) & (w > 0) & (h > 0)
    return F.when(valid, inter / (a["w"] * a["h"] + b["w"] * b["h"] - inter)).otherwise(F.lit(0.0))


def exhaust_roi(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """The lower band of a vehicle, widened and lowered, inside the frame and at least one pixel."""
    band = F.greatest(F.lit(1), F.bround(h * BAND).cast("int"))
    top = y + h - band
    px, pd = F.bround(w * SIDE).cast("int"), F.bround(band * DOWN).cast("int")
    x0, y0 = F.greatest(F.lit(0), x - px), F.greatest(F.lit(0), top)
    x1, y1 = F.least(frame_w, x + w + px), F.least(frame_h, y + h + pd)
    x0, y0 = F.least(x0, frame_w - 1), F.least(y0, frame_h - 1)
    return box(x0, y0, F.greatest(x1, x0 + 1) - x0, F.greatest(y1, y0 + 1) - y0)


def clamp_crop(b: Column, frame_w: Column, frame_h: Column) -> Column:
    """A box cut to the frame, one pixel at least."""
    x0 = F.greatest(F.lit(0), F.least(b["x"], frame_w - 1))
    y0 = F.greatest(F.lit(0), F.least(b["y"], frame_h - 1))
    x1 = F.greatest(x0 + 1, F.least(b["x"] + b["w"], frame_w))
    y1 = F.greatest(y0 + 1, F.least(b["y"] + b["h"], frame_h))
    return box(x0, y0, x1 - x0, y1 - y0)


def letterbox(w: Column, h: Column, side: int = 256) -> Column:
    """Scale and padding that fit a frame into a square."""
    scale = F.least(side / w, side / h)
    new_w, new_h = (F.greatest(F.lit(1), F.bround(v * scale).cast("int")) for v in (w, h))
    return F.struct(scale.alias("scale"), F.floor((side - new_w) / 2).cast("int").alias("pad_x"), F.floor((side - new_h) / 2).cast("int").alias("pad_y"))


def unletterbox(x: Column, y: Column, fit: Column) -> Column:
    """A point of the square back in the frame; fit is what letterbox gave."""
    return F.struct(((x - fit["pad_x"]) / fit["scale"]).alias("x"), ((y - fit["pad_y"]) / fit["scale"]).alias("y"))


def map_box(b: Column, x0: Column, y0: Column, scale: Column) -> Column:
    """A source box in output coordinates."""
    return box((b["x"] - x0) * scale, (b["y"] - y0) * scale, b["w"] * scale, b["h"] * scale)


def smoothstep(t: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return c * c * (3 - 2 * c)
