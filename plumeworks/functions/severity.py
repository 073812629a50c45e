"""Emission density, the gate on measurements, and severity bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the density score: weight and saturation of each part.
AREA_WEIGHT, AREA_FULL = 0.34, 0.35
OPACITY_WEIGHT, OPACITY_FLOOR = 0.28, 0.30
DARKNESS_WEIGHT = 0.18
EDGE_WEIGHT, EDGE_FULL = 0.12, 0.18
COMPACT_WEIGHT = 0.08
# Fixed values of the gate.
MIN_SIDE, MIN_AREA, MIN_BLOB_RATIO, MIN_BLOB_PIXELS, MIN_DENSITY = 12, 0.02, 0.018, 64, 0.15
#: Severities from least to worst.
SEVERITIES = ("low", "moderate", "high")


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def smoke_density(mask_pixels: Column, area: Column, opacity: Column, darkness: Column, edge: Column, compactness: Column) -> Column:
    """Weighted saturating score in [0, 1] at 6 places; 0 where the mask is empty."""
    score = (
        AREA_WEIGHT * F.least(area / AREA_FULL, F.lit(1.0))
        + OPACITY_WEIGHT * clip01((opacity - OPACITY_FLOOR) / (1 - OPACITY_FLOOR))
        + DARKNESS_WEIGHT * darkness
        + EDGE_WEIGHT * F.least(edge / EDGE_FULL, F.lit(1.0))
        + COMPACT_WEIGHT * compactness
    )
    return F.when(mask_pixels < 1, F.lit(0.0)).otherwise(F.round(clip01(score), 6))


def gate_reason(roi_w: Column, roi_h: Column, area: Column, blob_ratio: Column, blob_pixels: Column, density: Column) -> Column:
    """'smoke', 'no_smoke', or why nothing was measured."""
    smoke = (area >= MIN_AREA) & (blob_ratio >= MIN_BLOB_RATIO) & (blob_pixels >= MIN_BLOB_PIXELS) & (density >= MIN_DENSITY)
    return F.when(F.least(roi_w, roi_h) < MIN_SIDE, "roi_below_minimum_size").when(smoke, "smoke").otherwise("no_smoke")


def classify(density: Column, low_max: Column | float = 0.33, moderate_max: Column | float = 0.66) -> Column:
    """The pipeline's bands; a value on an edge belongs to the band above."""
    return F.when(density < low_max, "low").when(density < moderate_max, "moderate").otherwise("high")


def severity_for(value: Column, low_max: Column | float = 0.33, moderate_max: Column | float = 0.66) -> Column:
    """The stored bands; a value on an edge belongs to the band below, null counts as 0."""
    v = F.coalesce(value, F.lit(0.0))
    return F.when(v <= low_max, "low").when(v <= moderate_max, "moderate").otherwise("high")


def severity_rank(severity: Column) -> Column:
    """0, 1, 2 for low, moderate, high; -1 for anything else."""
    out = F.lit(-1)
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i).otherwise(out)
    return out


def severity_of_rank(rank: Column, none: Column | str = "") -> Column:
    out = F.lit(none) if isinstance(none, str) else none
    for i, name in enumerate(SEVERITIES):
        out = F.when(rank == i, name).otherwise(out)
    return out


def worst_of_counts(low: Column, moderate: Column, high: Column) -> Column:
    """The worst level that has a count, '' for none."""
    return F.when(high > 0, "high").when(moderate > 0, "moderate").when(low > 0, "low").otherwise("")
