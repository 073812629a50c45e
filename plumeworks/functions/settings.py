"""Clamping, coercion and overlay of configuration values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of true and false.
TRUTHY = ("1", "true", "yes", "on", "t", "y")
FALSEY = ("0", "false", "no", "off", "f", "n")


def clamp_float(value: Column, low: float, high: float, default: float) -> Column:
    """A string or number within bounds; the default for what is no number."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), v)))


def clamp_int(value: Column, low: int, high: int, default: int) -> Column:
    """Truncated toward zero; what is no finite number gives the default."""
    v = value.try_cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 9e15)
    return F.when(finite, F.greatest(F.lit(low), F.least(F.lit(high), F.when(finite, v).otherwise(F.lit(0.0)).cast("bigint")))).otherwise(F.lit(default))


def sensitivity_threshold(value: Column) -> Column:
    """A 0 to 100 slider as a mask threshold; null for junk."""
    v = value.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), 0.25 + F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)) / 100 * 0.5)


def coerce_bool(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*TRUTHY), True).when(v.isin(*FALSEY), False)


def normalise_formats(value: Column) -> Column:
    """A comma list as distinct lower-case tokens without dots, in order."""
    tokens = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"^\.+", ""))
    return F.array_distinct(F.filter(tokens, lambda x: x.rlike("^[a-z0-9]{2,5}$")))


def valid_config(low: Column, moderate: Column, size: Column) -> dict[str, Column]:
    """The pipeline's own wider limits: bands at least a hundredth apart, sides in steps of 32."""
    lo = F.greatest(F.lit(0.01), F.least(F.lit(0.98), low))
    return {"severity_low_max": lo, "severity_moderate_max": F.least(F.greatest(moderate, lo + 0.01), F.lit(0.99)), "input_size": F.greatest(F.lit(64), (F.floor(size / 32) * 32).cast("int"))}


#: Names of a run's frozen settings, and of the pipeline's options.
RENAMED = {"confidence_threshold": "conf_threshold", "smoke_mask_threshold": "mask_threshold", "frame_sample_rate": "frame_sample_rate", "max_video_seconds": "max_video_seconds", "severity_low_max": "severity_low_max", "severity_moderate_max": "severity_moderate_max"}


def pipeline_options(snapshot: Column) -> Column:
    """A map of frozen settings under the pipeline's names, without unknown keys and nulls."""
    names = F.create_map(*(F.lit(x) for pair in RENAMED.items() for x in pair))
    known = F.map_filter(snapshot, lambda k, v: F.map_contains_key(names, k) & v.isNotNull())
    return F.transform_keys(known, lambda k, _: F.element_at(names, k))
