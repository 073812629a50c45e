"""Masks and images inside tables: labelling, edges, plume features, the darkness balance of a dataset.

Images are arrays of grey levels, row by row, with their width beside them. Rows of
one shape are stacked and go through NumPy together, an Arrow batch at a time.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edge thresholds, the mask's own, and the luminance below which a pixel is dark.
EDGE_LOW, EDGE_HIGH, BINARISE_AT, DARK = 50, 140, 0.5, 80
# Fixed values of a shadow-like region: how much darker than its surroundings it is.
SHADOW_STEP = 25.0
# Weights of blue, green and red in 15-bit fixed point.
GREY_WEIGHTS = (3735, 19235, 9798)
# The fields of a plume's features.
FEATURES = ("area_ratio", "mean_opacity", "edge_density", "darkness", "compactness", "largest_blob_ratio", "largest_blob_pixels", "mask_pixels", "roi_pixels")
#: tan 22.5 degrees in 15-bit fixed point.
TAN = round((2**0.5 - 1) * (1 << 15))


def grey(bgr: np.ndarray) -> np.ndarray:
    """Luminance of images whose last axis is blue, green, red; alpha behind them is ignored."""
    return ((bgr[..., :3].astype(np.int64) @ np.array(GREY_WEIGHTS) + (1 << 14)) >> 15).astype(np.uint8)


def least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's group, where a and b list links between 0 and n - 1."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(again := least[least], least):
            least = again
    return least


def labelled(on: np.ndarray) -> np.ndarray:
    """8-connected components of a mask, numbered from 1 in the order of their first pixels; 0 outside.

    Pixels are taken as runs along rows, and runs that touch in neighbouring rows are joined.
    """
    height, width = on.shape
    steps = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(steps == 1)
    _, end = np.nonzero(steps == -1)  # exclusive; runs of a row begin and end in the same order
    span = width + 2
    starts, ends = row * span + start, row * span + end
    low = np.searchsorted(ends, starts - span, "left")
    high = np.searchsorted(starts, ends - span, "right")
    counts = np.maximum(high - low, 0)
    below = np.repeat(np.arange(len(row)), counts)
    above = np.arange(len(below)) - np.repeat(counts.cumsum() - counts, counts) + np.repeat(low, counts)
    number = np.unique(least_joined(len(row), below, above), return_inverse=True)[1] + 1
    out = np.zeros((height, width + 1), np.int64)
    out[row, start] = number
    out[row, end] -= number
    return out.cumsum(1)[:, :width]


def canny(images: np.ndarray, low: int = EDGE_LOW, high: int = EDGE_HIGH) -> np.ndarray:
    """Edges of stacked grey images: Sobel gradients, thinned across the edge, weak ones kept where they touch strong ones."""
    n, height, width = images.shape
    p = np.pad(images.astype(np.int64), ((0, 0), (1, 1), (1, 1)), mode="edge")
    down = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    across = p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]
    dx, dy = down[:, :, 2:] - down[:, :, :-2], across[:, 2:] - across[:, :-2]
    ax, ay = np.abs(dx), np.abs(dy)
    size = ax + ay
    around = np.pad(size, ((0, 0), (1, 1), (1, 1)))
    at = lambda r, c: around[:, 1 + r : 1 + r + height, 1 + c : 1 + c + width]
    flat = (ay << 15) < ax * TAN
    steep = (ay << 15) > ax * TAN + (ax << 16)
    rising = (dx < 0) != (dy < 0)
    slant = np.where(rising, (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))
    thin = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), slant))
    weak = thin & (size > low)
    # an empty row between images keeps them apart
    label = labelled(np.pad(weak, ((0, 0), (0, 1), (0, 0))).reshape(n * (height + 1), width)).reshape(n, height + 1, width)[:, :height]
    strong = np.zeros(int(label.max(initial=0)) + 1, bool)
    strong[label[weak & (size > high)]] = True
    strong[0] = False
    return strong[label]


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, by the centres of pixels."""

    def places(n: int, m: int):
        x = np.clip((np.arange(m) + 0.5) * (n / m) - 0.5, 0, n - 1)
        low = np.minimum(x.astype(np.int64), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), (x - low).astype(np.float32)

    top, bottom, v = places(image.shape[0], height)
    left, right, h = places(image.shape[1], width)
    rows = image[top] * (1 - v)[:, None] + image[bottom] * v[:, None]
    return rows[:, left] * (1 - h) + rows[:, right] * h


def probabilities(mask: np.ndarray) -> np.ndarray:
    """Mask values within 0 and 1; masks beyond 1 are taken as levels up to 255, what is no number as 0."""
    x = np.nan_to_num(mask.astype(np.float32), nan=0.0)
    return np.clip(x / np.float32(255) if x.size and x.max() > 1 + 1e-6 else x, 0, 1)


def features(masks: np.ndarray, images: np.ndarray, binarise_at: float = BINARISE_AT) -> np.ndarray:
    """The fields of FEATURES, a row for each of the stacked masks and grey images of one shape."""
    from .evaluation import largest_component

    n, height, width = images.shape
    on = masks >= binarise_at
    edges = canny(images) & on
    out = np.zeros((n, len(FEATURES)))
    out[:, 8] = roi = height * width
    for i in np.flatnonzero(on.any((1, 2))):
        pixels = int(on[i].sum())
        blob, compact = largest_component(on[i])
        values = (pixels / roi, float(masks[i][on[i]].mean()), edges[i].sum() / pixels, 1 - float(images[i][on[i]].mean()) / 255, compact, blob / roi)
        out[i, :6] = np.round(np.clip(values, 0, 1), 6)
        out[i, 6:8] = blob, pixels
    return out


def _shaped(values: pa.Array, widths: pa.Array) -> list[np.ndarray | None]:
    """Images as two-dimensional arrays, None where an array doesn't fill its rows or has a null."""
    out = []
    for v, w in zip(values, widths.to_pylist(), strict=True):
        x = v.values if v.is_valid else None
        whole = x is not None and w is not None and w > 0 and len(x) and len(x) % w == 0 and not x.null_count
        out.append(x.to_numpy(zero_copy_only=False).reshape(-1, w) if whole else None)
    return out


def _featured(batches, binarise_at: float):
    for batch in batches:
        masks, images = (_shaped(batch.column(c), batch.column(f"{c}_width")) for c in ("mask", "image"))
        found = np.zeros((batch.num_rows, len(FEATURES)))
        by: dict[tuple[int, int], list[int]] = {}
        for i, (m, g) in enumerate(zip(masks, images, strict=True)):
            if m is not None and g is not None:
                by.setdefault(g.shape, []).append(i)
        for (height, width), rows in by.items():
            fit = [p if p.shape == (height, width) else resized(p, height, width) for p in (probabilities(masks[i]) for i in rows)]
            levels = np.stack([np.nan_to_num(images[i].astype(np.float64), nan=0.0).clip(0, 255).astype(np.uint8) for i in rows])
            found[rows] = features(np.stack(fit), levels, binarise_at)
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(found[:, k]) for k in range(len(FEATURES)))], ["key", *FEATURES])


def plume_features(rows: DataFrame, key: str, mask: Column, mask_width: Column, image: Column, image_width: Column, binarise_at: float = BINARISE_AT) -> DataFrame:
    """Features of each mask over its grey image; a mask of another size is resized to the image.

    Masks and images that are null, empty or don't fill their rows have zeros throughout, masks without
    a pixel all zeros but the image's size.
    """
    kind = rows.schema[key].dataType.simpleString()
    given = rows.select(F.col(key).alias("key"), mask.cast("array<double>").alias("mask"), mask_width.cast("int").alias("mask_width"), image.cast("array<double>").alias("image"), image_width.cast("int").alias("image_width"))
    return given.mapInArrow(partial(_featured, binarise_at=binarise_at), f"key {kind}, " + ", ".join(f"{f} double" for f in FEATURES)).withColumnRenamed("key", key)


def pixel_counts(image: Column, inside: Column) -> Column:
    """Counts and sums of an image's pixels by a mask of booleans: one struct, from one pass over both arrays."""
    zero = F.lit(0).cast("long")
    names = ("dark_smoke", "dark_ground", "smoke", "pixels", "sum_in", "sum_out")
    start = F.struct(*(zero.alias(n) for n in names))
    pairs = F.zip_with(image, inside, lambda g, m: F.struct(g.cast("long").alias("g"), F.coalesce(m, F.lit(False)).alias("m")))

    def step(a: Column, x: Column) -> Column:
        g, m = x["g"], x["m"]
        more = (m & (g < DARK), ~m & (g < DARK), m, g.isNotNull())
        counts = [(a[n] + F.when(c, 1).otherwise(0)).alias(n) for n, c in zip(names, more, strict=False)]
        return F.struct(*counts, (a["sum_in"] + F.when(m, g).otherwise(0)).alias("sum_in"), (a["sum_out"] + F.when(m, 0).otherwise(g)).alias("sum_out"))

    return F.aggregate(pairs, start, step)


def _with_pixels(samples: DataFrame) -> DataFrame:
    rows = samples.withColumn("px", pixel_counts(F.col("image"), F.col("inside")))
    p = {n: F.col(f"px.{n}") for n in ("smoke", "pixels", "sum_in", "sum_out")}
    both = (p["smoke"] > 0) & (p["pixels"] > p["smoke"])
    mean_in, mean_out = p["sum_in"] / F.when(both, p["smoke"]), p["sum_out"] / F.when(both, p["pixels"] - p["smoke"])
    positive = F.col("label") == "positive"
    return rows.withColumns({"positive": positive, "shadowlike": F.coalesce(positive & (mean_in < DARK) & (mean_in - mean_out < -SHADOW_STEP), F.lit(False))})


def dataset_balance(samples: DataFrame) -> DataFrame:
    """For each split and over all: labels, coverage, and what the darkness of a pixel says about smoke.

    samples: split, label, coverage, on_cast_shadow, image (grey levels), inside (booleans). One scan and
    one shuffle of sums, by grouping sets.
    """
    rows = _with_pixels(samples)
    got = rows.groupingSets([["split"], []], "split").agg(
        F.count("*").alias("n"), F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("negative"),
        F.round(F.coalesce(F.avg(F.when(F.col("positive"), F.coalesce("coverage", F.lit(0.0)))), F.lit(0.0)), 5).alias("mean_positive_coverage"),
        F.count_if(F.col("positive") & F.coalesce("on_cast_shadow", F.lit(False))).alias("positives_on_cast_shadow"), F.count_if("shadowlike").alias("shadowlike_positives"),
        *(F.sum(f"px.{c}").alias(c) for c in ("dark_smoke", "dark_ground", "smoke", "pixels")),
    )
    least = lambda c, v: F.greatest(c, F.lit(v))
    base = F.col("smoke") / least(F.col("pixels"), 1)
    given = F.col("dark_smoke") / least(F.col("dark_smoke") + F.col("dark_ground"), 1)
    return got.select(
        F.coalesce("split", F.lit("all")).alias("split"), "n", "positive", "negative", "mean_positive_coverage", "positives_on_cast_shadow",
        F.round(base, 6).alias("p_smoke"), F.round(given, 6).alias("p_smoke_given_dark"), F.round(given / least(base, 1e-9), 4).alias("lift"),
        "shadowlike_positives", F.round(F.col("shadowlike_positives") / least(F.col("positive"), 1), 4).alias("shadowlike_positive_fraction"),
        F.round(F.col("dark_ground") / least(F.col("dark_smoke"), 1), 3).alias("dark_background_px_per_dark_smoke_px"),
    )


def dataset_groups(samples: DataFrame) -> DataFrame:
    """Samples by split and one of source, kind of a negative, colour of a positive; `?` where it isn't known."""
    negative = F.col("label") != "positive"
    known = lambda c: F.coalesce(c, F.lit("?"))
    entries = F.array(
        F.struct(F.lit("source").alias("dimension"), known(F.col("source")).alias("value")),
        F.struct(F.when(negative, "negative_kind").otherwise("smoke_colour").alias("dimension"), F.when(negative, known(F.col("negative_kind"))).otherwise(known(F.col("smoke_colour"))).alias("value")),
    )
    rows = samples.select("split", F.explode(entries).alias("e"))
    return rows.groupBy("split", "e.dimension", "e.value").agg(F.count("*").alias("n"))
