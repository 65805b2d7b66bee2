"""Admission figures of gray images: an image is an array of 0..255 in row order, all as native array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def luminance(gray: Column) -> Column:
    """Struct (mean, stddev) over all pixels, population deviation."""
    n = F.size(gray)
    mean, square = total(gray) / n, total(F.transform(gray, lambda x: x * x)) / n
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("stddev"))


def row_ink(gray: Column, width: int, height: int, below: Column) -> Column:
    """Share of pixels darker than `below` in each row."""
    return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.size(F.filter(F.slice(gray, r * width + 1, F.lit(width)), lambda x: x < below)) / width)


def text_bands(rows: Column) -> Column:
    """Runs of rows whose ink share lies between 0.03 and 0.6."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        inside = (x > 0.03) & (x < 0.6)
        return F.struct(inside.alias("inside"), (acc["n"] + (inside & ~acc["inside"]).cast("int")).alias("n"))

    return F.aggregate(rows, start, step, lambda acc: acc["n"])


def laplacian_variance(gray: Column, width: int, height: int) -> Column:
    """Variance of the four-neighbour Laplacian over inner pixels: low for blurred pages."""
    inner = [r * width + c + 1 for r in range(1, height - 1) for c in range(1, width - 1)]
    at = F.array(*map(F.lit, inner))
    values = F.transform(at, lambda i: F.get(gray, i) + F.get(gray, i - 2) + F.get(gray, i - 1 - width) + F.get(gray, i - 1 + width) - 4 * F.get(gray, i - 1))
    mean = total(values) / len(inner)
    return total(F.transform(values, lambda v: v * v)) / len(inner) - mean * mean


def likely_no_document(bands: Column, stddev: Column, ink: Column, has_quad: Column) -> Column:
    """No outline, fewer than two bands of text, and flat or nearly all or nothing inked."""
    return ~has_quad & (bands < 2) & ((stddev < 10) | (ink < 0.02) | (ink > 0.98))


#: Zone depths, largest deviation of a uniform zone, least difference of stacked zones, least contrast of a side bar.
DEPTH_A, DEPTH_B, UNIFORM, STACKED, CONTRAST = 0.18, 0.36, 32, 28, 20


def zones(gray: Column, width: int, height: int, edge: str) -> tuple[Column, Column]:
    """(mean, stddev) structs of the zone along an edge and of the next one inwards; the pixels are picked by fixed indexes."""
    across = width if edge in ("LEFT", "RIGHT") else height
    a, b = int(across * DEPTH_A + 0.5), int(across * DEPTH_B + 0.5)
    depth = {"TOP": lambda r, c: r, "BOTTOM": lambda r, c: height - 1 - r, "LEFT": lambda r, c: c, "RIGHT": lambda r, c: width - 1 - c}[edge]

    def stats(low: int, high: int) -> Column:
        picked = [r * width + c for r in range(height) for c in range(width) if low <= depth(r, c) < high]
        return luminance(F.transform(F.array(*map(F.lit, picked)), lambda i: F.get(gray, i)))

    return stats(0, a), stats(a, b)


def stacked(a: Column, b: Column) -> Column:
    """Two uniform zones of different shades."""
    return (a["stddev"] <= UNIFORM) & (b["stddev"] <= UNIFORM) & (F.abs(a["mean"] - b["mean"]) >= STACKED)


def side_bar(zone: Column, mean: Column) -> Column:
    """A uniform zone that stands out from the image."""
    return (zone["stddev"] <= UNIFORM) & (F.abs(zone["mean"] - mean) >= CONTRAST)


def outcome(likeness_negative: Column, screen_negative: Column, positive: Column) -> Column:
    """Cheap signals first: a confident negative rejects, a domain signal admits in full, else limited."""
    return F.when(likeness_negative | screen_negative, "REJECT").when(positive, "ADMIT_FULL").otherwise("ADMIT_LIMITED")


def clipping(gray: Column) -> Column:
    """Struct (highlight, shadow): shares of blown-out (250 and more) and black (5 and less) pixels."""
    share = lambda test: F.size(F.filter(gray, test)) / F.greatest(F.size(gray), F.lit(1))
    return F.struct(share(lambda x: x >= 250).alias("highlight"), share(lambda x: x <= 5).alias("shadow"))


def quality_codes(blur: Column, highlight: Column, mean: Column, stddev: Column, skew: Column, dpi: Column) -> Column:
    """Codes of a page's image quality (fixed values: blur 100, glare 0.08, darkness 60, contrast 25, skew 15 degrees, 150 dots an inch)."""
    return F.array_compact(F.array(
        F.when(blur < 100, "IMAGE_TOO_BLURRY"), F.when(highlight > 0.08, "GLARE_OBSCURES_FIELD"), F.when((mean < 60) | (stddev < 25), "POOR_CONTRAST"), F.when(F.abs(skew) > 15, "EXTREME_SKEW"), F.when(dpi < 150, "RESOLUTION_TOO_LOW"),
    ))
