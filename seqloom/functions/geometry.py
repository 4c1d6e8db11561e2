"""Column functions on residue geometry. Points are structs (x, y, z) of doubles; missing is null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def distance(a: Column, b: Column) -> Column:
    square = [(a[k] - b[k]) * (a[k] - b[k]) for k in AXES]
    return F.sqrt(square[0] + square[1] + square[2])


def rounded_to_half(value: Column) -> Column:
    """A number that is not negative, rounded to what half precision can hold, ties to even; what is over
    its largest number is infinite."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(value, F.lit(2.0**-14)))), F.lit(-14)) - 10)
    near = F.rint(value / step) * step
    return F.when(near > 65504, F.lit(float("inf"))).otherwise(near)


def enforce_structure(coords: Column, plddt: Column, threshold: float = 70.0) -> Column:
    """struct<coords, plddt> under the rules for partly or doubtfully known residues.

    First, a residue with any number missing loses all of them and its plddt; then coordinates under
    the threshold go, while their plddt stays. A missing plddt never masks. ``coords`` is an array
    of numbers of one residue, missing ones null.
    """
    whole = ~F.exists(coords, lambda v: v.isNull())
    known = F.when(whole, plddt)
    return F.struct(F.when(whole & (known.isNull() | (known >= threshold)), coords).alias("coords"), known.alias("plddt"))


def value_and_flag(value: Column, scale: float = 1.0) -> Column:
    """struct<value, flag>: the scaled value or 0, and whether it was there."""
    return F.struct(F.coalesce(value / scale, F.lit(0.0)).alias("value"), value.isNotNull().cast("int").alias("flag"))


def pair_and_flag(first: Column, second: Column) -> Column:
    """Two values with one flag: any missing makes both 0."""
    both = first.isNotNull() & second.isNotNull()
    return F.struct(F.when(both, first).otherwise(0.0).alias("first"), F.when(both, second).otherwise(0.0).alias("second"), both.cast("int").alias("flag"))


def plane_normal(n: Column, ca: Column, c: Column) -> Column:
    """Unit vector of (N - CA) x (C - CA); null where the three points lie on a line."""
    a = {k: n[k] - ca[k] for k in AXES}
    b = {k: c[k] - ca[k] for k in AXES}
    x, y, z = a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]
    size = F.sqrt(x * x + y * y + z * z)
    return F.when(size > 0, point(x / size, y / size, z / size))


def distance_bucket(d: Column, buckets: int = 128, longest: float = 48.0, shortest: float = 2.5) -> Column:
    """Bucket of a distance: even steps from ``shortest`` to ``longest``, ends open."""
    step = (d - shortest) / (longest - shortest) * (buckets - 1)
    return F.least(F.greatest(step, F.lit(0.0)), F.lit(float(buckets - 1))).cast("int")


def angle_bucket(a: Column, b: Column, buckets: int = 128) -> Column:
    """Bucket of the signed angle between two unit vectors, even steps over the full circle."""
    cos = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]
    x, y, z = a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]
    sin = F.sqrt(x * x + y * y + z * z)
    angle = F.atan2(F.when(z >= 0, sin).otherwise(-sin), cos)
    full = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)
    return F.least(F.greatest(full / (2 * math.pi) * buckets, F.lit(0.0)).cast("int"), F.lit(buckets - 1))


def pair_bucket(distance_b: Column | None, angle_b: Column | None, known: Column, confidence_a: Column, confidence_b: Column, n_distance: int = 128, n_angle: int = 128, threshold: float = 0.7) -> Column:
    """Joint bucket of a residue pair.

    Pairs with missing coordinates have a bucket of their own, and so have other pairs with low
    confidence on either side; confidence is plddt/100, and 0 where there is none.
    """
    if distance_b is not None and angle_b is not None:
        own, total = distance_b * n_angle + angle_b, n_distance * n_angle
    elif distance_b is not None:
        own, total = distance_b, n_distance
    else:
        own, total = angle_b, n_angle
    low = (F.coalesce(confidence_a, F.lit(0.0)) < threshold) | (F.coalesce(confidence_b, F.lit(0.0)) < threshold)
    return F.when(~known, F.lit(total)).when(low, F.lit(total + 1)).otherwise(own)
