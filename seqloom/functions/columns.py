"""Small column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_array(values: Iterable, kind: str = "int") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>")


def uniform(seed: Column | int | str, key: Column) -> Column:
    """A number in (0, 1) that depends on seed and key alone: 48 bits of an MD5.

    Task retries and partitioning cannot change it, unlike ``rand``.
    """
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def nan_to_null(value: Column) -> Column:
    """Missing numbers are null here; NaN would poison sums and sort as the largest value."""
    return F.when(~F.isnan(value), value)
