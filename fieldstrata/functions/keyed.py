"""Random numbers that depend on a seed and a row's id only, not on partitioning; SQL engines can compute the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int | str, *ids: Column | str) -> Column:
    """52 random bits as a long: the first 13 hex digits of md5(seed|id|...)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids])), 1, 13), 16, 10).cast("long")


def uniform(seed: int | str, *ids: Column | str) -> Column:
    """Uniform on [0, 1)."""
    return key(seed, *ids) / F.lit(float(1 << 52))
