"""Repeatable pseudo-random numbers that another SQL engine can reproduce.

`rand()` depends on partitioning, so a retried task could draw other numbers.
These depend on the row's key and a seed only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 1152921504606846976.0  # 2 ** 60


def hash_int(*parts: Column | str | int, digits: int = 15) -> Column:
    """An unsigned number from the first hex digits of the md5 of the parts joined by a bar:
    60 bits, so that no row of any table is out of reach of a draw."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1)."""
    return hash_int(*parts) / F.lit(_RANGE)
