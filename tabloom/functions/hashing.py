"""Reproducible draws from a business key.

``rand()`` depends on the partitioning and on recomputation; a digest of the key does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.columns import col


def key_text(key: Sequence[str]) -> Column:
    """The key columns joined by '|'."""
    return F.concat_ws("|", *[col(k).cast("string") for k in key])


def hex_number(digest: Column, start: int, length: int) -> Column:
    """A piece of a hexadecimal digest as a bigint (1-based start)."""
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def key_hash(key: Sequence[str], salt: str = "") -> Column:
    """An integer in [0, 2**32) fixed by the key."""
    text = key_text(key)
    if salt:
        text = F.concat(text, F.lit("#" + salt))
    return hex_number(F.md5(text), 1, 8)
