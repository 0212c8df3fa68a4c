"""Splits and samples that depend on a document's id only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def place(*key: Column) -> Column:
    """A fixed, evenly spread number in [0, 1) of a key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)
