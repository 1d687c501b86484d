"""Positions on a consistent-hash ring, as 16 hex digits (they compare like unsigned 64-bit numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_id(name: Column | str, algo: str = "sha256") -> Column:
    name = (F.col(name) if isinstance(name, str) else name).cast("string")
    digest = {"sha256": F.sha2(name, 256), "sha1": F.sha1(name)}[algo]
    return F.substring(digest, 1, 16)


def ring_number(hex_id: Column | str) -> Column:
    """The ring id as DECIMAL(20,0), for display."""
    return F.conv(hex_id, 16, 10).cast("decimal(20,0)")
