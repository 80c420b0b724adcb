"""Size checks before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No side is broadcast by hint above this many bytes.
BROADCAST_BYTES = 32 << 20


def planned_bytes(df: DataFrame) -> int:
    """Upper estimate of Catalyst for the frame, from file sizes and known row counts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return planned_bytes(df) <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Adds the broadcast hint only if the planner's size bound allows it;
    otherwise the join stays a shuffle join that adaptive execution may split."""
    return F.broadcast(df) if small(df, limit) else df
