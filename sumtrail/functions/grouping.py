"""Helpers for operators that run once per key of ``by`` (or once in all)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sumtrail.session import written


def window_by(by: Sequence[str]) -> WindowSpec:
    """Window over the keys; only for row sets whose size per key is bounded
    (months of a series, bins, ranked heads), never for raw rows."""
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def join_by(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach one row per key to ``left``; a NULL key is a key like any other.

    Without keys ``right`` is a single row (an ungrouped aggregate), which is
    the one case that is always small enough to broadcast. With keys the join
    strategy is left to the optimizer, which knows the measured sizes.
    """
    if not by:
        return left.crossJoin(F.broadcast(right))
    nullable = [c for c in by if left.schema[c].nullable and right.schema[c].nullable]
    if not nullable:
        return left.join(right, list(by), how)
    renamed = {c: f"_key_{c}" for c in by}
    other = right.withColumnsRenamed(renamed)
    match = F.lit(True)
    for c, key in renamed.items():
        same = left[c].eqNullSafe(other[key]) if c in nullable else left[c] == other[key]
        match = match & same
    return left.join(other, match, how).drop(*renamed.values())


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None,
             rank: str = "position") -> DataFrame:
    """First ``k`` rows per key in ``order``, numbered from 1; ``k=None`` numbers all.

    The rank filter is pushed into the sort before the exchange (window group
    limit), so each task ships at most ``k`` rows per key.
    """
    w = window_by(by).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w).cast("bigint"))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def share_of_total(df: DataFrame, value: str, by: Sequence[str], total: str = "total") -> DataFrame:
    """Add the per-key sum of ``value``.

    Aggregate and join rather than a window: the sum is combined map-side, so
    a key holding most of the rows never lands in one task. ``df`` is an
    aggregate over the source and is read twice, hence written once.
    """
    df = written(df)
    return join_by(df, df.groupBy(*by).agg(F.sum(value).alias(total)), by)
