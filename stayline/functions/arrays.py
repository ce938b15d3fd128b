"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def spread(df: DataFrame, array: str | Column, name: str, *keep: str, pos: str | None = None) -> DataFrame:
    """The columns to keep and a row per element of ``array`` (NULL elements too) as ``name``, its place as ``pos``.

    For arrays that are costly to make. Of an inner explode the optimizer asks that the array is not empty; that test
    takes all expressions of the array along below the steps they were split into, so they run again, and what a step
    bound once is made anew for each use. An outer explode is left alone, and its row of an empty array has no place.
    """
    at = pos or "_at"
    x = df.select(*keep, F.posexplode_outer(array).alias(at, name)).where(F.col(at).isNotNull())
    return x if pos else x.drop(at)
