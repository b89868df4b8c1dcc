"""Joins of a large, possibly skewed left side."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPLITTABLE = ("inner", "left", "left_semi", "left_anti")


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join a large left side, whose keys may be hot or null, to ``right``.

    No hint and no list of hot keys: adaptive execution broadcasts a right side that turns
    out to be under the session's threshold, and otherwise splits the left partitions that
    hot keys or nulls make large over several tasks, each with the partition's right rows.
    That covers any number of hot keys and holds for these join types only, so others are
    refused.
    """
    if how not in SPLITTABLE:
        raise ValueError(f"the left side of a {how!r} join cannot be split")
    return left.join(right, keys, how)
