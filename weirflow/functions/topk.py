"""The least k of a group, as an aggregate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql.internal import InternalFunction


def least_k(value: Column, k: int) -> Column:
    """The ``k`` least values of a group, ascending: a queue of ``k`` that tasks fill before the shuffle and that merges after."""
    return InternalFunction.collect_top_k(value, k, True)
