"""Joins to groups of copies, of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HOT of all rows is hot; fewer than HOT keys can be.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row for each key and in ``n`` how many of ``total`` rows have it.

    Hot keys are fewer than ``HOT``, so their groups are broadcast and their rows stay where they are. Rows of other
    keys are shuffled, and none of these keys brings more than a ``HOT``-th of the rows to a task. Null keys have no group.
    """
    hot = groups.where(F.col(n) > total // HOT)
    cold = groups.where(F.col(n) <= total // HOT)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(cold, key))
