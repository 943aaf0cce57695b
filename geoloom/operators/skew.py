"""Joins that no hot key can hold up.

A key with more than one part in HEAVY of all rows, and more than FEW rows, is heavy; there are fewer than HEAVY such keys,
whatever the data, so they may be listed, their side of the join may be broadcast, and their rows stay where they are. The
rest is joined by a shuffle, in which no key has more than one part in HEAVY of the rows, or FEW rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most heavy keys, and so most rows of what is broadcast.
HEAVY = 10_000
#: Rows of one key that a task takes without trouble.
FEW = 500


#: Rows of one or two numbers up to which a table is broadcast: some 100 MB.
SMALL_ROWS = 4_000_000


def few_rows(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written table of one or two numbers a row, with a broadcast hint if it has at most so many rows, which are counted."""
    return F.broadcast(table) if table.count() <= most else table


def is_heavy(times, total: int):
    """Whether so many rows of one key, of total rows, make it heavy; times: a column."""
    return times > max(total // HEAVY, FEW)


def heavy_keys(rows: DataFrame, key: str | list[str]) -> list[tuple]:
    """The heavy values of key in rows, fewer than HEAVY; they are counted with map-side combining."""
    names = [key] if isinstance(key, str) else list(key)
    counts = rows.groupBy(*names).agg(F.count("*").alias("_times")).where(F.col("_times") > FEW)
    most = counts.orderBy(F.desc("_times")).limit(HEAVY).collect()  # fewer than HEAVY rows
    if not most:
        return []
    total = rows.count()
    return [tuple(r[:-1]) for r in most if r["_times"] > total // HEAVY]


def join_by(rows: DataFrame, table: DataFrame, key: str | list[str], heavy: list[tuple] | None = None, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each value of key at most. how: inner, left or left_semi.

    heavy: the heavy values of key among rows where they are known; else they are counted. rows should be a written table,
    as it is read again. table's rows of heavy keys are broadcast: they must be of bounded width. Rows whose key is null meet
    nothing, as in any join.
    """
    names = [key] if isinstance(key, str) else list(key)
    if heavy is None:
        heavy = heavy_keys(rows, names)
    if not heavy:
        return rows.join(table, names, how)
    keys = F.broadcast(rows.sparkSession.createDataFrame(heavy, rows.select(*names).schema))
    hot, cold = rows.join(keys, names, "left_semi"), rows.join(keys, names, "left_anti")
    few = F.broadcast(table.join(keys, names, "left_semi"))
    return hot.join(few, names, how).unionByName(cold.join(table, names, how))
