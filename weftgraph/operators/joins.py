"""A join that gives no task all rows of a frequent key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows goes by broadcast, so at most total / HOT_ROWS keys do; HOT_KEYS bounds them at any size.
HOT_ROWS, HOT_KEYS = 10_000, 500_000


def spread_join(big: DataFrame, table: DataFrame, key: list[str], rows: str, total: int | None = None) -> DataFrame:
    """Inner join of big with `table` (one row per key; `rows` is how many rows of big have it), without `rows`.

    Keys with over HOT_ROWS rows are few, by their number of rows: they are
    broadcast and their rows stay where they are. The others are joined by a
    shuffle in which no key has many rows. `total` is the number of rows of
    big if it is known; it raises the limit so that at most HOT_KEYS keys are
    broadcast at any size. Null keys match nothing.
    """
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if total is not None and total <= limit:  # no key can have more
        return big.join(table.drop(rows), key)
    hot = table.where(F.col(rows) > limit).drop(rows)
    if hot.isEmpty():
        return big.join(table.drop(rows), key)
    rest = table.where(F.col(rows) <= limit).drop(rows)
    few = F.broadcast(hot)
    return big.join(few, key).unionByName(big.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key))
