"""Picking the rows of a large table by a list of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.storage import materialize

#: Lists of up to so many keys are broadcast; longer ones pick by a shuffle.
BROADCAST_KEYS = 200_000
#: A key of more rows than this, and than a share of all rows that at most HOT_KEYS keys can have, is hot.
HOT_ROWS, HOT_KEYS = 256, 50_000


def pick(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is in `keys` (columns `on`, distinct), or with left_anti those whose key is not.

    The list is written first and counted, so that its size is known before it is broadcast.
    """
    keys = materialize(keys.select(*on), "picked-keys")
    small = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if small else keys, on, how)


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], count: str) -> DataFrame:
    """`rows` joined with `keys` (distinct on `on`; the column `count` has each key's number of rows).

    Hot keys are broadcast, so that their rows stay where they are; at most HOT_KEYS keys can be hot, whatever the size.
    The other keys' rows are shuffled. `keys` is a stored table.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    bar = max(HOT_ROWS, total // HOT_KEYS)
    hot = keys.filter(F.col(count) > bar)
    usual = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.filter(F.col(count) <= bar), on)
    return usual.unionByName(rows.join(F.broadcast(hot), on))


def free_name(frame: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
