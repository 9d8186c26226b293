"""Comparing stated rows with all rows of a table, where no equal key can narrow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def met(left: DataFrame, right: DataFrame, on: Column, most: int, by: str) -> DataFrame:
    """left joined with right on a condition without an equal key.

    right is broadcast if counted to be ``most`` rows at most. Else it is dealt
    into blocks of about that many rows by a hash of its column ``by``, and each
    left row meets every block by an equi-join on the block's number: the work
    spreads over as many tasks as there are blocks, and nothing large is sent
    to all executors.
    """
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), on)
    blocks = -(-right.count() // most)
    dealt = right.withColumn("__block", F.pmod(F.xxhash64(by), F.lit(blocks)))
    asked = left.withColumn("__asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return asked.join(dealt, (F.col("__asked") == F.col("__block")) & on).drop("__asked", "__block")
