"""Uniform shuffle into shards by a hypergeometric communication matrix.

A uniform random permutation of all rows, cut into shards of exact sizes, sends
a random number of rows from each source partition to each shard; those counts
follow a multivariate hypergeometric law. The matrix is drawn first, on the
driver, from the partitions' row counts. Each partition is then permuted locally
and cut at its row's cumulative counts, the pieces are exchanged, and each
target is permuted again. The result is a uniform shuffle in which shard sizes
are exact (at most one row apart) before any row moves.

Only ids, sizes and checksums move, never texts. A target cell is a shard or an
equal part of one, so that a shard larger than ``rows_per_cell`` is not one
task; slots stay gapless, as cell sizes are exact. The matrix has at most 1,024
sources and 400 cells (partitions of a larger input are taken together), which
bounds what the driver holds at any input size. It does not bound the tasks: a
permutation is an order by a hash, so a large source or cell is ordered in
ranges of that hash of about ``rows_per_range`` rows, each of which begins where
the counts of those before it end. The ranges' number changes no row's place.

Row numbers come from one written pass over the input, so a retried task can't
change them. Edge cases: a null text has size 16 and the checksum of an empty
text; ids may be null or repeated, every row gets its own slot; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

MAX_SOURCES, MAX_CELLS, ROWS_PER_CELL, ROWS_PER_RANGE = 1024, 400, 20_000, 500_000


def hypergeometric(rng: random.Random, good: int, total: int, draws: int) -> int:
    """How many of ``good`` among ``total`` are in ``draws`` without replacement; inversion outwards from the mode."""
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(log(good, mode) + log(total - good, draws - mode) - log(total, draws))
    u = rng.random() - at_mode
    down, up, p_down, p_up = mode, mode, at_mode, at_mode
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (total - good - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (total - good - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> list[list[int]]:
    """Rows sum to sources, columns to targets; law of a uniform permutation."""
    rng, left, out = random.Random(seed), list(targets), []
    for n in sources:
        row, pool, draws = [], sum(left), n
        for t in left:
            x = hypergeometric(rng, t, pool, draws) if draws else 0
            row.append(x)
            pool, draws = pool - t, draws - x
        left = [t - x for t, x in zip(left, row, strict=True)]
        out.append(row)
    return out


def exact_sizes(n: int, parts: int) -> list[int]:
    return [n // parts + (i < n % parts) for i in range(parts)]


def range_bits(rows: int, rows_per_range: int) -> int:
    """How many leading bits of a hash part so many rows into ranges of about that size."""
    return max(0, math.ceil(math.log2(max(1, rows) / rows_per_range)))


def permuted(rows: DataFrame, key: str, seed: int, bits: int) -> DataFrame:
    """Rows with ``turn``: the place from 0 in the order of a hash of uid within the key, numbered in 2^bits ranges of the hash.

    Rows must be a written table where there are bits, as it is read twice.
    """
    order = F.xxhash64("uid", F.lit(seed))
    if not bits:  # a single range begins at 0
        return rows.withColumn("turn", F.row_number().over(W.partitionBy(key).orderBy(order, "uid")) - 1)
    # An arithmetic shift keeps the sign, so ranges are in the order of the hash.
    ranged = rows.withColumn("range", F.shiftright(order, 64 - bits))
    counts = ranged.groupBy(key, "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy(key).orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    begins = counts.select(key, "range", F.coalesce(before, F.lit(0)).alias("begin"))
    placed = ranged.withColumn("turn", F.row_number().over(W.partitionBy(key, "range").orderBy(order, "uid")) - 1)
    return placed.join(begins, [key, "range"]).withColumn("turn", F.col("begin") + F.col("turn")).drop("range", "begin")


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = 20_240_613, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (its place in the shard)."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    scratch = Scratch(spark, "shards")
    rows = scratch.table(
        docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("uid"), (F.spark_partition_id() % MAX_SOURCES).alias("source")),
        "rows",
    )
    counted = sorted((r["source"], r["n"]) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counted)
    parts = max(1, min(MAX_CELLS // shards or 1, math.ceil(total / shards / ROWS_PER_CELL)))
    sizes = [x for n in exact_sizes(total, shards) for x in exact_sizes(n, parts)]
    matrix = communication_matrix([n for _, n in counted], sizes, seed)
    plan = [{"source": s, "ends": [sum(row[: i + 1]) for i in range(len(row))]} for (s, _), row in zip(counted, matrix, strict=True)]
    starts = [sum(sizes[k - k % parts : k]) for k in range(len(sizes))]

    moves = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), "array<struct<source:int,ends:array<bigint>>>")))
    mixed = permuted(rows, "source", seed, range_bits(max((n for _, n in counted), default=0), rows_per_range))
    # At most MAX_SOURCES rows of MAX_CELLS counts: a bounded broadcast.
    sent = mixed.join(F.broadcast(moves), "source").withColumn("cell", F.size(F.filter("ends", lambda end: end <= F.col("turn")))).drop("source", "ends", "turn")
    bits = range_bits(max(sizes, default=0), rows_per_range)
    placed = permuted(scratch.table(sent, "sent") if bits else sent, "cell", seed + 1, bits)
    start = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), F.col("cell"))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.floor(F.col("cell") / parts).cast("int").alias("shard"), (start + F.col("turn")).cast("long").alias("slot"))
