"""Computations over ordered rows of a group: ranks, margins, gaps, moving means, windows, interleaving and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identifiers import key


def rank_labels(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """label: "1.", "2.", ... in each group."""
    return df.withColumn("label", F.concat(F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("string"), F.lit(".")))


def margins(df: DataFrame, by: list[str], score: str, order: list[Column]) -> DataFrame:
    """Per group its best row and the margin to the second; a single row's margin is its score."""
    w = W.partitionBy(*by).orderBy(F.desc(score), *order)
    marked = df.withColumn("__rank", F.row_number().over(w)).withColumn("__next", F.lead(score).over(w))
    return marked.where("__rank = 1").withColumn("margin", F.greatest(F.lit(0.0), F.col(score) - F.coalesce("__next", F.lit(0.0)))).drop("__rank", "__next")


def centered_mean(df: DataFrame, by: list[str], order: list[str], value: str, reach: int) -> DataFrame:
    """smooth: mean of the value and its neighbours to either side, fewer at the ends."""
    return df.withColumn("smooth", F.avg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)))


def running_max(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    return df.withColumn("peak", F.max(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def adjacent_gap(df: DataFrame, by: list[str], order: list[str], start: Column, end: Column) -> DataFrame:
    """gap: from the end of the row before to this row's start; null for the first."""
    return df.withColumn("gap", start - F.lag(end).over(W.partitionBy(*by).orderBy(*order)))


def windows(items: Column, smallest: Column, largest: Column) -> Column:
    """All runs of neighbours with a size in the range, as structs of start, size and items."""
    n = F.size(items)
    sizes = F.when(smallest <= F.least(largest, n), F.sequence(smallest, F.least(largest, n))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("start"), k.alias("size"), F.slice(items, i + 1, k).alias("items")))))


#: Sizes of code formats and the place of the dash in each.
FORMATS = {5: 1, 8: 4, 9: 5}


def format_windows(items: Column) -> Column:
    """Runs with the sizes of code formats, with the dash's place in them."""
    dash = lambda k: F.element_at(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), k)
    found = F.filter(windows(items, F.lit(min(FORMATS)), F.lit(max(FORMATS))), lambda w: w["size"].isin(*FORMATS))
    return F.transform(found, lambda w: F.struct(w["start"].alias("start"), w["size"].alias("size"), dash(w["size"]).alias("dash"), w["items"].alias("items")))


def interleave(df: DataFrame, list_col: str, rank_col: str, signature: list[str], most: int) -> DataFrame:
    """Ranked lists taken in turn: by rank, then list; the first of each signature stays, up to a number."""
    w = W.partitionBy(*signature).orderBy(rank_col, list_col)
    firsts = df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")
    return firsts.orderBy(rank_col, list_col).limit(most)


def distinct_first(df: DataFrame, by: list[Column], pos: str) -> DataFrame:
    """The first row of each composite key; order by pos to have the old order."""
    return df.withColumn("__first", F.row_number().over(W.partitionBy(*by).orderBy(pos))).where("__first = 1").drop("__first")


def seeded_sample(df: DataFrame, n: int | None, seed: int, id_col: str) -> DataFrame:
    """n rows by a seeded hash of their id, in order of the id; all rows for no or too large an n."""
    chosen = df if not n or n < 0 else df.orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col).limit(n)
    return chosen.orderBy(key(F.col(id_col).cast("string")))


def pick_untrained(images: DataFrame, trained: DataFrame, path_col: str = "path", seed: int = 0) -> DataFrame:
    """One image by seeded chance that is not in the history; paths compare in either case."""
    rest = untrained(images, trained, path_col)
    return rest.orderBy(F.md5(F.concat(F.col(path_col), F.lit(str(seed)))), path_col).limit(1)


def untrained(images: DataFrame, trained: DataFrame, path_col: str = "path") -> DataFrame:
    return images.join(trained.select(F.upper(path_col).alias("__p")), F.upper(path_col) == F.col("__p"), "left_anti")


def least_in_range(df: DataFrame, by: list[str], place: str, cost: str, low: Column, high: Column) -> DataFrame:
    """Per group the place of least cost in a range; the first of equals."""
    inside = df.where(F.col(place).between(low, high))
    return inside.groupBy(*by).agg(F.min(F.struct(cost, place)).alias("m")).select(*by, F.col(f"m.{place}").alias(place), F.col(f"m.{cost}").alias(cost))


def two_cuts(df: DataFrame, by: list[str], place: str, cost: str, apart: int = 4) -> DataFrame:
    """Per group the two places of least total cost that are so far apart; the first of equals. A group is one segment's columns."""
    listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(cost).alias("c")))).alias("all"))
    pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b["p"] - a["p"] >= apart), lambda b: F.struct((a["c"] + b["c"]).alias("cost"), a["p"].alias("first"), b["p"].alias("second")))))
    best = F.array_min(pairs)
    return listed.select(*by, best["first"].alias("first"), best["second"].alias("second"), best["cost"].alias("cost"))


def ranked_regions(regions: DataFrame, by: list[str], score: str, most: int) -> DataFrame:
    """Regions by score, then the smaller area; the first ones of each image."""
    w = W.partitionBy(*by).orderBy(F.desc(score), F.col("w") * F.col("h"), "x", "y", "w")
    return regions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def ranked_hypotheses(hypotheses: DataFrame, by: list[str], score: str, count: str, tie: list[str], most: int, usual: int = 8) -> DataFrame:
    """Segmentations by score, then how near their count is to the usual one; the first ones of each image."""
    w = W.partitionBy(*by).orderBy(F.desc(score), F.abs(F.col(count) - usual), *tie)
    return hypotheses.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def window_bonus(items: int | Column, size: Column, dashed: Column) -> Column:
    """What a run gains by a plausible dash and loses for each component left out."""
    return F.when(dashed, 14.0).otherwise(-12.0) - (items - size) * 1.5


def harvested(candidates: DataFrame, label: str, order: str, count: str) -> DataFrame:
    """Per label the first candidate with as many segments as the label has characters; its rows are accepted. Labels without one give no row."""
    fits = candidates.where(F.col(count) == F.length(label))
    return fits.withColumn("__first", F.row_number().over(W.partitionBy(label).orderBy(order))).where("__first = 1").drop("__first")


def best_region(regions: DataFrame, by: list[str], difference: str, score: str, tie: str) -> DataFrame:
    """Per image the region with the least length difference, then the highest score."""
    w = W.partitionBy(*by).orderBy(difference, F.desc(score), tie)
    return regions.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")
