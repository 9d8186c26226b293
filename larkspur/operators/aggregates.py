"""Catalogue analysis, group reductions and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identifiers import UNKNOWN, blank, key, known_number


def duplicate_keys(df: DataFrame, id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """Ids that occur more than once, in either case: the first spelling and how often."""
    counted = df.groupBy(key(F.col(id_col)).alias("__key")).agg(F.min(F.struct(pos_col, id_col)).alias("f"), F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").orderBy("__key").select(F.col(f"f.{id_col}").alias("id"), "n")


def variant_histogram(df: DataFrame, id_col: str = "id") -> DataFrame:
    """How many printed numbers have so many variants."""
    per_number = df.groupBy(known_number(F.col(id_col))).agg(F.count(F.lit(1)).alias("variants"))
    return per_number.groupBy("variants").agg(F.count(F.lit(1)).alias("numbers"))


def catalogue_summary(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows, distinct ids and printed numbers, rows without an image or name."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(key(F.col(id_col))).alias("ids"),
        F.countDistinct(known_number(F.col(id_col))).alias("numbers"),
        F.count_if(F.col(id_col).contains("_")).alias("variants"),
    )


def shared_or_unknown(df: DataFrame, by: list[Column], value: str, pos: str) -> DataFrame:
    """The group's value if all non-blank ones agree (its first spelling), else the word for unknown."""
    given = F.when(~blank(F.col(value)), F.col(value))
    grouped = df.groupBy(*by).agg(F.countDistinct(F.upper(given)).alias("__n"), F.min(F.when(given.isNotNull(), F.struct(pos, value))).alias("__first"))
    return grouped.withColumn("shared", F.when(F.col("__n") == 1, F.col(f"__first.{value}")).otherwise(UNKNOWN)).drop("__n", "__first")


def shortest_id(df: DataFrame, by: list[Column], id_col: str, pos: str) -> DataFrame:
    """Per group: the shortest id (the first of equals), the sorted distinct ids and the number of rows."""
    return df.groupBy(*by).agg(F.min(F.struct(F.length(id_col).alias("l"), pos, id_col)).alias("__s"), F.array_sort(F.collect_set(id_col)).alias("ids"), F.count(F.lit(1)).alias("n")).select("*", F.col(f"__s.{id_col}").alias("shortest")).drop("__s")


def numbers_by_length(numbers: DataFrame) -> DataFrame:
    """How many known numbers have each length, and the first and last of them."""
    return numbers.groupBy(F.length("number").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"), F.max("number").alias("last"))


def median(value: Column) -> Column:
    """Mean of the two middle values for an even number; 0 for none."""
    return F.coalesce(F.percentile(value, 0.5), F.lit(0.0))


def upper_median(value: Column) -> Column:
    """The value in place n div 2 of the sorted ones (of a group that fits a row); null for none."""
    values = F.sort_array(F.collect_list(value))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def bounding_box(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """Columns x, y, w and h of the union of a group's rectangles."""
    left, top = F.min(x), F.min(y)
    return [left.alias("x"), top.alias("y"), (F.max(x + w) - left).alias("w"), (F.max(y + h) - top).alias("h")]


def outcome_counts(df: DataFrame, outcome: Column) -> DataFrame:
    """Runs by outcome, and their share."""
    counted = df.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))  # one row per outcome


def template_counts(templates: DataFrame) -> DataFrame:
    """Templates of each character and their share of all."""
    return outcome_counts(templates, F.col("character")).withColumnRenamed("outcome", "character")


def capped_per_class(df: DataFrame, class_col: str, order: list[str], existing: Column, most: int = 200) -> DataFrame:
    """New rows that fit under a class's cap, after those that exist."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(class_col).orderBy(*order)))
    return ranked.where(F.col("__rank") + existing <= most).drop("__rank")
