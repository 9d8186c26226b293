"""Readings against what was expected: accuracy, confusions, failure classes and the catalogue's effect.

Columns of the input: expected, greedy, text, segment_count, is_usable, margin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import FAILURES, failure_class

MISSING = "∅"


def ratio(part, whole):
    """Per cent, 0 for an empty whole."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def character_pairs(rows: DataFrame) -> DataFrame:
    """expected and actual character of each place of usable rows, with a sign for a missing one."""
    places = F.sequence(F.lit(1), F.greatest(F.length("expected"), F.length("text")))
    usable = rows.where("is_usable AND greatest(length(expected), length(text)) > 0").select("expected", "text", F.explode(places).alias("at"))
    letter = lambda x: F.coalesce(F.nullif(F.substr(F.col(x), F.col("at"), F.lit(1)), F.lit("")), F.lit(MISSING))
    return usable.select(letter("expected").alias("expected"), letter("text").alias("actual"))


def confusion_matrix(rows: DataFrame, top: int | None = 50) -> DataFrame:
    """Confused pairs by count, then expected, then actual; the report shows the first ones."""
    counted = character_pairs(rows).where("expected <> actual").groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "expected", "actual").limit(top) if top else counted


def accuracy_summary(rows: DataFrame) -> DataFrame:
    """Rows and characters that are right. Characters of unusable rows count as wrong."""
    places = F.arrays_zip(F.split("expected", ""), F.split("text", ""))
    same = F.when(F.col("is_usable"), F.size(F.filter(places, lambda p: (p["0"] == p["1"]) & (p["0"] != "")))).otherwise(0)
    total = F.when(F.col("is_usable"), F.greatest(F.length("expected"), F.length("text"))).otherwise(F.length("expected"))
    correct = F.col("is_usable") & (F.col("expected") == F.col("text"))
    summed = rows.agg(F.count(F.lit(1)).alias("tested"), F.count_if(correct).alias("correct"), F.coalesce(F.sum(total), F.lit(0)).alias("characters"), F.coalesce(F.sum(same), F.lit(0)).alias("correct_characters"))
    return summed.select("*", ratio(F.col("correct"), F.col("tested")).alias("accuracy"), ratio(F.col("correct_characters"), F.col("characters")).alias("character_accuracy"))


def database_effect(rows: DataFrame, low_margin: float = 2.0) -> DataFrame:
    """What the catalogue changed: corrected, worsened, unchanged right and wrong; segmentation failures and low margins."""
    usable, greedy, text = F.col("is_usable"), F.col("greedy") == F.col("expected"), F.col("text") == F.col("expected")
    return rows.agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if(usable & ~greedy & text).alias("corrected"),
        F.count_if(usable & greedy & ~text).alias("worsened"),
        F.count_if(usable & greedy & text).alias("unchanged_right"),
        F.count_if(usable & ~greedy & ~text).alias("unchanged_wrong"),
        F.count_if(~usable).alias("segmentation_failures"),
        F.count_if(usable & (F.col("margin") < low_margin)).alias("low_margin"),
    )


def classified(rows: DataFrame) -> DataFrame:
    """Wrong rows with their failure class and its place in the order of tests."""
    wrong = rows.where("NOT is_usable OR expected <> text")
    failure = failure_class(F.col("expected"), F.col("text"), F.col("greedy"), F.col("segment_count"), F.col("is_usable"), F.col("margin"))
    return wrong.withColumn("failure", failure).withColumn("ordinal", F.array_position(F.array(*map(F.lit, FAILURES)), F.col("failure")).cast("int"))


def failure_histogram(rows: DataFrame) -> DataFrame:
    return classified(rows).groupBy("failure", "ordinal").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ordinal")


def stem_accuracy(scans: DataFrame) -> DataFrame:
    """Recognised codes against the file stems they were read from. Columns: stem, code."""
    summed = scans.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.upper("stem") == F.upper("code")).alias("correct"))
    return summed.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def evaluate(rows: DataFrame) -> dict[str, DataFrame]:
    """All parts of the report."""
    return {"accuracy": accuracy_summary(rows), "confusions": confusion_matrix(rows), "failures": failure_histogram(rows), "database_effect": database_effect(rows)}
