"""Resolving readings (greedy text and lattice) to known numbers in two stages: a cheap score keeps K, the alignment decides.

The length band is an equi-join: each reading is exploded to the lengths it may
meet (at most eight), so no reading is compared with numbers outside its band.
Numbers are broadcast if counted to be few; else, as lengths are few and one may
hold most numbers, each length is dealt into blocks and a reading meets them all.
The K best are a limit on a row number, which Spark applies to each partition
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identifiers import letter_prefix
from ..functions.scoring import PROFILES, Profile, database_confidence, final_score, overall_confidence, quick_score
from . import blocks

MAX_BROADCAST_NUMBERS = 200_000


def candidates(readings: DataFrame, numbers: DataFrame, profile: Profile) -> DataFrame:
    """The K best numbers of each reading by the quick score: reading columns, number, quick, quick_rank. readings: reading (its key), greedy, lattice."""
    segments = F.size("lattice")
    usable = readings.where((F.trim("greedy") != "") & (segments > 0))
    banded = usable.withColumn("__length", F.explode(F.sequence(F.greatest(F.lit(3), segments - 5), segments + 2)))
    sized = numbers.withColumn("__size", F.length("number"))
    met = blocks.met(banded, sized, F.col("__length") == F.col("__size"), MAX_BROADCAST_NUMBERS, "number").drop("__length", "__size")
    if profile.prefix:
        begins = F.upper(letter_prefix(F.col("greedy"), 3))
        met = met.withColumn("__fits", (begins != "") & F.upper("number").startswith(begins))
        met = met.withColumn("__n", F.count_if("__fits").over(W.partitionBy("reading"))).where("__fits OR __n < 3").drop("__fits", "__n")
    scored = met.withColumn("quick", quick_score(F.col("lattice"), F.col("greedy"), F.col("number"), profile))
    ranked = scored.withColumn("quick_rank", F.row_number().over(W.partitionBy("reading").orderBy(F.desc("quick"), "number")))
    return ranked.where(F.col("quick_rank") <= profile.candidates)


def rerank(kept: DataFrame, profile: Profile, by_number: bool = False) -> DataFrame:
    """final and rank for each candidate; ties by the quick rank, or by the number."""
    scored = kept.withColumn("final", final_score(F.col("lattice"), F.col("greedy"), F.col("number"), profile))
    tie = "number" if by_number else "quick_rank"
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("reading").orderBy(F.desc("final"), tie)))


def lattice_match(readings: DataFrame, numbers: DataFrame, profile: str = "core", top: int = 5) -> DataFrame:
    """Per reading: its best number, score, margin to the second, database confidence and the top numbers.

    Distinct readings only are matched; readings without candidates give no row.
    """
    chosen = PROFILES[profile]
    found = rerank(candidates(readings, numbers, chosen), chosen, by_number=profile == "benchmark")
    best = found.where(F.col("rank") <= max(2, top)).groupBy("reading").agg(F.array_sort(F.collect_list(F.struct("rank", "number", "final"))).alias("best"))
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    out = best.select("reading", first["number"].alias("number"), first["final"].alias("score"), F.greatest(F.lit(0.0), first["final"] - F.coalesce(second["final"], F.lit(0.0))).alias("margin"), F.transform(F.slice("best", 1, top), lambda b: F.struct(b["number"].alias("number"), b["final"].alias("score"))).alias("top"))
    return out.withColumn("confidence", database_confidence(F.col("score"), F.col("margin")))


def early_exit(ranked: DataFrame, group: str, order: str, qualifies, score: str) -> DataFrame:
    """Per group the first row in order that qualifies, else the one with the highest score (the earlier of equals)."""
    marked = ranked.withColumn("__ok", qualifies)
    key = F.when(F.col("__ok"), F.struct(F.lit(0).alias("miss"), F.lit(0.0).alias("s"), F.col(order).alias("o"))).otherwise(F.struct(F.lit(1).alias("miss"), (-F.col(score)).alias("s"), F.col(order).alias("o")))
    return marked.withColumn("__rank", F.row_number().over(W.partitionBy(group).orderBy(key))).where("__rank = 1").drop("__rank", "__ok")


def evaluated_until(rows: DataFrame, group: str, order: str, qualifies, least: int = 1) -> DataFrame:
    """The rows of each group that are looked at, in order, when the search stops at the first qualifying row but not before ``least`` rows."""
    w = W.partitionBy(group).orderBy(order)
    counted = rows.withColumn("__at", F.row_number().over(w)).withColumn("__ok", F.coalesce(F.max(F.when(qualifies, 1)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return counted.where((F.col("__ok") == 0) | (F.col("__at") <= least)).drop("__at", "__ok")


def with_overall(matched: DataFrame, reading_score: str = "reading_score") -> DataFrame:
    return matched.withColumn("overall", overall_confidence(F.col(reading_score), F.coalesce("confidence", F.lit(0.0)), F.col("number").isNotNull()))


def best_candidate(rows: DataFrame, group: str, order: str, tolerances: tuple[float, float, float] = (0.35, 0.25, 0.5)) -> DataFrame:
    """The candidate that stands after comparing in order: group and best (struct).

    The comparison has tolerances and so no total order: candidates are folded
    one after another. A group's candidates are those of one image, so few.
    Columns: usable, global_score, length_difference, database, geometry, image, name.
    """
    fields = ["usable", "global_score", "length_difference", "database", "geometry", "image", "name"]
    t_global, t_database, t_geometry = tolerances

    def better(a, b):
        far = lambda name, t: F.abs(a[name] - b[name]) > t
        return (
            F.when(a["usable"] != b["usable"], a["usable"])
            .when(~a["usable"], a["image"] > b["image"])
            .when(far("global_score", t_global), a["global_score"] > b["global_score"])
            .when(a["length_difference"] != b["length_difference"], a["length_difference"] < b["length_difference"])
            .when(far("database", t_database), a["database"] > b["database"])
            .when(far("geometry", t_geometry), a["geometry"] > b["geometry"])
            .otherwise(a["image"] > b["image"])
        )

    listed = rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("c")))), lambda x: x["c"]).alias("all"))
    best = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda kept, c: F.when(better(c, kept), c).otherwise(kept))
    return listed.select(group, best.alias("best"))
