"""Tables in the roles of catalogue, readings and inventory, as DataFrames and as SQL.

part is the catalogue: its id is the name in code form, with a variant suffix on
two thirds of the rows. Each part gives a noisy observation of its printed
number: as it is, with digits for lookalike letters, with a character dropped,
or with one doubled. customer and orders are a second catalogue and its
inventory; supplier and lineitem are containers and taken slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters and their lookalikes, both ways.
FROM, TO = "OILBSZ01852", "011852OIBSZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))
    suffix = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("_P"), (F.col("p_partkey") % 5).cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat(code, suffix).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("rarity"), F.col("p_type").alias("category"), F.col("p_size").alias("cost"))


CATALOGUE = """catalogue AS (SELECT p_partkey AS pos, upper(replace(p_name, ' ', '-')) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_P' || CAST(p_partkey % 5 AS VARCHAR) END AS id,
        p_name AS name, p_brand AS rarity, p_type AS category, p_size AS cost FROM part)"""
NUMBERS = "numbers AS (SELECT DISTINCT upper(trim(split_part(id, '_', 1))) AS number FROM catalogue)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, expected and code (its noisy form)."""
    rows = catalogue(spark, sf_dir).select("pos", "rarity", F.substring_index("id", "_", 1).alias("expected"))
    at = (F.col("pos") % F.length("expected")).cast("int")
    digits = F.translate("expected", "OILBSZ", "011852")
    dropped = F.concat(F.substr("expected", F.lit(1), at), F.substr("expected", at + 2))
    doubled = F.concat(F.substr(digits, F.lit(1), at + 1), F.substr(digits, at + 1))
    kind = F.col("pos") % 4
    return rows.withColumn("code", F.when(kind == 0, F.col("expected")).when(kind == 1, digits).when(kind == 2, dropped).otherwise(doubled))


OBSERVATIONS = """expected_rows AS (SELECT pos, rarity, split_part(id, '_', 1) AS expected, CAST(pos % length(split_part(id, '_', 1)) AS INTEGER) AS spot FROM catalogue),
     observations AS (SELECT pos, rarity, expected, CASE pos % 4 WHEN 0 THEN expected WHEN 1 THEN translate(expected, 'OILBSZ', '011852')
        WHEN 2 THEN substr(expected, 1, spot) || substr(expected, spot + 2)
        ELSE substr(translate(expected, 'OILBSZ', '011852'), 1, spot + 1) || substr(translate(expected, 'OILBSZ', '011852'), spot + 1) END AS code FROM expected_rows)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct observed texts with a lattice: each character at 90, its lookalike at 70."""
    texts = observations(spark, sf_dir).select(F.col("code").alias("reading")).distinct()
    other = lambda c: F.translate(c, FROM, TO)
    cell = lambda c: F.when(other(c) == c, F.create_map(c, F.lit(90.0))).otherwise(F.create_map(c, F.lit(90.0), other(c), F.lit(70.0)))
    letters = F.filter(F.split("reading", ""), lambda c: c != "")
    return texts.select("reading", F.col("reading").alias("greedy"), F.transform(letters, cell).alias("lattice"))


READINGS = "readings AS (SELECT DISTINCT code AS reading FROM observations)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as inventory items whose card is their customer."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.format_string("VCV-%06d", o).alias("inventory_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("card_data_id"),
        (o % 7).cast("int").alias("condition"),
        (o % 8).cast("int").alias("status"),
        F.when(o % 5 != 0, F.format_string("BC-%03d", o % 100)).alias("container_code"),
        F.when(o % 3 != 0, (o % 40).cast("int")).alias("slot_number"),
        F.when(o % 2 == 0, F.concat(F.lit("/scans/"), o.cast("string"), F.lit(".png"))).alias("original_scan_path"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as a catalogue."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("rarity"))


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.format_string("BC-%03d", s).alias("code"), (1 + s % 9).cast("int").alias("capacity"), (s % 4 != 0).alias("is_active"))


def taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.lower(F.format_string("BC-%03d", F.col("l_suppkey"))).alias("container_code"), F.col("l_linenumber").alias("slot_number"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations resolved to the nearest number, with a margin and usability that follow from their place."""
    from ..operators.lookups import known_numbers, nearest_number

    found = nearest_number(observations(spark, sf_dir), known_numbers(catalogue(spark, sf_dir)))
    pos = F.col("pos")
    return found.select("pos", "expected", F.col("code").alias("greedy"), F.col("number").alias("text"), F.length("code").alias("segment_count"), (pos % 11 != 0).alias("is_usable"), ((pos % 7) * 0.7).alias("margin"))


NEAREST = """distances AS (SELECT code, number, levenshtein(upper(code), number) AS distance,
        row_number() OVER (PARTITION BY code ORDER BY levenshtein(upper(code), number), abs(length(number) - length(code)), number) AS place
        FROM (SELECT DISTINCT code FROM observations) CROSS JOIN numbers),
     nearest AS (SELECT code, number, distance FROM distances WHERE place = 1)"""
EVALUATED = """evaluated AS (SELECT pos, expected, code AS greedy, number AS text, length(code) AS segment_count, pos % 11 <> 0 AS is_usable, (pos % 7) * 0.7 AS margin
        FROM observations JOIN nearest USING (code))"""
BASE = f"WITH {CATALOGUE}, {NUMBERS}, {OBSERVATIONS}"
