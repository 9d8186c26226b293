"""Readers of catalogues, image listings, template folders and lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import blank, class_label, file_extension, file_stem, key

CATALOGUE = T.StructType.fromJson(
    {
        "type": "struct",
        "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in [("id", "string"), ("name", "string"), ("rarity", "string"), ("category", "string")]]
        + [{"name": n, "type": {"type": "array", "elementType": "string", "containsNull": True}, "nullable": True, "metadata": {}} for n in ("colors", "types", "attributes")]
        + [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in [("cost", "integer"), ("power", "integer"), ("counter", "integer"), ("effect", "string"), ("trigger", "string"), ("pack_id", "string"), ("img_url", "string"), ("img_full_url", "string")]],
    }
)
IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp", "webp")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType = CATALOGUE, pattern: str = "*.json") -> DataFrame:
    """All JSON files under a folder: an array or one object each; names in any case or snake case.

    Files that don't parse, and those whose root is neither, give no rows; rows
    with a blank id are dropped. json_file is each row's path. A missing path is
    an empty catalogue.
    """
    names = {f.name.replace("_", ""): f.name for f in schema.fields}
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("json_file", F.lit(None).cast("string"))
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_path").alias("json_file"))
    root = F.trim("value")
    as_list = F.when(root.startswith("["), root).when(root.startswith("{"), F.concat(F.lit("["), root, F.lit("]")))
    rows = files.select("json_file", F.posexplode(F.from_json(as_list, "array<map<string,string>>", {"mode": "PERMISSIVE"})).alias("at", "row"))
    plain = F.transform_keys("row", lambda k, v: F.lower(F.replace(k, F.lit("_"), F.lit(""))))
    rows = rows.withColumn("row", plain)
    value = lambda f: F.from_json(F.try_element_at("row", F.lit(f.name.replace("_", ""))), f.dataType.simpleString()) if isinstance(f.dataType, T.ArrayType) else F.try_element_at("row", F.lit(f.name.replace("_", ""))).cast(f.dataType)
    out = rows.select(*(value(f).alias(names[f.name.replace("_", "")]) for f in schema.fields), "json_file", "at")
    return out.where(~blank(F.col("id"))).drop("at")


def list_files(spark: SparkSession, path: str, types: tuple[str, ...] = IMAGE_TYPES, recursive: bool = True) -> DataFrame:
    """path of the files with one of the extensions, in either case; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path")
    return found.where(file_extension(F.col("path")).isin(*(f".{t}" for t in types)))


def image_index(spark: SparkSession, path: str) -> DataFrame:
    """stem and path of the images under a folder, the smallest path of each stem."""
    return index_paths(list_files(spark, path))


def index_paths(paths: DataFrame) -> DataFrame:
    """stem and path for listed paths of supported types, the smallest path of each stem in either case."""
    supported = paths.where(file_extension(F.col("path")).isin(*(f".{t}" for t in IMAGE_TYPES))).withColumn("stem", file_stem(F.col("path")))
    first = W.partitionBy(key(F.col("stem"))).orderBy("path")
    return supported.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").select("stem", "path")


def template_library(spark: SparkSession, path: str) -> DataFrame:
    """path and character of the templates under a folder of class folders; folders that stand for none are left out."""
    files = list_files(spark, path)
    return label_templates(files)


def label_templates(paths: DataFrame) -> DataFrame:
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return paths.withColumn("character", class_label(folder)).where("character IS NOT NULL")


def read_grey(spark: SparkSession, path: str) -> DataFrame:
    """id (path), width, height and grey pixels of the images under a folder."""
    image = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path).select("image.*")

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            out = []
            for origin, h, w, n, data in zip(frame["origin"], frame["height"], frame["width"], frame["nChannels"], frame["data"], strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                grey = pixels[:, :, 0] if n == 1 else (pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])).round().astype(np.uint8)
                out.append((origin, w, h, grey.tobytes()))
            yield pd.DataFrame(out, columns=["id", "width", "height", "pixels"])

    return image.mapInPandas(run, "id string, width int, height int, pixels binary")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The distinct png paths in a text file, in either case; blank lines are left out."""
    return clean_history(spark.read.text(path).select(F.col("value").alias("path")))


def clean_history(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.trim("path").alias("path")).where(~blank(F.col("path")) & (file_extension(F.col("path")) == ".png"))
    return rows.groupBy(F.upper("path").alias("__k")).agg(F.min("path").alias("path")).drop("__k")


def read_table(spark: SparkSession, options: dict[str, str], order: str) -> DataFrame:
    """A database table through JDBC, in order of a column."""
    return spark.read.format("jdbc").options(**options).load().orderBy(order)


def last_number(items: DataFrame) -> int:
    """The largest allocated number of an inventory; 0 for none."""
    found = items.agg(F.max(F.regexp_extract("inventory_id", r"(\d+)$", 1).cast("long")).alias("n")).first()
    return found["n"] or 0
