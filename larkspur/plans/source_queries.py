"""Reading and writing: round trips through files, and JSON properties."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, identifiers
from ..operators import aggregates, evaluation, lookups, matching
from ..operators.lookups import exact_lookup
from ..sources import readers, writers
from ..streaming.incremental import resolve_stream
from . import matching_queries
from .stand_ins import BASE, CATALOGUE, catalogue, evaluated, items, observations, table


def _folder(spark, name):
    """A fresh folder where driver and executors can write: under spark.checkpoint.dir, else under the warehouse if all machines reach it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and warehouse.startswith(("file:", "/")):
            raise ValueError(f"executors can't share {warehouse}: set spark.checkpoint.dir")
        root = f"{warehouse}/_scratch"
    path = f"{root.rstrip('/')}/larkspur-files/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark, path):
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit; the folder is scratch space
        pass


def csv_sink_roundtrip(spark, sf_dir):
    path = _folder(spark, "csv")
    rows = catalogue(spark, sf_dir).select("pos", "id", F.concat(F.lit('a "quoted"; '), F.col("name")).alias("name"), "cost")
    writers.write_delimited(rows, path)
    return spark.read.schema(rows.schema).option("sep", ";").option("header", True).option("escape", '"').csv(path)


def json_catalog_roundtrip(spark, sf_dir):
    path = _folder(spark, "json")
    blank_some = F.when(F.col("pos") % 10 == 9, " ").otherwise(F.col("id"))
    card = F.struct(blank_some.alias("ID"), F.col("name").alias("Name"), "rarity", F.col("category").alias("Category"), F.array("category", "rarity").alias("Types"), F.col("cost").alias("Cost"), F.lit("x").alias("img_url"), F.lit(1).alias("unknown"))
    arrays = catalogue(spark, sf_dir).groupBy("category").agg(F.to_json(F.collect_list(card)).alias("value"))
    singles = spark.createDataFrame([("7",), ('{"id": "broken"',)], "value string")
    arrays.select("value").unionByName(singles).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_catalogue(spark, path, pattern="*.txt").select("id", "name", "rarity", "category", F.array_join("types", "|").alias("types"), "cost", "img_url")


def event_properties(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k.cast("long")).alias("total"), F.max(k).alias("largest"))


def template_labels(spark, sf_dir):
    folder = F.element_at(F.array(*map(F.lit, ("A", "Dash", "Slash", "7", "notes"))), (F.col("pos") % 5 + 1).cast("int"))
    paths = catalogue(spark, sf_dir).select(F.concat(F.lit("/t/"), folder, F.lit("/"), F.col("pos").cast("string"), F.lit(".png")).alias("path"))
    return readers.label_templates(paths)


def template_counts(spark, sf_dir):
    return aggregates.template_counts(template_labels(spark, sf_dir)).select("character", "n", F.round("share", 6).alias("share"))


def clean_history(spark, sf_dir):
    ending = F.when(F.col("pos") % 4 == 0, ".PNG").when(F.col("pos") % 4 == 1, ".jpg").otherwise(".png")
    lines = catalogue(spark, sf_dir).select(F.when(F.col("pos") % 7 == 0, "  ").otherwise(F.concat(F.lit(" /x/"), F.col("name"), ending, F.lit(" "))).alias("path"))
    return readers.clean_history(lines)


def stream_exact_lookup(spark, sf_dir):
    """Observations as a stream of files, resolved in micro-batches."""
    path, out = _folder(spark, "stream"), f"found_{uuid.uuid4().hex}"
    rows = observations(spark, sf_dir).select("pos", "code").withColumnRenamed("pos", "asked")
    rows.repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    found = resolve_stream(stream, catalogue(spark, sf_dir)).select("asked", "code", "pos", "id")
    query = found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/{out}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/{out}")


def batch_exact_lookup(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.col("pos").alias("asked"), "code")
    return exact_lookup(rows, catalogue(spark, sf_dir)).select("asked", "code", "pos", "id")


def json_objects(spark, sf_dir):
    """One object a file, names in snake case, some without an id."""
    path = _folder(spark, "objects")
    rows = catalogue(spark, sf_dir).where("pos <= 60")
    card = F.struct(F.when(F.col("pos") % 10 == 9, "").otherwise(F.col("id")).alias("id"), "name", F.col("pos").alias("pack_id"), F.col("name").alias("img_full_url"))
    rows.select(F.to_json(card).alias("value")).repartition(3).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_catalogue(spark, path, pattern="*.txt").select("id", "name", "pack_id", "img_full_url")


def json_array(spark, sf_dir):
    """One array in one file."""
    path = _folder(spark, "array")
    card = F.struct("pos", "id", "name", "cost")
    catalogue(spark, sf_dir).where("pos <= 200").groupBy().agg(F.to_json(F.collect_list(card)).alias("value")).write.text(path)
    return readers.read_catalogue(spark, path, pattern="*.txt").select("id", "name", "cost")


def listed_files(spark, sf_dir):
    """Files by extension, and how many there are."""
    path = _folder(spark, "listing")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), (F.col("n_nationkey") % 5).alias("folder"))
    rows.repartition(1).write.partitionBy("folder").text(path)
    found = readers.list_files(spark, path, types=("txt",)).unionByName(readers.list_files(spark, path, types=("png",)))
    return found.select(F.regexp_extract("path", r"folder=(\d+)/", 1).cast("int").alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def appended_inventory(spark, sf_dir):
    """Rows appended twice: how many, and the last allocated number."""
    path, rows = _folder(spark, "inventory"), items(spark, sf_dir).select("inventory_id", "card_data_id", "condition")
    for half in (0, 1):
        writers.append_rows(rows.where(F.col("condition") % 2 == half), path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return stored.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("inventory_id").alias("distinct_ids")).withColumn("last_number", F.lit(readers.last_number(stored)).cast("long"))


def written_report(spark, sf_dir):
    """The benchmark's report, all parts written as JSON; its confusions read again."""
    path, parts = _folder(spark, "report"), evaluation.evaluate(evaluated(spark, sf_dir))
    writers.write_report(parts, path)
    return spark.read.schema(parts["confusions"].schema).json(f"{path}/confusions")


def failure_folders(spark, sf_dir):
    """Rows in a folder for each class, read again through the folders."""
    path = _folder(spark, "failures")
    rows = catalogue(spark, sf_dir).select("pos", "id", F.concat(F.lit("Class"), (F.col("pos") % 4).cast("string")).alias("failure"))
    writers.write_failures(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select("pos", "id", "failure")


def appended_history(spark, sf_dir):
    """Lines appended twice and read as a history."""
    path = _folder(spark, "history")
    lines = catalogue(spark, sf_dir).select(F.concat(F.lit("/t/"), F.col("name"), F.when(F.col("pos") % 3 == 0, ".PNG").when(F.col("pos") % 3 == 1, ".png").otherwise(".txt")).alias("path"))
    writers.append_lines(lines, path)
    writers.append_lines(lines.limit(0).unionByName(lines.select(F.lit("/t/one more.png").alias("path")).distinct()), path)
    return readers.read_history(spark, path)


def segment_counts(spark, sf_dir):
    """Observed texts whose number of characters a code can have."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") % 20).alias("segments"))
    return rows.withColumn("plausible", identifiers.plausible_segments(F.col("segments")))


def overall_confidence(spark, sf_dir):
    """Reading and database confidence together, with and without a candidate."""
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (o % 130 - 10.0).alias("reading_score"), F.when(o % 7 != 0, o % 101 * 1.0).alias("confidence"), F.when(o % 5 != 0, "OP01-001").alias("number"))
    return matching.with_overall(rows).select("o_orderkey", F.round("overall", 6).alias("overall"))


def mapped_counts(spark, sf_dir):
    """A count from a map for each name; 0 for names that it lacks."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.create_map(F.lit("F"), F.col("o_custkey"), F.lit("O"), F.col("o_orderkey")).alias("counts"))
    return rows.select("o_orderkey", identifiers.mapped(F.col("counts"), F.col("o_orderstatus")).alias("n"))


def edge_ranked_regions(spark, sf_dir):
    """Regions by quality and the ink at their right edge, the best of each order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (2 + F.col("l_partkey") % 60).cast("int").alias("w"), (3 + F.col("l_suppkey") % 13).cast("int").alias("h"), (F.col("l_partkey") % 10 / 100.0).alias("edge"))
    score = geometry.region_quality(F.col("w") / 100.0, F.col("w"), F.col("h"), F.lit(8)) + geometry.edge_ink_penalty(F.col("edge"))
    ranked = rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))
    return lookups.first_by(ranked, [F.col("l_orderkey")], [F.desc("score"), F.col("l_linenumber"), F.col("l_partkey")])


def run_progress(spark, sf_dir):
    """How long a user's run of events took so far and what is left at that pace."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(W.partitionBy("user_id"))) / 1_000_000
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", seconds.alias("elapsed"), F.row_number().over(w).alias("done"), F.count(F.lit(1)).over(W.partitionBy("user_id")).alias("total"))
    left = identifiers.remaining_seconds(F.col("elapsed"), F.col("done"), F.col("total"))
    return rows.select("event_id", identifiers.duration_text(F.col("elapsed")).alias("elapsed"), F.round(left, 3).alias("left"))


QUERIES = {f.__name__: f for f in (csv_sink_roundtrip, json_catalog_roundtrip, event_properties, template_labels, template_counts, clean_history, stream_exact_lookup, batch_exact_lookup, json_objects, json_array, listed_files, appended_inventory, written_report, failure_folders, appended_history, segment_counts, overall_confidence, mapped_counts, edge_ranked_regions, run_progress)}

_LOOKUP = f"{BASE} SELECT o.pos AS asked, code, c.pos, id FROM observations o JOIN catalogue c ON upper(code) = upper(id)"
ORACLES = {
    "csv_sink_roundtrip": f"WITH {CATALOGUE} SELECT pos, id, 'a \"quoted\"; ' || name AS name, cost FROM catalogue",
    "json_catalog_roundtrip": f"WITH {CATALOGUE} SELECT id, name, rarity, category, category || '|' || rarity AS types, cost, 'x' AS img_url FROM catalogue WHERE pos % 10 <> 9",
    "event_properties": "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS INTEGER)) AS BIGINT) AS total, max(CAST(props->>'$.k' AS INTEGER)) AS largest FROM events GROUP BY 1",
    "template_labels": f"""WITH {CATALOGUE} SELECT '/t/' || list_extract(['A', 'Dash', 'Slash', '7', 'notes'], pos % 5 + 1) || '/' || pos || '.png' AS path, list_extract(['A', '-', '/', '7'], pos % 5 + 1) AS character FROM catalogue WHERE pos % 5 <> 4""",
    "template_counts": f"""WITH {CATALOGUE}, l AS (SELECT list_extract(['A', '-', '/', '7'], pos % 5 + 1) AS character FROM catalogue WHERE pos % 5 <> 4)
        SELECT character, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM l GROUP BY 1""",
    "clean_history": f"""WITH {CATALOGUE}, l AS (SELECT '/x/' || name || CASE pos % 4 WHEN 0 THEN '.PNG' ELSE '.png' END AS path FROM catalogue WHERE pos % 7 <> 0 AND pos % 4 <> 1) SELECT min(path) AS path FROM l GROUP BY upper(path)""",
    "json_objects": f"WITH {CATALOGUE} SELECT id, name, CAST(pos AS VARCHAR) AS pack_id, name AS img_full_url FROM catalogue WHERE pos <= 60 AND pos % 10 <> 9",
    "json_array": f"WITH {CATALOGUE} SELECT id, name, cost FROM catalogue WHERE pos <= 200",
    "listed_files": "SELECT DISTINCT CAST(n_nationkey % 5 AS INTEGER) AS folder, CAST(1 AS BIGINT) AS files FROM nation",
    "appended_inventory": "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS distinct_ids, CAST(max(o_orderkey) AS BIGINT) AS last_number FROM orders",
    "written_report": matching_queries.ORACLES["confusion_report"],
    "failure_folders": f"WITH {CATALOGUE} SELECT pos, id, 'Class' || (pos % 4) AS failure FROM catalogue",
    "appended_history": f"""WITH {CATALOGUE}, l AS (SELECT '/t/' || name || CASE pos % 3 WHEN 0 THEN '.PNG' ELSE '.png' END AS path FROM catalogue WHERE pos % 3 <> 2 UNION ALL SELECT '/t/one more.png') SELECT min(path) AS path FROM l GROUP BY upper(path)""",
    "segment_counts": "SELECT p_partkey AS pos, CAST(p_size % 20 AS INTEGER) AS segments, p_size % 20 BETWEEN 4 AND 14 AS plausible FROM part",
    "overall_confidence": """SELECT o_orderkey, round(CASE WHEN o_orderkey % 5 <> 0 THEN greatest(least(o_orderkey % 130 - 10.0, 100.0), 0.0) * 0.45 + CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 101 ELSE 0.0 END * 0.55
        ELSE greatest(least(o_orderkey % 130 - 10.0, 100.0), 0.0) * 0.6 END::DOUBLE, 6) AS overall FROM orders""",
    "mapped_counts": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_custkey WHEN 'O' THEN o_orderkey ELSE 0 END AS n FROM orders",
    "edge_ranked_regions": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, 2 + l_partkey % 60 AS w, 3 + l_suppkey % 13 AS h, (2 + l_partkey % 60) / 100.0::DOUBLE AS density, (l_partkey % 10) / 100.0::DOUBLE AS edge FROM lineitem),
        s AS (SELECT l_orderkey, l_linenumber, l_partkey, round((100.0 - abs(CASE WHEN density > 0.5 THEN 1.0 - density ELSE density END - 0.18::DOUBLE) * 250.0) * 0.55::DOUBLE + least(100.0, w * h / 20.0::DOUBLE) * 0.20::DOUBLE
            - abs(w / h::DOUBLE - 4.4::DOUBLE) * 8.0 + CASE WHEN edge >= 0.08::DOUBLE THEN -24.0 WHEN edge >= 0.025::DOUBLE THEN -10.0 ELSE 4.0 END, 6)::DOUBLE AS score FROM r)
        SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey) = 1""",
    "run_progress": """WITH r AS (SELECT event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events)
        SELECT event_id, printf('%02d:%02d:%02d', CAST(floor(s) AS BIGINT) // 3600, CAST(floor(s) AS BIGINT) // 60 % 60, CAST(floor(s) AS BIGINT) % 60) AS elapsed, round(s / done * (total - done), 3)::DOUBLE AS "left" FROM r""",
    "stream_exact_lookup": _LOOKUP,
    "batch_exact_lookup": _LOOKUP,
}
