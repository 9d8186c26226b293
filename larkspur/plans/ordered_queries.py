"""Order statistics, windows, samples, geometry and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, identifiers
from ..operators import aggregates, lookups, ordered, segmentation, vectors
from .stand_ins import BASE, catalogue, observations, table

SPREAD = 2.0


def median_exact(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity IS NOT NULL")
    return rows.groupBy("l_suppkey").agg(F.round(aggregates.median(F.col("l_quantity")), 6).alias("median"))


def median_upper(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(aggregates.upper_median(F.col("l_quantity")).alias("upper_median"))


def _boxes(spark, sf_dir):
    """Rectangles from the lines of an order."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (n * 12 + F.col("l_partkey") % 7).cast("int").alias("x"), (F.col("l_suppkey") % 5).cast("int").alias("y"), (2 + F.col("l_partkey") % 11).cast("int").alias("w"), (3 + F.col("l_quantity") % 13).cast("int").alias("h"))


BOXES = "boxes AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 12 + l_partkey % 7 AS INTEGER) AS x, CAST(l_suppkey % 5 AS INTEGER) AS y, CAST(2 + l_partkey % 11 AS INTEGER) AS w, CAST(floor(3 + l_quantity % 13) AS INTEGER) AS h FROM lineitem)"


def bounding_box(spark, sf_dir):
    return _boxes(spark, sf_dir).groupBy("l_orderkey").agg(*aggregates.bounding_box(*map(F.col, "xywh")))


def component_predicates(spark, sf_dir):
    r, mh = F.struct("x", "y", "w", "h"), F.lit(9.0)
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "x", geometry.possible_text(r, F.lit(20), F.lit(14)).alias("text"), geometry.likely_dash(r, mh).alias("dash"), geometry.likely_dash_relaxed(r, mh).alias("relaxed"), geometry.part_count(F.col("w"), F.col("h"), F.lit(6.0), mh).alias("parts"))


def region_scores(spark, sf_dir):
    r = F.struct("x", "y", "w", "h")
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "x", F.round(geometry.region_score(r, F.lit(120), F.lit(40), F.lit(8)), 6).alias("score"), F.round(geometry.region_quality(F.col("w") / 20.0, F.col("w"), F.col("h"), F.lit(8)), 6).alias("quality"))


def neighbour_iou(spark, sf_dir):
    """Overlap of each rectangle with the next of its order, at the same left edge."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "x", "y", "w", "h")
    rows = _boxes(spark, sf_dir).withColumn("a", F.struct(F.lit(0).alias("x"), "y", "w", "h")).withColumn("b", F.lead("a").over(w)).where("b IS NOT NULL")
    return rows.select("l_orderkey", "l_linenumber", "x", F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("iou"))


def _rows_of_boxes(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return boxes.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("x", "y", "w", "h"))).alias("rects"))


def merged_rows(spark, sf_dir):
    rows = _rows_of_boxes(spark, sf_dir).select("l_orderkey", F.size("rects").alias("before"), F.posexplode(geometry.merge_row(F.col("rects"))).alias("place", "r"))
    return rows.select("l_orderkey", "before", "place", "r.*")


def iou_suppression(spark, sf_dir):
    flat = F.transform("rects", lambda r: F.struct((r["x"] % 9).cast("int").alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h")))
    rows = _rows_of_boxes(spark, sf_dir).select("l_orderkey", F.posexplode(geometry.suppress(flat, 0.6)).alias("place", "r"))
    return rows.select("l_orderkey", "place", "r.*")


def segmentation_scores(spark, sf_dir):
    rows = _rows_of_boxes(spark, sf_dir)
    first = F.get("rects", F.lit(0))
    plain = lambda score, name: (F.round(score, 6) + F.lit(0.0)).alias(name)  # noqa: E731 - no negative zero
    return rows.select("l_orderkey", plain(geometry.segmentation_score(F.col("rects"), F.lit(110)), "geometry"), plain(geometry.sequence_score(F.col("rects"), F.lit(0), F.lit(8.0)), "sequence"), plain(geometry.discarded_score(F.col("rects"), F.lit(1), F.lit(2), first["h"].cast("double")), "discarded"))


def best_runs(spark, sf_dir):
    """The run of components that looks most like a code, of rectangles from the lines of two orders."""
    from pyspark.sql import Window as W

    w = W.partitionBy("pair").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").withColumn("pair", F.floor(F.col("l_orderkey") / 2)).withColumn("k", F.row_number().over(w))
    part, q = F.col("l_partkey"), F.col("l_quantity").cast("int")
    flat = q % 3 == 0
    rect = [F.col("k") * 13 + part % 3, F.when(flat, 10).otherwise(5) + part % 2, 5 + part % 5, F.when(flat, 4).otherwise(12 + q % 3)]
    rows = lines.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct(*(c.cast("int").alias(n) for c, n in zip(rect, "xywh", strict=True))))).alias("rects"))
    best = segmentation.best_sequences(rows, ["pair"])
    return best.select("pair", F.size("rects").alias("n"), F.get("rects", F.lit(0))["x"].alias("first_x"), F.element_at("rects", -1)["x"].alias("last_x"))


def region_ranking(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumn("score", (F.col("w") + F.col("h")).cast("double"))
    return ordered.ranked_regions(rows.select("l_orderkey", "x", "y", "w", "h", "score").distinct(), ["l_orderkey"], "score", 3).select("l_orderkey", "x", "y", "w", "h", "rank")


def _characters():
    return F.filter(F.split("code", ""), lambda c: c != "")


def hypothesis_ranking(spark, sf_dir):
    """Format windows of each text and the whole text, ranked by bonus."""
    texts = observations(spark, sf_dir).select("code").distinct().withColumn("n", F.length("code"))
    cut = texts.select("code", "n", F.explode(ordered.format_windows(_characters())).alias("w"))
    windows = cut.select("code", F.col("w.start").alias("start"), F.col("w.size").alias("size"), ordered.window_bonus(F.col("n"), F.col("w.size"), F.get("w.items", F.col("w.dash")) == "-").alias("score"))
    whole = texts.select("code", F.lit(-1).alias("start"), F.col("n").alias("size"), F.lit(0.0).alias("score"))
    return ordered.ranked_hypotheses(windows.unionByName(whole), ["code"], "score", "size", ["start", "size"], 5).select("code", "start", "size", F.round("score", 6).alias("score"), "rank")


def _candidates(spark, sf_dir):
    return observations(spark, sf_dir).select("pos", "expected", "code", F.length("code").alias("segments"))


def template_harvest(spark, sf_dir):
    """Characters of accepted candidates, at most so many of each."""
    accepted = ordered.harvested(_candidates(spark, sf_dir), "expected", "pos", "segments")
    letters = accepted.select("expected", F.posexplode(F.filter(F.split("expected", ""), lambda c: c != "")).alias("place", "letter"))
    return aggregates.capped_per_class(letters, "letter", ["expected", "place"], F.lit(0), most=20)


def best_debug_region(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("difference", F.abs(F.col("segments") - F.length("expected"))).withColumn("score", F.col("pos") % 89)
    return ordered.best_region(rows, ["expected"], "difference", "score", "pos").select("expected", "pos", "difference", "score")


def benchmark_cards(spark, sf_dir):
    """Labelled images by their expected number: the shortest raw id, the images and their number."""
    paths = catalogue(spark, sf_dir).select("pos", F.concat(F.lit("/scans/"), F.col("id"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("_c"), F.col("pos").cast("string"))).otherwise(""), F.lit(".png")).alias("path"))
    raw = paths.withColumn("raw", identifiers.strip_copy_suffix(identifiers.file_stem(F.col("path")))).withColumn("expected", identifiers.known_number(F.col("raw"))).where(~identifiers.blank(F.col("expected")))
    return raw.groupBy("expected").agg(F.min(F.struct(F.length("raw").alias("l"), "pos", "raw")).alias("s"), F.countDistinct(F.upper("path")).alias("images")).select("expected", F.col("s.raw").alias("display_id"), "images")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")


def centered_mean(spark, sf_dir):
    rows = ordered.centered_mean(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 1)
    two = ordered.centered_mean(rows.withColumnRenamed("smooth", "one"), ["user_id"], ["ts", "event_id"], "value", 2)
    return two.select("event_id", F.round("one", 6).alias("one"), F.round("smooth", 6).alias("two"))


def running_max(spark, sf_dir):
    return ordered.running_max(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").select("event_id", "peak")


def adjacent_gap(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return ordered.adjacent_gap(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], micros, micros).select("event_id", "gap")


def rank_labels(spark, sf_dir):
    return ordered.rank_labels(_events(spark, sf_dir), ["user_id"], [F.desc("value"), F.col("event_id")]).select("event_id", "label")


def score_margins(spark, sf_dir):
    return ordered.margins(_events(spark, sf_dir), ["user_id"], "value", [F.col("event_id")]).select("user_id", "event_id", F.round("margin", 6).alias("margin"))


def sliding_windows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"]).alias("q"))
    n = F.size("q")
    found = lines.select("l_orderkey", F.explode(ordered.windows(F.col("q"), F.greatest(F.lit(2), n - 1), n + 1)).alias("w"))
    return found.select("l_orderkey", F.col("w.start").alias("start"), F.col("w.size").alias("size"), F.round(F.aggregate("w.items", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def format_windows(spark, sf_dir):
    letters = F.filter(F.split("code", ""), lambda c: c != "")
    found = observations(spark, sf_dir).select("code").distinct().select("code", F.explode(ordered.format_windows(letters)).alias("w"))
    return found.select("code", F.col("w.start").alias("start"), F.col("w.size").alias("size"), (F.get("w.items", F.col("w.dash")) == "-").alias("dashed"))


def interleave_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey", "l_orderkey")
    ranked = ordered.rank_labels(rows, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]).withColumn("rank", F.replace("label", F.lit("."), F.lit("")).cast("int"))
    return ordered.interleave(ranked, "l_suppkey", "rank", ["l_partkey"], 36).select("l_suppkey", "rank", "l_partkey")


def distinct_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return ordered.distinct_first(rows, [F.col("o_orderstatus"), F.upper("o_orderpriority")], "o_orderkey")


def seeded_sample(spark, sf_dir):
    return ordered.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 500, 20260717, "o_orderkey")


def pick_untrained(spark, sf_dir):
    paths = table(spark, sf_dir, "orders").select(F.concat(F.lit("/scans/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"))
    return ordered.pick_untrained(paths, paths.where(F.col("path").rlike("[02468]\\.png$")), seed=7)


def cut_places(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), F.col("l_extendedprice").alias("cost")).groupBy("l_orderkey", "place").agg(F.min("cost").alias("cost"))
    one = ordered.least_in_range(rows, ["l_orderkey"], "place", "cost", F.lit(2), F.lit(5))
    two = ordered.two_cuts(rows, ["l_orderkey"], "place", "cost", apart=3)
    return one.join(two.select("l_orderkey", "first", "second"), "l_orderkey", "full")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"), F.col("embedding").alias("vector"))


def _asked_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir).where("id % 50 = 0")


def class_topk_mean(spark, sf_dir):
    found = vectors.match(_asked_vectors(spark, sf_dir).select("id", "vector"), _vectors(spark, sf_dir), 5, SPREAD)
    return found.select("id", F.col("t_class").alias("class"), F.round("score", 5).alias("score"), F.round("best", 5).alias("best"), "n")


def class_quality(spark, sf_dir):
    return vectors.class_quality(_vectors(spark, sf_dir), SPREAD).select("id", "class", F.round("quality", 5).alias("quality"))


def class_statistics(spark, sf_dir):
    found = vectors.class_statistics(vectors.class_quality(_vectors(spark, sf_dir), SPREAD))
    return found.select("class", "n", *(F.round(c, 5).alias(c) for c in ("mean", "least", "best")), "flagged", "doubtful")


def most_similar_templates(spark, sf_dir):
    return vectors.most_similar(_asked_vectors(spark, sf_dir).select("id", "vector"), _vectors(spark, sf_dir), SPREAD).select("id", "o_id", F.round("similarity", 5).alias("similarity"))


def nearest_variant(spark, sf_dir):
    return vectors.nearest_variant(_asked_vectors(spark, sf_dir), _vectors(spark, sf_dir), "class", SPREAD).select("id", "variant", F.round("similarity", 5).alias("similarity"))


def greedy_reading(spark, sf_dir):
    matches = vectors.match(_asked_vectors(spark, sf_dir).select("id", "vector"), _vectors(spark, sf_dir), 1, SPREAD)
    return vectors.greedy_read(matches.withColumn("line", (F.col("id") / 500).cast("long")).withColumn("t_class", F.col("t_class").cast("string")), "line", "id")


def ink_prefilter(spark, sf_dir):
    ink = lambda d: d.withColumn("ink", (F.col("id") % 100) / 100.0)
    found = vectors.compare(ink(_asked_vectors(spark, sf_dir)).select("id", "vector", "ink"), ink(_vectors(spark, sf_dir)), SPREAD, 0.22)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("similarity"), 5).alias("best"))


def prefix_counts(spark, sf_dir):
    """Catalogue rows by letters of their code."""
    rows = catalogue(spark, sf_dir).withColumn("letters", identifiers.letter_prefix(F.col("id")))
    return rows.groupBy("letters").agg(F.count(F.lit(1)).alias("n"))


def known_by_prefix(spark, sf_dir):
    numbers = lookups.known_numbers(catalogue(spark, sf_dir))
    return numbers.groupBy(identifiers.set_prefix(F.col("number")).alias("prefix")).agg(F.array_join(F.array_sort(F.collect_list("number")), ",").alias("numbers"))


QUERIES = {
    f.__name__: f
    for f in (median_exact, median_upper, bounding_box, component_predicates, region_scores, neighbour_iou, merged_rows, iou_suppression, segmentation_scores, best_runs, region_ranking, hypothesis_ranking, template_harvest, best_debug_region, benchmark_cards, centered_mean, running_max, adjacent_gap, rank_labels, score_margins, sliding_windows, format_windows, interleave_dedup, distinct_first, seeded_sample, pick_untrained, cut_places, class_topk_mean, class_quality, class_statistics, most_similar_templates, nearest_variant, greedy_reading, ink_prefilter, prefix_counts, known_by_prefix)
}

_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_ASPECT = "(w / greatest(1, h)::DOUBLE)"
_CLAMP = "least(greatest({}, 0.0), 100.0)".format
_SIM = f"100.0 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / len(a.embedding) / {SPREAD} * 100.0"
_PAIRS = f"pairs AS (SELECT a.vec_id AS id, b.vec_id AS o_id, b.label AS o_class, a.label AS class, {_SIM} AS s FROM embeddings a JOIN embeddings b ON {{}})"
_CLASSES = f"""{_PAIRS.format("a.vec_id % 50 = 0")}, ranked AS (SELECT *, row_number() OVER (PARTITION BY id, o_class ORDER BY s DESC, o_id) AS r, count(*) OVER (PARTITION BY id, o_class) AS n FROM pairs),
        means AS (SELECT id, o_class AS class, avg(s) AS score, max(s) AS best, max(n) AS n FROM ranked WHERE r <= 5 GROUP BY 1, 2)"""
_QUALITY = f"""{_PAIRS.format("a.label = b.label AND a.vec_id <> b.vec_id")}, q AS (SELECT id, avg(s) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, o_id) AS r FROM pairs) WHERE r <= 8 GROUP BY 1),
        quality AS (SELECT vec_id AS id, label AS class, coalesce(quality, 100.0) AS quality FROM embeddings LEFT JOIN q ON id = vec_id)"""

ORACLES = {
    "median_exact": "SELECT l_suppkey, round(median(l_quantity), 6) AS median FROM lineitem GROUP BY 1",
    "median_upper": "SELECT l_suppkey, list_extract(list_sort(list(l_quantity)), CAST(count(*) // 2 + 1 AS BIGINT)) AS upper_median FROM lineitem GROUP BY 1",
    "bounding_box": f"WITH {BOXES} SELECT l_orderkey, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY 1",
    "component_predicates": f"""WITH {BOXES}, r AS (SELECT *, {_ASPECT} AS a, w >= 3 AND h >= 2 AND {_ASPECT} BETWEEN 1.25 AND 8.0 AND h <= 5.58 AS dash FROM boxes)
        SELECT l_orderkey, l_linenumber, x, w >= 2 AND h >= 4 AND w * h >= 12 AND w <= 10 AND h <= 13.3 AND (a BETWEEN 0.05 AND 2.2 OR (a > 1.5 AND a <= 10)) AS text, dash,
        dash OR (w >= 2 AND h >= 2 AND a BETWEEN 0.85 AND 10 AND h <= 7.02) AS relaxed, CAST(CASE WHEN h < 4.95 THEN 1 WHEN w / 6.0 >= 2.35 THEN 3 WHEN w / 6.0 >= 1.48 THEN 2 ELSE 1 END AS INTEGER) AS parts FROM r""",
    "region_scores": f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, x, round({_CLAMP(f"100.0 - abs({_ASPECT} - 4.16) * 12.0")} * 0.38 + {_CLAMP("w / 120.0 * 180.0")} * 0.24
        + CASE WHEN h / 40.0 <= 0.40 THEN {_CLAMP("h / 40.0 * 260.0")} ELSE {_CLAMP("100.0 - (h / 40.0 - 0.40) * 220.0")} END * 0.16 + {_CLAMP("(y + h / 2.0) / 40.0 * 100.0")} * 0.12 + {_CLAMP("w * h / 4800.0 * 260.0")} * 0.10, 6)::DOUBLE AS score,
        round((100.0 - abs(CASE WHEN w / 20.0 > 0.5 THEN 1.0 - w / 20.0 ELSE w / 20.0 END - 0.18) * 250.0) * 0.55 + least(100.0, w * h / 20.0) * 0.20 - abs(w / greatest(1, h)::DOUBLE - 4.4) * 8.0, 6)::DOUBLE AS quality FROM boxes""",
    "neighbour_iou": f"""WITH {BOXES}, p AS (SELECT *, lead(y) OVER z AS y2, lead(w) OVER z AS w2, lead(h) OVER z AS h2 FROM boxes WINDOW z AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y, w, h)),
        i AS (SELECT *, least(w, w2) AS iw, least(y + h, y2 + h2) - greatest(y, y2) AS ih FROM p WHERE y2 IS NOT NULL)
        SELECT l_orderkey, l_linenumber, x, round(CASE WHEN iw <= 0 OR ih <= 0 THEN 0.0 ELSE (iw * ih)::DOUBLE / (w * h + w2 * h2 - iw * ih) END, 6)::DOUBLE AS iou FROM i""",
    "region_ranking": f"""WITH {BOXES}, d AS (SELECT DISTINCT l_orderkey, x, y, w, h FROM boxes)
        SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY w + h DESC, w * h, x, y, w) AS INTEGER) AS rank FROM d QUALIFY rank <= 3""",
    "hypothesis_ranking": f"""{BASE}, c AS (SELECT DISTINCT code, length(code) AS n FROM observations), s AS (SELECT code, n, unnest([5, 8, 9]) AS size, unnest([1, 4, 5]) AS dash FROM c),
        w AS (SELECT *, unnest(range(0, n - size + 1)) AS start FROM s WHERE size <= n),
        h AS (SELECT code, CAST(start AS INTEGER) AS start, CAST(size AS INTEGER) AS size, (CASE WHEN substr(code, start + dash + 1, 1) = '-' THEN 14.0 ELSE -12.0 END - (n - size) * 1.5)::DOUBLE AS score FROM w
            UNION ALL SELECT code, -1, CAST(n AS INTEGER), 0.0::DOUBLE FROM c)
        SELECT code, start, size, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY code ORDER BY score DESC, abs(size - 8), start, size) AS INTEGER) AS rank FROM h QUALIFY rank <= 5""",
    "template_harvest": f"""{BASE}, a AS (SELECT DISTINCT expected FROM observations WHERE length(code) = length(expected)), l AS (SELECT expected, unnest(range(0, length(expected))) AS place FROM a)
        SELECT expected, CAST(place AS INTEGER) AS place, substr(expected, place + 1, 1) AS letter FROM l QUALIFY row_number() OVER (PARTITION BY substr(expected, place + 1, 1) ORDER BY expected, place) <= 20""",
    "best_debug_region": f"""{BASE}, r AS (SELECT pos, expected, CAST(abs(length(code) - length(expected)) AS INTEGER) AS difference, pos % 89 AS score FROM observations)
        SELECT expected, pos, difference, score FROM r QUALIFY row_number() OVER (PARTITION BY expected ORDER BY difference, score DESC, pos) = 1""",
    "benchmark_cards": f"""{BASE}, n AS (SELECT pos, id AS raw, upper(split_part(id, '_', 1)) AS expected, '/scans/' || id || CASE WHEN pos % 2 = 0 THEN '_c' || pos ELSE '' END AS path FROM catalogue)
        SELECT expected, arg_min(raw, length(raw) * 1000000 + pos) AS display_id, count(DISTINCT upper(path)) AS images FROM n GROUP BY 1""",
    "centered_mean": f"SELECT event_id, round(avg(value) {_USER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS one, round(avg(value) {_USER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS two FROM events",
    "running_max": f"SELECT event_id, max(value) {_USER} ROWS UNBOUNDED PRECEDING) AS peak FROM events",
    "adjacent_gap": f"SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) {_USER}) AS gap FROM events",
    "rank_labels": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) || '.' AS label FROM events",
    "score_margins": """SELECT user_id, event_id, round(greatest(0.0, value - coalesce(nxt, 0.0)), 6) AS margin FROM (SELECT *, row_number() OVER z AS r, lead(value) OVER z AS nxt FROM events WINDOW z AS (PARTITION BY user_id ORDER BY value DESC, event_id)) WHERE r = 1""",
    "sliding_windows": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
        s AS (SELECT l_orderkey, unnest(range(greatest(2, n - 1), n + 1)) AS size, n FROM (SELECT DISTINCT l_orderkey, n FROM o)), w AS (SELECT *, unnest(range(0, n - size + 1)) AS start FROM s)
        SELECT w.l_orderkey, CAST(start AS INTEGER) AS start, CAST(size AS INTEGER) AS size, round(sum(l_quantity), 6) AS total FROM w JOIN o ON o.l_orderkey = w.l_orderkey AND i >= start AND i < start + size GROUP BY ALL""",
    "format_windows": f"""{BASE}, c AS (SELECT DISTINCT code FROM observations), s AS (SELECT code, unnest([5, 8, 9]) AS size, unnest([1, 4, 5]) AS dash FROM c), w AS (SELECT *, unnest(range(0, length(code) - size + 1)) AS start FROM s WHERE size <= length(code))
        SELECT code, CAST(start AS INTEGER) AS start, CAST(size AS INTEGER) AS size, substr(code, start + dash + 1, 1) = '-' AS dashed FROM w""",
    "interleave_dedup": """WITH r AS (SELECT l_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem),
        f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY rank, l_suppkey) = 1) SELECT l_suppkey, rank, l_partkey FROM f ORDER BY rank, l_suppkey LIMIT 36""",
    "distinct_first": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, upper(o_orderpriority) ORDER BY o_orderkey) = 1",
    "seeded_sample": "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':20260717'), o_orderkey LIMIT 500",
    "pick_untrained": "SELECT '/scans/' || o_orderkey || '.png' AS path FROM orders WHERE o_orderkey % 2 <> 0 ORDER BY md5('/scans/' || o_orderkey || '.png7'), path LIMIT 1",
    "cut_places": """WITH r AS (SELECT l_orderkey, l_linenumber AS place, min(l_extendedprice) AS cost FROM lineitem GROUP BY 1, 2),
        one AS (SELECT * FROM r WHERE place BETWEEN 2 AND 5 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY cost, place) = 1),
        p AS (SELECT a.l_orderkey, a.place AS first, b.place AS second, a.cost + b.cost AS c FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND b.place - a.place >= 3),
        two AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY c, first, second) = 1),
        k AS (SELECT DISTINCT l_orderkey FROM r) SELECT k.l_orderkey, place, cost, first, second FROM k LEFT JOIN one USING (l_orderkey) LEFT JOIN two USING (l_orderkey)""",
    "class_topk_mean": f"WITH {_CLASSES} SELECT id, class, round(score, 5) AS score, round(best, 5) AS best, n FROM means QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, class) <= 5",
    "class_quality": f"WITH {_QUALITY} SELECT id, class, round(quality, 5) AS quality FROM quality",
    "class_statistics": f"""WITH {_QUALITY} SELECT class, count(*) AS n, round(avg(quality), 5) AS mean, round(min(quality), 5) AS least, round(max(quality), 5) AS best,
        count(*) FILTER (quality < 65) AS flagged, count(*) FILTER (quality >= 65 AND quality < 80) AS doubtful FROM quality GROUP BY 1""",
    "most_similar_templates": f"WITH {_PAIRS.format('a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id')} SELECT id, o_id, round(s, 5) AS similarity FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, o_id) <= 15",
    "nearest_variant": f"""WITH {_PAIRS.format('a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label')}, f AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, o_id) = 1)
        SELECT vec_id AS id, o_id AS variant, round(s, 5) AS similarity FROM embeddings LEFT JOIN f ON id = vec_id WHERE vec_id % 50 = 0""",
    "greedy_reading": f"""WITH {_CLASSES}, f AS (SELECT * FROM means QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, class) = 1)
        SELECT CAST(id // 500 AS BIGINT) AS line, string_agg(CAST(class AS VARCHAR), '' ORDER BY id) AS text FROM f GROUP BY 1""",
    "ink_prefilter": f"""WITH {_PAIRS.format("a.vec_id % 50 = 0 AND abs((a.vec_id % 100) / 100.0::DOUBLE - (b.vec_id % 100) / 100.0::DOUBLE) <= 0.22::DOUBLE")},
        t AS (SELECT id, s * 0.84 + least(greatest(100.0 - abs((id % 100) / 100.0 - (o_id % 100) / 100.0) * 250.0, 0.0), 100.0) * 0.16 AS s FROM pairs) SELECT id, count(*) AS n, round(max(s), 5) AS best FROM t GROUP BY 1""",
    "prefix_counts": f"{BASE} SELECT regexp_extract(id, '^[A-Za-z]+') AS letters, count(*) AS n FROM catalogue GROUP BY 1",
    "known_by_prefix": f"{BASE} SELECT CASE WHEN instr(number, '-') > 1 THEN substr(number, 1, instr(number, '-')) END AS prefix, string_agg(number, ',' ORDER BY number) AS numbers FROM numbers GROUP BY 1",
}

#: Rectangles of an order in sequence, by x, y, w and h.
_SEQUENCE = f"{BOXES}, numbered AS (SELECT l_orderkey, {{'x': x, 'y': y, 'w': w, 'h': h}} AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY x, y, w, h) AS k FROM boxes)"
_RATIO = "({r}.w / greatest(1, {r}.h)::DOUBLE)"
_DASH = "(({r}.w >= 3 AND {r}.h >= 2 AND {ratio} BETWEEN 1.25 AND 8.0 AND {r}.h <= greatest(5.0, mh * 0.62)) OR ({r}.w >= 2 AND {r}.h >= 2 AND {ratio} BETWEEN 0.85 AND 10.0 AND {r}.h <= greatest(7.0, mh * 0.78)))"
_GAP = "rects[i].x - rects[i - 1].x - rects[i - 1].w"


def _dash_sql(r):
    return _DASH.format(r=r, ratio=_RATIO.format(r=r))


def _total(expression, of):
    return f"coalesce(list_sum([({expression})::DOUBLE for {of}]), 0.0)"


_R = _RATIO.format(r="r")
_BETWEEN = "i in range(2, len(rects) + 1)"
ORACLES |= {
    "merged_rows": f"""WITH RECURSIVE {_SEQUENCE}, fold AS (
        SELECT l_orderkey, k, [r] AS done FROM numbered WHERE k = 1
        UNION ALL SELECT n.l_orderkey, n.k, CASE WHEN n.r.x - f.done[-1].x - f.done[-1].w <= 1
                AND least(f.done[-1].y + f.done[-1].h, n.r.y + n.r.h) - greatest(f.done[-1].y, n.r.y) > least(f.done[-1].h, n.r.h) * 0.45
            THEN list_append(f.done[1:len(f.done) - 1], {{'x': least(f.done[-1].x, n.r.x), 'y': least(f.done[-1].y, n.r.y),
                'w': greatest(f.done[-1].x + f.done[-1].w, n.r.x + n.r.w) - least(f.done[-1].x, n.r.x), 'h': greatest(f.done[-1].y + f.done[-1].h, n.r.y + n.r.h) - least(f.done[-1].y, n.r.y)}})
            ELSE list_append(f.done, n.r) END FROM fold f JOIN numbered n ON n.l_orderkey = f.l_orderkey AND n.k = f.k + 1),
        last AS (SELECT * FROM fold QUALIFY k = max(k) OVER (PARTITION BY l_orderkey)),
        parts AS (SELECT l_orderkey, k, unnest(range(1, len(done) + 1)) AS i, done FROM last)
        SELECT l_orderkey, CAST(k AS INTEGER) AS before, CAST(i - 1 AS INTEGER) AS place, done[i].x AS x, done[i].y AS y, done[i].w AS w, done[i].h AS h FROM parts""",
    "iou_suppression": f"""WITH RECURSIVE {_SEQUENCE}, moved AS (SELECT l_orderkey, {{'x': r.x % 9, 'y': r.y, 'w': r.w, 'h': r.h}} AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY r.w * r.h, k) AS k FROM numbered),
        shared AS (SELECT a.l_orderkey, a.k AS kept, b.k AS later, greatest(least(a.r.x + a.r.w, b.r.x + b.r.w) - greatest(a.r.x, b.r.x), 0) * greatest(least(a.r.y + a.r.h, b.r.y + b.r.h) - greatest(a.r.y, b.r.y), 0) AS common,
            a.r.w * a.r.h + b.r.w * b.r.h AS areas FROM moved a JOIN moved b ON a.l_orderkey = b.l_orderkey AND a.k < b.k),
        clash AS (SELECT l_orderkey, later, list(kept) AS with_kept FROM shared WHERE common > 0 AND common::DOUBLE / (areas - common) >= 0.6 GROUP BY ALL),
        fold AS (SELECT l_orderkey, k, [k] AS kept FROM moved WHERE k = 1
            UNION ALL SELECT m.l_orderkey, m.k, CASE WHEN list_has_any(f.kept, coalesce(c.with_kept, [])) THEN f.kept ELSE list_append(f.kept, m.k) END
            FROM fold f JOIN moved m ON m.l_orderkey = f.l_orderkey AND m.k = f.k + 1 LEFT JOIN clash c ON c.l_orderkey = m.l_orderkey AND c.later = m.k),
        last AS (SELECT l_orderkey, unnest(kept) AS k FROM fold QUALIFY fold.k = max(fold.k) OVER (PARTITION BY l_orderkey))
        SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS INTEGER) AS place, r.x AS x, r.y AS y, r.w AS w, r.h AS h FROM last JOIN moved USING (l_orderkey, k)""",
    "segmentation_scores": f"""WITH {_SEQUENCE}, lists AS (SELECT l_orderkey, list(r ORDER BY k) AS rects, CAST(count(*) AS INTEGER) AS n FROM numbered GROUP BY 1),
        h AS (SELECT *, list_median([x.h for x in rects])::DOUBLE AS mh FROM lists),
        m AS (SELECT *, coalesce(list_median([x.w for x in rects if x.h >= mh * 0.60])::DOUBLE, 0.0) AS mw FROM h),
        g AS (SELECT *, CASE WHEN n = 5 THEN 26.0 WHEN n = 8 THEN 34.0 WHEN n = 9 THEN 32.0 WHEN n IN (6, 7, 10) THEN 6.0 ELSE -18.0 END::DOUBLE AS number,
            {_total(f"-least(18.0, abs(r.h - mh) / mh * 13.0) - CASE WHEN {_R} < 0.04 OR {_R} > 2.70 THEN 14.0 ELSE 0.0 END", "r in rects")} AS shapes,
            {_total(f"CASE WHEN {_GAP} > mh * 0.95 THEN -22.0 WHEN {_GAP} < mh * -0.22 THEN -12.0 ELSE 0.0 END", _BETWEEN)} AS gaps,
            rects[CASE n WHEN 5 THEN 2 WHEN 8 THEN 5 WHEN 9 THEN 6 ELSE 99 END] AS d,
            (list_max([r.x + r.w for r in rects]) - list_min([r.x for r in rects])) / 110.0::DOUBLE AS share,
            CASE WHEN mw > 0 THEN len([1 for r in rects if r.w > mw * 2.25 AND NOT {_dash_sql("r")}]) * -10.0 ELSE 0.0 END::DOUBLE AS wide FROM m),
        o AS (SELECT *, rects[2:] AS others, coalesce(nullif(list_median([r.h for r in rects[2:]])::DOUBLE, 0.0), 8.0) AS oh FROM g)
        SELECT l_orderkey,
            round(number + shapes + gaps + CASE WHEN d IS NULL THEN 0.0 WHEN {_dash_sql("d")} THEN 30.0 ELSE -20.0 END + CASE WHEN share < 0.20 THEN -15.0 WHEN share > 0.98 THEN -8.0 ELSE least(12.0, share * 16.0) END + wide, 6)::DOUBLE + 0.0::DOUBLE AS geometry,
            round(100.0 + {_total(f"-abs(r.h - oh) / greatest(1.0, oh) * 24.0 - CASE WHEN {_R} < 0.05 OR {_R} > 1.45 THEN 18.0 ELSE 0.0 END", "r in others")}
                + {_total(f"CASE WHEN {_GAP} > oh * 0.90 THEN -35.0 WHEN {_GAP} < oh * -0.20 THEN -15.0 ELSE 0.0 END", _BETWEEN)}
                - abs(rects[1].y + rects[1].h / 2.0 - coalesce(list_sum([(r.y + r.h / 2.0)::DOUBLE for r in others]) / nullif(len(others), 0), rects[1].y + rects[1].h / 2.0)) / greatest(1.0, oh) * 20.0, 6)::DOUBLE + 0.0::DOUBLE AS sequence,
            round({_total(f"CASE WHEN r.h / greatest(1.0, rects[1].h) < 0.55 OR r.h / greatest(1.0, rects[1].h) > 1.65 OR {_R} > 1.55 THEN 4.0 ELSE -2.0 END", "r in list_concat(rects[1:1], rects[4:])")}, 6)::DOUBLE + 0.0::DOUBLE AS discarded
        FROM o""",
    "best_runs": f"""WITH lines AS (SELECT CAST(floor(l_orderkey / 2) AS BIGINT) AS pair, l_partkey AS p, CAST(floor(l_quantity) AS INTEGER) AS q,
            row_number() OVER (PARTITION BY floor(l_orderkey / 2) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS k FROM lineitem WHERE l_orderkey IS NOT NULL),
        lists AS (SELECT pair, list({{'x': CAST(k * 13 + p % 3 AS INTEGER), 'y': CAST(CASE WHEN q % 3 = 0 THEN 10 ELSE 5 END + p % 2 AS INTEGER), 'w': CAST(5 + p % 5 AS INTEGER), 'h': CASE WHEN q % 3 = 0 THEN 4 ELSE 12 + q % 3 END}} ORDER BY k) AS whole, CAST(count(*) AS INTEGER) AS n FROM lines GROUP BY 1),
        m AS (SELECT *, coalesce(nullif(list_median([r.h for r in whole if {_R} <= 1.30])::DOUBLE, 0.0), list_median([r.h for r in whole])::DOUBLE) AS mh FROM lists),
        kinds AS (SELECT * FROM (VALUES (9, 6), (8, 5), (5, 2)) AS t(size, dash)),
        starts AS (SELECT *, unnest(range(0, n - size + 1)) AS start FROM m JOIN kinds ON size <= n AND (size = 8 OR (size = 9 AND n = 9) OR (size = 5 AND n <= 6))),
        runs AS (SELECT *, whole[start + 1:start + size] AS rects, whole[start + dash] AS d, list_concat(whole[1:start], whole[start + size + 1:]) AS rest FROM starts),
        o AS (SELECT *, list_concat(rects[1:dash - 1], rects[dash + 1:]) AS others FROM runs WHERE {_dash_sql("d")}),
        h AS (SELECT *, coalesce(nullif(list_median([r.h for r in others])::DOUBLE, 0.0), mh) AS oh FROM o),
        scored AS (SELECT pair, size, start, rects, 100.0 + {_total(f"-abs(r.h - oh) / greatest(1.0, oh) * 24.0 - CASE WHEN {_R} < 0.05 OR {_R} > 1.45 THEN 18.0 ELSE 0.0 END", "r in others")}
            + {_total(f"CASE WHEN {_GAP} > oh * 0.90 THEN -35.0 WHEN {_GAP} < oh * -0.20 THEN -15.0 ELSE 0.0 END", _BETWEEN)}
            - abs(d.y + d.h / 2.0 - list_sum([(r.y + r.h / 2.0)::DOUBLE for r in others]) / len(others)) / greatest(1.0, oh) * 20.0
            + CASE size WHEN 9 THEN 20.0 WHEN 5 THEN (n - 5) * -4.0 ELSE (n - 8) * -2.5 + CASE WHEN n = 8 THEN 18.0 ELSE 0.0 END
                + {_total(f"CASE WHEN r.h / greatest(1.0, mh) < 0.55 OR r.h / greatest(1.0, mh) > 1.65 OR {_R} > 1.55 THEN 4.0 ELSE -2.0 END", "r in rest")} END AS score FROM h),
        best AS (SELECT * FROM scored WHERE score >= 38.0 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY round(score, 9) DESC, size DESC, start) = 1)
        SELECT pair, CAST(len(chosen) AS INTEGER) AS n, chosen[1].x AS first_x, chosen[-1].x AS last_x FROM (SELECT l.pair, coalesce(b.rects, l.whole) AS chosen FROM lists l LEFT JOIN best b ON b.pair = l.pair)""",
}
