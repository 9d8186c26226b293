"""Lookups, ranks and reductions on small cases with nulls, ties and empty tables."""

import pytest
from larkspur.functions import identifiers as ids
from larkspur.operators import evaluation, images, lookups, matching, ordered
from larkspur.sources import readers, writers
from pyspark.sql import functions as F

CARDS = [(1, "OP01-001", "R"), (2, "op01-001", "C"), (3, "OP01-001_p1", "R"), (4, "ST01-002", None), (5, " ", "R"), (6, None, "R")]


def cards(spark, rows=CARDS):
    return spark.createDataFrame(rows, "pos long, id string, rarity string")


def test_lookups(spark):
    asked = spark.createDataFrame([("op01-001", "c"), ("ST01-002", "x"), ("ZZ", "R"), (None, None)], "code string, wanted_rarity string")
    assert sorted(r.pos for r in lookups.exact_lookup(asked, cards(spark)).collect()) == [1, 2, 4]
    assert sorted(r.pos for r in lookups.variants_lookup(asked, cards(spark)).collect()) == [1, 2, 3, 4]
    found = {r.code: (r.n_matches, r.match_id) for r in lookups.cascade_match(asked, cards(spark)).collect()}
    assert found == {"op01-001": (2, "op01-001"), "ST01-002": (1, "ST01-002"), "ZZ": (0, None), None: (0, None)}
    prefix = spark.createDataFrame([("OP",), ("op01-001_",), ("st01-0",)], "code string")
    assert {r.code: r.pos for r in lookups.exact_preferred_prefix(prefix, cards(spark)).collect()} == {"OP": 1, "op01-001_": 3, "st01-0": 4}


def test_corrections(spark):
    asked = spark.createDataFrame([("OP01-0O1",), ("OP01-101",), ("XX",), (" ",), (None,), ("op01_00l",), ("ST01-00",)], "code string")
    got = {r.code: r.corrected for r in lookups.correct_codes(asked, cards(spark)).collect()}
    assert got == {"OP01-0O1": "OP01-001", "OP01-101": "OP01-001", "XX": "XX", " ": " ", None: None, "op01_00l": "OP01-001", "ST01-00": "ST01-002"}


def test_empty_tables(spark):
    none = cards(spark, [])
    asked = spark.createDataFrame([("A",)], "code string")
    assert lookups.nearest_number(asked, lookups.known_numbers(none)).count() == 0
    assert lookups.cascade_match(asked.withColumn("wanted_rarity", F.lit("R")), none).first().n_matches == 0
    assert lookups.correct_codes(asked, none).first().corrected == "A"
    rows = spark.createDataFrame([], "expected string, greedy string, text string, segment_count int, is_usable boolean, margin double")
    summary = evaluation.accuracy_summary(rows).first()
    assert (summary.tested, summary.accuracy, summary.character_accuracy) == (0, 0.0, 0.0)


def test_slots(spark):
    boxes = spark.createDataFrame([("B", 2, True), ("A", 1, False), ("C", 0, True)], "code string, capacity int, is_active boolean")
    taken = spark.createDataFrame([("b", 1), (None, 2)], "container_code string, slot_number int")
    assert lookups.require_slot(boxes, taken) == ("B", 2)
    full = spark.createDataFrame([("b", 1), ("B", 2)], "container_code string, slot_number int")
    with pytest.raises(LookupError):
        lookups.require_slot(boxes, full)


def test_failure_classes_and_effect(spark):
    rows = [
        ("P-030", "P-030", "P-030", 5, True, 9.0),  # right
        ("P-030", "x", "P-030", 5, False, 9.0),
        ("P-030", "P-03", "P-031", 4, True, 9.0),
        ("P-030", "P-0300", "P-031", 6, True, 9.0),
        ("P-030", "P-030", "P-031", 5, True, 9.0),
        ("P-030", "P-O30", "S-030", 5, True, 9.0),
        ("P-030", "P-O30", "P-031", 5, True, 9.0),
        ("P-03A", "P-O3A", "P-03B", 5, True, 9.0),
        ("P-03A", "P-O3A", "P-13B", 5, True, 1.0),
        ("P-03A", "P-O3A", "P-13B", 5, True, 9.0),
    ]
    df = spark.createDataFrame(rows, "expected string, greedy string, text string, segment_count int, is_usable boolean, margin double")
    got = {r.failure for r in evaluation.classified(df).collect()}
    assert got == {"SegmentationFailed", "TooFewSegments", "TooManySegments", "DatabaseWrongDecision", "PrefixMismatch", "DigitMismatch", "LetterMismatch", "LowConfidence", "MixedMismatch"}
    e = evaluation.database_effect(df).first()
    assert e.tested == e.corrected + e.worsened + e.unchanged_right + e.unchanged_wrong + e.segmentation_failures == 10
    assert evaluation.accuracy_summary(df).first().correct == e.corrected + e.unchanged_right
    pairs = evaluation.character_pairs(df)
    assert pairs.count() == sum(max(len(r[0]), len(r[2])) for r in rows if r[4])


def test_tolerant_fold(spark):
    rows = [("g", 1, True, 50.0, 0, 90.0, 10.0, 1.0, "a"), ("g", 2, True, 50.3, 1, 99.0, 99.0, 99.0, "b"), ("g", 3, True, 50.2, 0, 90.1, 20.0, 0.0, "c"), ("h", 1, False, 0.0, 0, 0.0, 0.0, 5.0, "d"), ("h", 2, True, 0.0, 9, 0.0, 0.0, 0.0, "e")]
    df = spark.createDataFrame(rows, "g string, o int, usable boolean, global_score double, length_difference int, database double, geometry double, image double, name string")
    assert {r.g: r.best.name for r in matching.best_candidate(df, "g", "o").collect()} == {"g": "c", "h": "e"}


def test_identifiers(spark):
    df = spark.createDataFrame([("0P01-O23",), ("P 03O",), ("PRB01—0l1",), ("nothing",), (None,)], "raw string")
    assert [r.c for r in df.select(ids.extract_code(F.col("raw")).alias("c")).collect()] == ["OP01-023", "P-030", "PRB01-011", None, None]
    blank = spark.createDataFrame([("  \t",), ("x",), (None,)], "x string")
    assert [r.b for r in blank.select(ids.blank(F.col("x")).alias("b")).collect()] == [True, False, True]


def test_sample_and_interleave(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    a, b = ([r.k for r in ordered.seeded_sample(df, 10, 7, "k").collect()] for _ in range(2))
    assert a == b and len(set(a)) == 10
    assert ordered.seeded_sample(df, None, 7, "k").count() == ordered.seeded_sample(df, 99, 7, "k").count() == 50


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('[{"ID": "A-1", "Name": "one", "Colors": ["Red", "Blue"], "Cost": 3, "more": {"x": 1}}, {"id": " "}, {"name": "no id"}]')
    (tmp_path / "sub" / "b.json").write_text('{"id": "B-1", "pack_id": "p", "img_full_url": "u", "power": null}')
    (tmp_path / "c.json").write_text("7")
    (tmp_path / "d.json").write_text('{"id": "broken"')
    got = {r.id: r for r in readers.read_catalogue(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"A-1", "B-1"}
    assert got["A-1"].colors == ["Red", "Blue"] and got["A-1"].cost == 3 and got["B-1"].pack_id == "p" and got["B-1"].power is None
    assert readers.read_catalogue(spark, f"file://{tmp_path}/none").count() == 0


def test_file_listing_and_sinks(spark, tmp_path):
    for name in ("x.PNG", "x.jpg", "y.gif", "z.webp"):
        (tmp_path / name).write_bytes(b"0")
    assert {r.stem: r.path.rsplit("/")[-1] for r in readers.image_index(spark, f"file://{tmp_path}").collect()} == {"x": "x.PNG", "z": "z.webp"}
    rows = spark.createDataFrame([("VCV-000041", "B")], "inventory_id string, failure string")
    writers.append_rows(rows, f"file://{tmp_path}/items")
    writers.append_rows(rows, f"file://{tmp_path}/items")
    assert spark.read.parquet(f"file://{tmp_path}/items").count() == 2
    assert readers.last_number(rows) == 41
    writers.write_failures(rows, f"file://{tmp_path}/failures")
    writers.write_report({"one": rows}, f"file://{tmp_path}/report")
    writers.append_lines(rows.select("inventory_id"), f"file://{tmp_path}/lines")
    assert spark.read.json(f"file://{tmp_path}/report/one").count() == 1
    assert (tmp_path / "failures" / "failure=B").is_dir()


def test_images(spark):
    import numpy as np

    image = np.full((30, 60), 250, np.uint8)
    image[8:22, 6:12] = 5
    image[8:22, 30:50] = 5
    assert images.components(image) == [(6, 8, 6, 14), (30, 8, 20, 14)]
    assert 5 <= images.otsu(image) < 250
    g = images.glyph(image)
    assert g.shape == (56, 40) and g.max() == 255
    assert images.signature(image).startswith("60x30:") and len(images.signature(image)) == 6 + 384
    assert images.preprocess(image).shape == (30 * 3 + 22, 60 * 3 + 24)
    ink = np.zeros((10, 21), bool)
    ink[:, :9] = ink[:, 12:] = True
    assert images.split_places(ink, 2) == [10]
    df = spark.createDataFrame([("a", 60, 30, bytearray(image.tobytes()))], images.IMAGE)
    assert images.map_images(df, images.glyph).first().height == 56
    assert images.crops(df).count() == 0  # too small to crop
    wide = spark.createDataFrame([("b", 1039, 744, bytearray(1039 * 744))], images.IMAGE)
    assert {(r.id, r.width, r.height) for r in images.crops(wide).collect()} == {("b/tight", 115, 28), ("b/normal", 141, 39), ("b/wide", 167, 51)}
    assert images.crops(wide, images.COARSE_CROPS).count() == 5
    rows = images.text_rows([(0, 0, 5, 10), (8, 1, 5, 10), (16, 0, 5, 9), (0, 40, 5, 10), (8, 41, 5, 10)])
    assert rows == [[(0, 0, 5, 10), (16, 0, 5, 9), (8, 1, 5, 10)]]
    assert images.row_regions(rows[0], 3, 100, 50) == [(0, 0, 26, 15), (0, 0, 31, 15), (0, 0, 31, 15)]
    y, x = np.mgrid[-20:20, -20:20]
    star = np.where(np.hypot(x, y) < 8 + 5 * np.cos(5 * np.arctan2(y, x)), 255, 0).astype(np.uint8)
    assert images.has_star(star) and not images.has_star(np.zeros((40, 40), np.uint8))
    assert images.distinct_images(df.unionByName(df.replace("a", "b", "id"))).first().id == "a"
    assert images.map_values(df, images.signature, "string").first().value == images.signature(image)


def test_blocks_meet_every_pair(spark):
    """A right side beyond the bound is met in blocks: the pairs are those of a plain comparison."""
    from larkspur.operators import blocks

    left = spark.range(7).selectExpr("id AS a")
    right = spark.range(50).selectExpr("id AS b")
    for most in (3, 1000):
        got = blocks.met(left, right, F.col("a") * 5 < F.col("b"), most, "b")
        assert sorted((r.a, r.b) for r in got.collect()) == [(a, b) for a in range(7) for b in range(50) if a * 5 < b]


def test_prefixes_of_any_length(spark):
    from larkspur.operators import lookups

    ids = ["AB-1", "abc", "A", "", "b", "ABCD"]
    catalogue = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    asked = spark.createDataFrame([(x,) for x in ("", "a", "ab", "abc", "abcd", "zz", "b")], "code string")
    plan = lookups.prefix_lookup(asked, catalogue)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = sorted((r.code, r.id) for r in lookups.prefix_lookup(asked, catalogue).collect())
    assert got == sorted((q, i) for q in ("", "a", "ab", "abc", "abcd", "zz", "b") for i in ids if i.lower().startswith(q))


def test_nearest_number_is_the_nearest(spark, monkeypatch):
    """Against all pairs, for texts of all distances, with few and with many numbers for a broadcast."""
    import random

    from larkspur.operators import lookups

    rng = random.Random(3)
    numbers = sorted({"".join(rng.choices("AB01-", k=rng.randrange(1, 9))) for _ in range(60)} | {"X" * 30, "X" * 27})
    texts = sorted({"".join(rng.choices("AB01-Z", k=rng.randrange(1, 12))) for _ in range(80)} | {"X" * 28 + "Y", "X" * 25, "X" * 24, "Q" * 30})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    want = {t: min((distance(t, n), abs(len(t) - len(n)), n) for n in numbers) for t in texts}
    for most in (200_000, 10):
        monkeypatch.setattr(lookups, "MAX_BROADCAST_KEYS", most)
        found = lookups.nearest_number(spark.createDataFrame([(t,) for t in texts], "code string"), spark.createDataFrame([(n,) for n in numbers], "number string"))
        assert {r.code: (r.distance, r.number) for r in found.collect()} == {t: (d, n) for t, (d, _, n) in want.items()}


def test_nearest_variant_skips_those_without_a_vector(spark):
    from larkspur.operators import vectors

    rows = [(1, 0, [1.0, 0.0]), (2, 0, None), (3, 0, [0.0, 1.0]), (4, 1, [1.0, 0.0]), (5, 2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "id long, class int, vector array<double>")
    got = {r.id: r.variant for r in vectors.nearest_variant(df.where("id IN (1, 4)"), df, "class", 2.0).collect()}
    assert got == {1: 3, 4: None}


def test_grey_images_are_read(spark, tmp_path):
    """PNG files in grey and in colour."""
    import struct
    import zlib

    from larkspur.sources import readers

    def png(width, height, kind, data, channels):
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        rows = b"".join(b"\0" + data[k * width * channels : (k + 1) * width * channels] for k in range(height))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    (tmp_path / "grey.png").write_bytes(png(3, 2, 0, bytes([0, 50, 100, 150, 200, 250]), 1))
    (tmp_path / "colour.png").write_bytes(png(2, 1, 2, bytes([255, 0, 0, 0, 0, 255]), 3))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r.id.rpartition("/")[2]: (r.width, r.height, list(r.pixels)) for r in readers.read_grey(spark, f"file://{tmp_path}").collect()}
    assert got == {"grey.png": (3, 2, [0, 50, 100, 150, 200, 250]), "colour.png": (2, 1, [76, 29])}


def test_database_tables_are_read(spark, tmp_path):
    """Through JDBC, from the database that comes with Spark, in order of a column."""
    from larkspur.sources import readers

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "id int, name string").write.format("jdbc").options(url=url, dbtable="cards").save()
    got = readers.read_table(spark, {"url": url, "dbtable": "cards"}, "id")
    assert [tuple(r) for r in got.collect()] == [(1, "a"), (2, None), (3, "c")]


def _qualities(spark, rows):
    from larkspur.operators import vectors

    df = spark.createDataFrame(rows, "id long, class int, vector array<double>")
    found = vectors.class_quality(df, 2.0, k=3)
    return found, {(r.id, r["class"], repr(r.quality)) for r in found.collect()}


def test_class_quality_moves_no_pairs(spark):
    """The best of each tile are taken where it is compared: no rank over pairs, whatever their number."""
    found, got = _qualities(spark, [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 1, [1.0, 1.0])])
    assert "Window" not in found._jdf.queryExecution().toString()
    assert got == {(1, 0, "75.0"), (2, 0, "75.0"), (3, 1, "100.0")}


def test_class_quality_of_odd_vectors_in_tiles(spark, monkeypatch):
    """Against plain Python: tiles of a large class, repeated ids, other lengths, missing places, NaN and infinity."""
    import math
    import random

    from larkspur.operators import vectors

    rng = random.Random(7)
    rows = [(i, i % 2, [rng.choice((-1.0, -0.5, 0.0, 0.25, 1.0)) for _ in range(5)]) for i in range(60)]
    rows += [(3, 1, [1.0] * 5), (60, 0, None), (61, 0, []), (62, 0, []), (63, 0, [1.0, None]), (64, 0, [1.0, 2.0]), (65, None, [1.0] * 5), (None, 0, [1.0] * 5), (66, 3, [1.0] * 5)]
    rows += [(70, 4, [math.nan, 1.0]), (71, 4, [0.0, 1.0]), (72, 5, [math.inf, 0.0]), (73, 5, [1.0, 0.0]), (74, 5, [math.inf, 1.0])]

    def similarity(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return None
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += abs(x - y)
        return 100.0 - total / len(a) / 2.0 * 100.0

    want = set()
    for i, own, _ in rows:
        near = [similarity(a, b) for x, c, a in rows if x == i and i is not None and c is not None for y, d, b in rows if d == c and y is not None and y != x]
        best = sorted((s for s in near if s is not None), key=lambda s: (not math.isnan(s), -s))[:3]
        total = 0.0
        for s in best:
            total += s
        want.add((i, own, repr(total / len(best) if best else 100.0)))
    for most in (4000, 8):
        monkeypatch.setattr(vectors, "CLASS_ROWS", most)
        assert _qualities(spark, rows)[1] == want


def test_class_statistics_of_repeated_and_empty_vectors(spark):
    """Copies are each other's nearest; a class of empty vectors counts as one of only ones; no pair is ranked."""
    from larkspur.operators import vectors

    kind = "id long, class int, vector array<double>"
    rows = [(i, 0, [1.0, 0.0]) for i in range(9)] + [(20, 1, [0.0, 0.0]), (21, 1, [2.0, 2.0]), (30, 2, []), (31, 2, [])]
    found = vectors.class_statistics(vectors.class_quality(spark.createDataFrame(rows, kind), 2.0))
    assert "Window" not in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.collect()} == {(0, 9, 100.0, 100.0, 100.0, 0, 0), (1, 2, 0.0, 0.0, 0.0, 2, 0), (2, 2, 100.0, 100.0, 100.0, 0, 0)}
    assert vectors.class_statistics(vectors.class_quality(spark.createDataFrame([], kind), 2.0)).count() == 0


def _tile(places, ids=None, parts=1):
    """A table of a tile's vectors, and the least distances of each to the others (of the other part, if there are two), in plain order."""
    import numpy as np
    import pyarrow as pa

    ids, part = np.arange(len(places)) if ids is None else ids, np.arange(len(places)) % parts
    total = np.zeros((len(places), len(places)))
    with np.errstate(invalid="ignore", over="ignore"):
        for x in places.T:
            total += np.abs(x[:, None] - x[None, :])
    total[np.isnan(total)] = -np.inf
    total[(ids[:, None] == ids[None, :]) | ((parts > 1) & (part[:, None] == part[None, :]))] = np.nan
    return pa.table({"id": ids, "part": part, "alone": [parts == 1] * len(places), "vector": pa.array(list(places), pa.list_(pa.float64()))}), np.sort(total, axis=1)


@pytest.mark.parametrize("kind", ["plain", "whole", "copies", "one far", "offset", "huge", "tiny", "equal", "odd", "long", "repeated ids"])
@pytest.mark.parametrize("parts", [1, 2])
def test_tiles_lose_nothing_by_rounding(kind, parts):
    """The same doubles as all distances give, over several blocks of a tile."""
    import numpy as np

    from larkspur.operators import vectors

    rng = np.random.default_rng(5)
    places, ids = rng.normal(size=(30 if kind == "long" else 2700, 700 if kind == "long" else 6)), None
    if kind == "whole":
        places = np.rint(places * 3)
    elif kind == "copies":
        places[::2] = places[0]
        places[1::10] = places[1]
    elif kind == "one far":
        places[7, 2] = 1e12
    elif kind == "offset":
        places = 1e9 + places * 1e-6
    elif kind == "huge":
        places *= 2e307
    elif kind == "tiny":
        places *= 5e-323
    elif kind == "equal":
        places[:] = 0.1
    elif kind == "odd":
        places[::300, 0], places[1::400, 1], places[5, 1] = np.nan, np.inf, -np.inf
    elif kind == "repeated ids":
        ids = np.arange(len(places)) // (4 * parts) * parts + np.arange(len(places)) % parts
    table, want = _tile(places, ids, parts)
    found = vectors._nearest_in_tile(8, 2.0)(table)
    assert found.column("id").to_pylist() == table.column("id").to_pylist()
    with np.errstate(over="ignore"):
        similarity = 100.0 - want[:, :8] / places.shape[1] / 2.0 * 100.0
    similarity[np.isneginf(want[:, :8])] = np.inf  # in place of NaN, which does not equal itself
    there = ~np.isnan(want[:, :8])
    got = [[np.inf if np.isnan(x) else x for x in row] for row in found.column("best").to_pylist()]
    assert got == [list(row[some]) for row, some in zip(similarity, there, strict=True)]


def test_tiles_round_before_they_compare():
    """Most pairs are dropped by rounded distances, in well under the time that all distances take (as of vectors with an infinity)."""
    import time

    import numpy as np

    from larkspur.operators import vectors

    places, run, took = np.random.default_rng(6).normal(size=(2500, 64)), vectors._nearest_in_tile(8, 2.0), []
    for first in (0.0, np.inf):
        places[:, 0] = first
        table, times = _tile(places[:, :1])[0].select(["id", "part", "alone"]).append_column("vector", [list(places)]), []
        for _ in range(3):
            began = time.perf_counter()
            run(table)
            times.append(time.perf_counter() - began)
        took.append(min(times))
    assert took[0] < 0.7 * took[1]


def test_class_quality_of_few_ids_in_many_parts(spark, monkeypatch):
    """Parts without vectors: a pair counts once, where all rows of a class have a few ids."""
    from larkspur.operators import vectors

    monkeypatch.setattr(vectors, "CLASS_ROWS", 8)
    rows = [(i % 12, 0, [i * i / 8.0, i / 2.0]) for i in range(60)]
    want = set()
    for own in range(12):
        best = sorted((100.0 - (abs(a[0] - b[0]) + abs(a[1] - b[1])) / 2 / 2.0 * 100.0 for i, _, a in rows if i == own for j, _, b in rows if j != own), reverse=True)[:3]
        want.add((own, 0, repr((best[0] + best[1] + best[2]) / 3)))
    assert _qualities(spark, rows)[1] == want


def test_tiles_are_dealt_over_tasks(spark, monkeypatch):
    """To as many partitions as there are tiles, which are not put together by their bytes."""
    from larkspur.operators import vectors

    monkeypatch.setattr(vectors, "CLASS_ROWS", 8)
    rows = [(i, 0, [float(i), i % 7 / 2]) for i in range(30)]
    found, _ = _qualities(spark, rows)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert vectors.class_statistics(found).first()["n"] == 30


def test_lookups_of_ids_with_many_rows_spread_over_tasks(spark, monkeypatch):
    """Every query meets every row of its id, and no task gives them all."""
    monkeypatch.setattr(lookups, "LISTED_ROWS", 8, raising=False)
    rows = [(k, ("OP01-001", "op01-001", "ST01-002", "X", None)[k % 5], None if k % 3 else "R") for k in range(200)] + [(777, "Y", "R")]
    codes = ["OP01-001", "op01-001", "st01-002", "Y", "ZZ", None] * 20
    asked = spark.createDataFrame(list(enumerate(codes)), "asked long, code string").coalesce(1)
    found = lookups.exact_lookup(asked, cards(spark, rows).coalesce(1))
    assert found.columns == ["asked", "code", "pos", "id", "rarity"]
    got = sorted(map(repr, map(tuple, found.collect())))
    assert got == sorted(repr((a, c, *row)) for a, c in enumerate(codes) for row in rows if c and row[1] and c.upper() == row[1].upper())
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < sum(sizes) * 0.75
