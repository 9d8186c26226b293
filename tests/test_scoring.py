"""Scores against plain Python on small cases."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from larkspur.functions import geometry, scoring
from pyspark.sql import functions as F


def dp(lattice, code, missing=28.0, extra=16.0):
    row = [-missing * j for j in range(len(code) + 1)]
    for seg in lattice:
        new = [row[0] - extra]
        for j, ch in enumerate(code, 1):
            new.append(max(row[j] - extra, new[-1] - missing, row[j - 1] + seg.get(ch, 18.0)))
        row = new
    return min(max(row[-1] / (100.0 * len(code)) * 100.0, 0.0), 100.0) if code else 0.0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def window(text, code, more):
    t, c = text.upper(), code.upper()
    if not t.strip() or not c.strip():
        return 0.0
    if c in t:
        return 100.0
    best = 0.0
    for k in range(max(1, len(c) - 2), min(len(t), len(c) + more) + 1):
        for i in range(len(t) - k + 1):
            best = max(best, 100.0 * (1 - lev(t[i : i + k], c) / max(k, len(c))))
    return best


def test_known_values(spark):
    lattice = F.array(*(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in ({"P": 95.0}, {"-": 90.0}, {"O": 80.0, "0": 70.0}, {"3": 88.0})))
    row = spark.range(1).select(scoring.alignment(lattice, F.lit("P-030")).alias("a"), scoring.window_similarity(F.lit("XOP01-0O1Z"), F.lit("OP01-001")).alias("w")).first()
    assert row.a == pytest.approx(63.0)
    assert row.w == pytest.approx(87.5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.dictionaries(st.sampled_from("P-0OA1"), st.floats(0, 100).map(lambda x: round(x, 2)), max_size=3), max_size=5), st.text("P-0OA1", max_size=5), st.text("P-0OA1b ", max_size=7)), min_size=1, max_size=12))
def test_scores_match_plain_python(spark, cases):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, lattice array<map<string,double>>, code string, text string")
    got = df.select("k", scoring.alignment(F.col("lattice"), F.col("code")).alias("a"), scoring.window_similarity(F.col("text"), F.col("code"), 3).alias("w")).collect()
    for r in got:
        lattice, code, text = cases[r.k]
        assert r.a == pytest.approx(dp(lattice, code)), (lattice, code)
        assert r.w == pytest.approx(window(text, code, 3)), (text, code)


def test_profiles_are_complete():
    assert set(scoring.PROFILES) == {"core", "engine", "benchmark", "live", "recovery"}


RECTS = "array<struct<x:int,y:int,w:int,h:int>>"


def plain_iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return 0.0 if w <= 0 or h <= 0 else w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_suppression_and_merging(spark):
    rects = [(x, y, w, h) for x, y, w, h in itertools.product((0, 1, 9), (0, 1), (5, 6), (4, 5))]
    kept = []
    for r in sorted(enumerate(rects), key=lambda t: (t[1][2] * t[1][3], t[0])):
        if not any(plain_iou(k, r[1]) >= 0.6 for k in kept):
            kept.append(r[1])
    df = spark.createDataFrame([(rects, [(0, 0, 3, 5), (4, 0, 3, 5), (9, 0, 2, 5)]), ([], [])], f"a {RECTS}, b {RECTS}")
    first, empty = df.select(geometry.suppress(F.col("a"), 0.6).alias("s"), geometry.merge_row(F.col("b")).alias("m"), geometry.segmentation_score(F.col("b"), F.lit(20)).alias("g")).collect()
    assert [tuple(r) for r in first.s] == kept
    assert [tuple(r) for r in first.m] == [(0, 0, 7, 5), (9, 0, 2, 5)]
    assert empty.s == [] and empty.m == [] and empty.g is None
