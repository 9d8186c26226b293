"""Segmentations against plain Python, on drawn images and random lists of rectangles."""

import random
from statistics import mean, median

import numpy as np
from larkspur.operators import images, segmentation
from larkspur.sources import readers, writers

RECTS = "id long, rects array<struct<x:int,y:int,w:int,h:int>>"


def aspect(b):
    return b[2] / max(1, b[3])


def dash_like(b, mh):
    x, y, w, h = b
    if w >= 3 and h >= 2 and 1.25 <= aspect(b) <= 8 and h <= max(5, mh * 0.62):
        return True
    return w >= 2 and h >= 2 and 0.85 <= aspect(b) <= 10 and h <= max(7, mh * 0.78)


def run_score(run, dash, fallback):
    others = [b for k, b in enumerate(run) if k != dash]
    mh = median(b[3] for b in others) or fallback
    score = 100.0
    for b in others:
        score -= abs(b[3] - mh) / max(1, mh) * 24
        score -= 18 if aspect(b) < 0.05 or aspect(b) > 1.45 else 0
    for a, b in zip(run, run[1:], strict=False):
        gap = b[0] - a[0] - a[2]
        score -= 35 if gap > mh * 0.9 else 15 if gap < -mh * 0.2 else 0
    return score - abs(run[dash][1] + run[dash][3] / 2 - mean(b[1] + b[3] / 2 for b in others)) / max(1, mh) * 20


def best_by_hand(boxes):
    n = len(boxes)
    narrow = [b[3] for b in boxes if aspect(b) <= 1.3]
    mh = median(narrow) if narrow else median([b[3] for b in boxes] or [0])
    tried = []
    for start in range(n):
        for length, dash in ((9, 5), (8, 4), (5, 1)):
            run = boxes[start : start + length]
            if len(run) < length or (length == 9 and n != 9) or (length == 5 and n > 6) or not dash_like(run[dash], mh):
                continue
            score = run_score(run, dash, mh)
            if length == 9:
                score += 20
            elif length == 5:
                score -= (n - 5) * 4
            else:
                odd = lambda b: b[3] / max(1, mh) < 0.55 or b[3] / max(1, mh) > 1.65 or aspect(b) > 1.55
                score += sum(4 if odd(b) else -2 for b in boxes[:start] + boxes[start + 8 :]) - (n - 8) * 2.5 + (18 if n == 8 else 0)
            tried.append((score, length, -start, run))
    best = max(tried, default=None)
    return best[3] if best and best[0] >= 38 else boxes


def code_row(rng, n, dash):
    """A row of n characters of about one size with a dash; now and then an odd one."""
    x, out = 5, []
    for k in range(n):
        if k == dash:
            box = (x, 20 + rng.randint(0, 4), rng.randint(6, 10), rng.randint(2, 5))
        elif rng.random() < 0.08:
            box = (x, 2, rng.randint(3, 40), rng.randint(6, 50))
        else:
            box = (x, 10 + rng.randint(0, 1), rng.randint(6, 14), rng.randint(23, 26))
        out.append(box)
        x += box[2] + rng.choice((0, 1, 3, 5, 30 if rng.random() < 0.1 else 4))
    return out


def test_best_sequences(spark):
    rng = random.Random(3)
    rows = [code_row(rng, n, rng.choice((1, 4, 5, 6))) for n in range(13) for _ in range(25)]
    got = segmentation.best_sequences(spark.createDataFrame(list(enumerate(rows)), RECTS), ["id"]).collect()
    assert {r.id: [tuple(b) for b in r.rects] for r in got} == {k: best_by_hand(row) for k, row in enumerate(rows)}
    assert sum(len(best_by_hand(row)) < len(row) for row in rows) > 20
    nothing = segmentation.best_sequences(spark.createDataFrame([(1, None), (2, [])], RECTS), ["id"]).collect()
    assert {r.id: r.rects for r in nothing} == {1: None, 2: []}


def drawn(boxes, width=200, height=40):
    image = np.full((height, width), 230, np.uint8)
    for x, y, w, h in boxes:
        image[y : y + h, x : x + w] = 20
    return image


#: Eight components: characters of 10 by 24, a dash of 12 by 6 in the fifth place.
EIGHT = [(6 + 16 * k, 8, 10, 24) if k != 4 else (6 + 16 * k, 17, 12, 6) for k in range(8)]


def test_valley_split():
    ink = drawn([(10, 5, 9, 25), (19, 20, 5, 2), (24, 5, 9, 25)]) < 100
    assert segmentation.valley_split(ink, (10, 5, 23, 25)) == ((10, 5, 11, 25), (22, 5, 11, 25))
    solid = drawn([(10, 5, 23, 25)]) < 100
    assert segmentation.valley_split(solid, (10, 5, 23, 25)) is None
    assert segmentation.valley_split(ink, (10, 5, 9, 25)) is None
    assert segmentation.valley_split(ink, (100, 5, 20, 25)) is None


def test_prefix_recovery():
    """A second component that is two characters joined by a thin line is parted, and the list is the long format."""
    rest = [(40 + 16 * k, 8, 10, 24) if k != 3 else (40 + 16 * k, 17, 12, 6) for k in range(7)]
    ink = drawn([(4, 8, 10, 24), (16, 8, 8, 24), (24, 20, 5, 2), (29, 8, 8, 24), *rest[1:]]) < 100
    merged = [(4, 8, 10, 24), (16, 8, 21, 24), *rest[1:]]
    got = segmentation.recovered_prefix(ink, merged)
    assert len(merged) == 8 and len(got) == 9 and got[1:3] == [(16, 8, 10, 24), (27, 8, 10, 24)]
    assert segmentation.recovered_prefix(ink, merged[1:]) == merged[1:]
    named = {h[0]: h[1:] for h in segmentation.hypotheses(ink, merged)}
    assert named["prb-recovery"] == (8.0, False, got) and named["merged-contours"] == (0.0, False, merged)
    assert named["prb-window-0"] == (14.0, False, got)


def test_merges():
    ink = drawn(EIGHT) < 100
    halves = [*EIGHT[:2], (38, 8, 4, 24), (43, 8, 5, 24), *EIGHT[3:]]
    named = {h[0]: h[1:] for h in segmentation.hypotheses(ink, halves)}
    assert named["fragment-merge-2"] == (3.0, False, EIGHT) and named["fragment-merge-selected-2"] == (6.0, True, EIGHT)
    assert named["touching-pair-merge-2"] == (2.0, False, EIGHT)
    assert not any("merge-1" in name for name in named)
    assert segmentation.hypotheses(ink, []) == []


def test_segmentations(spark):
    noisy = [*EIGHT, (150, 4, 30, 32)]
    pictures = {"plain": drawn(EIGHT), "noisy": drawn(noisy), "blank": np.full((40, 200), 230, np.uint8), "dot": np.zeros((1, 1), np.uint8)}
    rows = [(k, p.shape[1], p.shape[0], bytearray(p.tobytes())) for k, p in pictures.items()]
    images = spark.createDataFrame(rows, "id string, width int, height int, pixels binary").withColumn("rank", segmentation.F.lit("clash"))
    got = segmentation.segmentations(images).orderBy("id", "rank").collect()
    assert {r.id for r in got} == {"plain", "noisy"}
    for name, boxes in (("plain", EIGHT), ("noisy", noisy)):
        first, *rest = [r for r in got if r.id == name]
        # The blur widens ink by less than half a pixel.
        assert [(b.x, b.w) for b in first.rects][:8] == [(x, w) for x, _, w, _ in EIGHT]
        assert len(first.rects) == 8 and first.rank == 1 and len(rest) < 16
        assert [r.score for r in rest] == sorted((r.score for r in rest), reverse=True)
        assert len({str(r.rects) for r in (first, *rest)}) == 1 + len(rest)
    assert segmentation.segmentations(images, most=0).count() == 2
    assert segmentation.segmentations(images.limit(0)).count() == 0


def test_cubic_by_hand():
    """Each new pixel as the sum over 4 x 4 old ones."""
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7)).astype(np.uint8)

    def weight(d):
        d = abs(d)
        return 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0

    for scale in (2, 3):
        got = images.cubic(image, scale)
        assert got.shape == (5 * scale, 7 * scale)
        for y in range(5 * scale):
            for x in range(7 * scale):
                fy, fx = (y + 0.5) / scale - 0.5, (x + 0.5) / scale - 0.5
                total = sum(weight(fy - j) * weight(fx - k) * image[min(max(j, 0), 4), min(max(k, 0), 6)] for j in range(int(fy // 1) - 1, int(fy // 1) + 3) for k in range(int(fx // 1) - 1, int(fx // 1) + 3))
                assert abs(int(got[y, x]) - min(255, max(0, total))) <= 0.5 + 1e-6
    assert (images.cubic(np.full((3, 3), 77, np.uint8), 3) == 77).all()


def test_wide_segments():
    def joined(parts, thin=4):
        ink = np.zeros((20, parts * 10 + (parts - 1) * thin), np.uint8)
        for k in range(parts):
            ink[:, k * (10 + thin) : k * (10 + thin) + 10] = 255
        ink[9:11] = 255
        return np.pad(ink, 5)

    two = images.split_segment(joined(2), (100, 7, 24, 20), 2)
    assert [b for b, _ in two] == [(100, 7, 12, 20), (112, 7, 12, 20)] and all(ink.any() for _, ink in two)
    three = images.split_segment(joined(3), (0, 0, 38, 20), 3)
    assert [b[2] for b, _ in three] == [12, 13, 13] and sum(ink.shape[1] for _, ink in three) == 38
    block = np.pad(np.full((20, 24), 255, np.uint8), 20)
    assert images.split_segment(block, (0, 0, 24, 20), 2) == []
    assert images.split_segment(np.zeros((9, 9), np.uint8), (0, 0, 9, 9), 2) == []


def test_star_place():
    card = np.zeros((1039, 744), np.uint8)
    y, x = np.mgrid[-20:20, -20:20]
    star = np.where(np.hypot(x, y) < 8 + 5 * np.cos(5 * np.arctan2(y, x)), 255, 0).astype(np.uint8)
    card[100:140, 100:140] = star
    assert not images.card_has_star(card)
    card[940:980, 640:680] = star
    assert images.card_has_star(card)
    assert not images.card_has_star(np.zeros((3, 3), np.uint8))
    specks = np.zeros((20, 20), bool)
    specks[3, 3] = specks[9:12, 9:12] = True
    assert images.opened(specks).sum() == 5


def test_regions(spark):
    # A dash of a third of the height still joins the row, so there are enough regions without the fallback.
    page = drawn([(x + 100, y + 120, w, max(8, h)) for x, y, w, h in EIGHT], 400, 200)
    rows = [(k, p.shape[1], p.shape[0], bytearray(p.tobytes())) for k, p in (("page", page), ("blank", np.full((100, 50), 230, np.uint8)))]
    pictures = spark.createDataFrame(rows, images.IMAGE)
    for wide in (False, True):
        got = segmentation.regions(pictures, 8, wide=wide).orderBy("id", "rank").collect()
        blank = {tuple(r)[3:] for r in got if r.id == "blank"}
        assert blank == {(0, 45, 50, 55), (0, 0, 50, 100)}
        x, y, w, h = tuple(next(r for r in got if r.id == "page"))[3:]
        # The best region holds all but at most the outermost character.
        assert x <= 122 and x + w >= 212 and y <= 128 and y + h >= 152 and h < 60
        assert [r.score for r in got if r.id == "page"] == sorted((r.score for r in got if r.id == "page"), reverse=True)
    row = [(20 * k, 40, 10, 20) for k in range(7)]
    assert [r[2] for r in images.row_regions(row, 8, 400, 100, wide=True)] == [130 + 6, 130 + 16, 130 + 33, 130 + 24]
    # Too narrow for a run's region: only the whole row, with 0.62 of its height at the right.
    assert images.row_regions([(0, 0, 1, 20)] * 3, 3, 400, 100) == [(0, 0, 13, 24)]
    ink = np.zeros((30, 30), bool)
    ink[:, 28:] = True
    assert images.right_edge_ink(ink, (0, 0, 30, 30)) == 1.0 and images.right_edge_ink(ink, (0, 0, 28, 30)) == 0.0


def test_template_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    pictures = [("A", "x:1", 3, 2), ("-", "y", 40, 56), ("A", "z", 1, 1)]
    rows = [(c, n, w, h, bytearray(rng.integers(0, 256, w * h).astype("u1").tobytes())) for c, n, w, h in pictures]
    kind = "character string, name string, width int, height int, pixels binary"
    folder = f"file://{tmp_path}/templates"
    assert writers.write_templates(spark.createDataFrame(rows, kind), folder) == 3
    assert writers.write_templates(spark.createDataFrame([], kind), folder) == 0
    back = {r.id.split("templates/")[1]: (r.width, r.height, bytes(r.pixels)) for r in readers.read_grey(spark, folder).collect()}
    assert back == {name: (w, h, bytes(p)) for name, (_, _, w, h, p) in zip(("A/x_1.png", "Dash/y.png", "A/z.png"), rows, strict=True)}
    assert {r.character for r in readers.template_library(spark, folder).collect()} == {"A", "-"}
