"""Regions of an image that may hold a code, and segmentations of one: made from components, scored and ranked.

Lists are made in Arrow batches, since splits look at pixels; runs, scores,
duplicates and ranks are relational.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import (
    LEAST_SEQUENCE_SCORE,
    character_height,
    discarded_score,
    edge_ink_penalty,
    likely_dash_relaxed,
    merge_row,
    possible_character,
    possible_text,
    region_score,
    segmentation_score,
    sequence_score,
    suppress,
)
from . import images as I
from .ordered import ranked_hypotheses, ranked_regions

Box = tuple[int, int, int, int]
RECT = "struct<x:int,y:int,w:int,h:int>"
#: Names, lengths and places of the dash of the code formats.
FORMATS = (("promo", 5, 1), ("standard", 8, 4), ("prb", 9, 5))
#: How many pairs of splits and how many touching pairs are tried.
MOST_DOUBLE_SPLITS, MOST_TOUCHING = 6, 4


def smoothed_ink(image):
    """White ink on black after a 3 x 3 binomial blur."""
    import numpy as np

    wide = np.pad(image.astype(float), 1, mode="reflect" if min(image.shape) > 1 else "edge")
    rows = wide[:-2] + 2 * wide[1:-1] + wide[2:]
    return I.binarise(np.floor((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 16 + 0.5).astype(np.uint8))


def _tight(ink, x: int, y: int, w: int, h: int) -> Box | None:
    import numpy as np

    cut = ink[y : y + h, x : x + w]
    rows, columns = np.flatnonzero(cut.any(axis=1)), np.flatnonzero(cut.any(axis=0))
    if not len(rows):
        return None
    return int(x + columns[0]), int(y + rows[0]), int(columns[-1] - columns[0] + 1), int(rows[-1] - rows[0] + 1)


def valley_split(ink, box: Box) -> tuple[Box, Box] | None:
    """Two parts of a box at the lightest column of its middle, where that column is light enough and both parts look like characters."""
    import numpy as np

    x, y, w, h = box
    low, high = max(2, round(w * 0.28)), min(w - 3, round(w * 0.72))
    if w < 10 or h < 8 or low >= high:
        return None
    weight = ink[y : y + h, x : x + w].sum(axis=0).astype(float)
    most = np.maximum.accumulate(weight)
    near = np.convolve(weight, np.ones(5), mode="same") / np.convolve(np.ones(w), np.ones(5), mode="same")
    valley = near + np.abs(np.arange(w) - w / 2) / w * np.maximum(1, most) * 0.18
    at = low + int(np.argmin(valley[low : high + 1]))
    if most[-1] <= 0 or valley[at] > max(1.25, most[-1] * 0.34):
        return None
    parts = _tight(ink, x, y, at, h), _tight(ink, x + at + 1, y, w - at - 1, h)
    if any(p is None or p[2] < 2 or not 0.08 <= p[2] / p[3] <= 1.45 for p in parts):
        return None
    return parts


def _aspect(b: Box) -> float:
    return b[2] / max(1, b[3])


def _middle(values) -> float:
    values = list(values)
    return float(median(values)) if values else 0.0


def _dash(b: Box, height: float, relaxed: bool = True) -> bool:
    strict = b[2] >= 3 and b[3] >= 2 and 1.25 <= _aspect(b) <= 8.0 and b[3] <= max(5.0, height * 0.62)
    return strict or (relaxed and min(b[2:]) >= 2 and 0.85 <= _aspect(b) <= 10.0 and b[3] <= max(7.0, height * 0.78))


def _replaced(boxes: list[Box], changes: dict[int, list[Box]]) -> list[Box]:
    """The list with some places' boxes replaced, by left edge."""
    return sorted((b for k, old in enumerate(boxes) for b in changes.get(k, [old])), key=lambda b: b[0])


def recovered_prefix(ink, boxes: list[Box]) -> list[Box]:
    """Eight components whose first or second is two characters of a longer prefix: that one split; else the list as it is."""
    mh, mw = _middle(b[3] for b in boxes), _middle(b[2] for b in boxes if _aspect(b) <= 1.15)
    dash = next((k for k, b in enumerate(boxes) if _dash(b, mh, relaxed=False)), -1)
    if len(boxes) != 8 or min(mh, mw) <= 0 or not 3 <= dash <= 5:
        return boxes
    for k, b in enumerate(boxes[:2]):
        wide = b[2] >= mw * 1.55 and b[2] >= b[3] * 0.82 and b[3] >= mh * 0.68 and 0.82 <= _aspect(b) <= 2.35
        if wide and (parts := valley_split(ink, b)):
            return _replaced(boxes, {k: list(parts)})
    return boxes


def _windows(boxes: list[Box]) -> Iterator[tuple]:
    mh = _middle(b[3] for b in boxes)
    for name, length, dash in FORMATS:
        for k in range(len(boxes) - length + 1):
            run = boxes[k : k + length]
            yield f"{name}-window-{k}", (14.0 if _dash(run[dash], mh) else -12.0) - (len(boxes) - length) * 1.5, False, run


def _splits(ink, boxes: list[Box]) -> Iterator[tuple]:
    """Of 4 to 10 components each wide one split, then two of them at once."""
    from itertools import combinations, islice

    if not 4 <= len(boxes) <= 10:
        return
    mw = _middle(b[2] for b in boxes if _aspect(b) <= 1.20) or _middle(b[2] for b in boxes)
    cuts = {k: list(parts) for k, b in enumerate(boxes) if b[2] >= max(9.0, mw * 1.45) and (parts := valley_split(ink, b))}
    for k, parts in cuts.items():
        made = _replaced(boxes, {k: parts})
        yield f"projection-split-{k}", 5.0, False, made
        yield f"projection-split-selected-{k}", 8.0, True, made
    for j, k in islice(combinations(cuts, 2), MOST_DOUBLE_SPLITS):
        made = _replaced(boxes, {j: cuts[j], k: cuts[k]})
        yield f"projection-double-split-{j}-{k}", 7.0, False, made
        yield f"projection-double-split-selected-{j}-{k}", 10.0, True, made


def _merges(boxes: list[Box]) -> Iterator[tuple]:
    """Of 6 to 11 components neighbours joined: fragments of a character, then those that touch within a character's width."""
    if not 6 <= len(boxes) <= 11:
        return
    mh = _middle(b[3] for b in boxes)
    mw = _middle(b[2] for b in boxes if b[3] >= mh * 0.65 and not _dash(b, mh))
    touching = []
    for k, (a, b) in enumerate(zip(boxes, boxes[1:], strict=False)):
        gap, both = b[0] - a[0] - a[2], I._union([a, b])
        shared = (min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])) / max(1, min(a[3], b[3]))
        made = _replaced(boxes, {k: [both], k + 1: []})
        if gap <= max(2.0, mh * 0.08) and shared >= 0.30 and min(a[2], b[2]) <= mh * 0.28:
            yield f"fragment-merge-{k}", 3.0, False, made
            yield f"fragment-merge-selected-{k}", 6.0, True, made
        fits = both[2] <= mw * 1.45 and both[3] <= mh * 1.25 and not _dash(a, mh) and not _dash(b, mh)
        if min(mh, mw) > 0 and -0.35 * mw <= gap <= max(1.0, mh * 0.05) and shared >= 0.58 and fits:
            touching.append((f"touching-pair-merge-{k}", 2.0, False, made))
    yield from touching[:MOST_TOUCHING]


def hypotheses(ink, merged: list[Box]) -> list[tuple[str, float, bool, list[Box]]]:
    """(source, bonus, whether the best run of it is meant, boxes) of the components of an image, by left edge."""
    boxes = recovered_prefix(ink, merged)
    whole = [("merged-contours", 0.0, False, merged), ("prb-recovery", 8.0 if len(boxes) != len(merged) else -1.0, False, boxes), ("legacy-best-sequence", 10.0, True, boxes)]
    return [*whole, *_windows(boxes), *_splits(ink, boxes), *_merges(boxes)] if merged else []


def regions(images: DataFrame, characters: int, most: int = 15, wide: bool = False) -> DataFrame:
    """The best ``most`` regions of each image that may hold a code of so many characters: id, rank, score, x, y, w, h.

    Regions that overlap much are one, the smallest. The wide variant leaves
    more room at the right for cut-off numbers and scores ink at the right edge.
    Ranked by score, then by area. An image without text gives its lower part
    and the whole of it; ids must differ.
    """

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            found, edges = [], []
            for image in frame.itertuples(index=False):
                made = I.region_boxes([tuple(int(r[k]) for k in "xywh") for r in image.rects], characters, image.width, image.height, wide)
                ink = smoothed_ink(pixels_of(image))
                found.append([dict(zip("xywh", b, strict=True)) for b in made])
                edges.append([I.right_edge_ink(ink, b) for b in made])
            yield frame[["id", "width", "height"]].assign(rects=found, edges=edges)

    text = component_lists(images).withColumn("rects", F.array_sort(F.filter("rects", lambda r: possible_text(r, F.col("width"), F.col("height")))))
    made = text.mapInPandas(run, f"id string, width int, height int, rects array<{RECT}>, edges array<double>")
    each = made.select("*", F.explode(suppress(F.col("rects"))).alias("r"))
    score = region_score(F.col("r"), F.col("width"), F.col("height"), F.lit(characters))
    if wide:
        score += edge_ink_penalty(F.get("edges", F.array_position("rects", F.col("r")).cast("int") - 1))
    return ranked_regions(each.select("id", score.alias("score"), "r.*"), ["id"], "score", most).select("id", "rank", "score", "x", "y", "w", "h")


def best_sequences(lists: DataFrame, by: list[str], wanted: Column | None = None) -> DataFrame:
    """Each list ``rects`` (or each wanted one) cut to the run that looks most like a code, if its score reaches the least one.

    Runs are all nine (six characters before the dash in a list of nine), every
    eight, and every five in lists of five or six. Of equal scores the longer
    run counts, then the earlier one. A null list stays null. Rows must differ
    in ``by``; no other columns are kept.
    """
    n = F.size("rects")

    def of(fits: Column, length: int, dash: int) -> Column:
        starts = F.when(fits if wanted is None else fits & wanted, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(length).alias("length"), F.lit(dash).alias("dash")))

    runs = F.concat(of(n == 9, 9, 5), of(n >= 8, 8, 4), of(n.between(5, 6), 5, 1))
    each = lists.select(*by, "rects", character_height(F.col("rects")).alias("mh"), F.explode_outer(runs).alias("run")).select("*", F.slice("rects", F.col("run.start") + 1, F.col("run.length")).alias("part"))
    left_out, length = n - F.col("run.length"), F.col("run.length")
    eight = left_out * -2.5 + F.when(left_out == 0, 18.0).otherwise(0.0) + discarded_score(F.col("rects"), F.col("run.start"), length, F.col("mh"))
    extra = F.when(length == 9, 20.0).when(length == 8, eight).otherwise(left_out * -4.0)
    dashed = likely_dash_relaxed(F.get("part", F.col("run.dash")), F.col("mh"))
    scored = each.withColumn("score", F.when(dashed, sequence_score(F.col("part"), F.col("run.dash"), F.col("mh")) + extra))
    # Sums of the same terms in another order count as ties.
    scored = scored.withColumn("score", F.round("score", 9))
    found = F.when(F.col("score") >= LEAST_SEQUENCE_SCORE, F.struct("score", "run.length", (-F.col("run.start")).alias("early"), "part"))
    best = scored.groupBy(*by).agg(F.max(found).alias("best"), F.first("rects").alias("rects"))
    return best.select(*by, F.coalesce("best.part", "rects").alias("rects"))


def component_lists(images: DataFrame) -> DataFrame:
    """id, width, height, pixels and rects: all components of each image's smoothed ink; none gives an empty list."""

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            inks = [smoothed_ink(pixels_of(row)) for row in frame.itertuples(index=False)]
            found = [[dict(zip("xywh", b, strict=True)) for b in I.components(ink.astype("u1") * 255)] if ink.any() else [] for ink in inks]
            yield frame.assign(rects=found)

    return images.select("id", "width", "height", "pixels").mapInPandas(run, f"id string, width int, height int, pixels binary, rects array<{RECT}>")


def character_rows(images: DataFrame) -> DataFrame:
    """As ``component_lists``, of components that may be characters, touching ones merged."""
    fitting = component_lists(images).withColumn("rects", F.filter("rects", lambda r: possible_character(r, F.col("width"), F.col("height"))))
    return fitting.withColumn("rects", merge_row(F.col("rects")))


def segmentations(images: DataFrame, most: int = 16) -> DataFrame:
    """The best ``most`` (1 to 40) segmentations of each image: id, rank, source, score and rects.

    Equal lists count once, under the source that comes first. Ranked by score,
    then by how near they are to eight characters, then in the order of sources.
    An image without characters gives no row; ids must differ.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for image in frame.itertuples(index=False):
                made = hypotheses(smoothed_ink(pixels_of(image)), [tuple(int(r[k]) for k in "xywh") for r in image.rects])
                rows += [(image.id, image.width, place, *h[:3], [dict(zip("xywh", b, strict=True)) for b in h[3]]) for place, h in enumerate(made)]
            yield pd.DataFrame(rows, columns=["id", "width", "place", "source", "bonus", "chosen", "rects"])

    made = character_rows(images).mapInPandas(run, f"id string, width int, place int, source string, bonus double, chosen boolean, rects array<{RECT}>").repartition("id")
    facts = F.struct("width", "source", "bonus")
    # The facts go along as a key; they depend on id and place.
    lists = best_sequences(made.select("id", "place", facts.alias("facts"), "chosen", "rects"), ["id", "place", "facts"], F.col("chosen"))
    first = lists.groupBy("id", "rects").agg(F.min(F.struct("place", "facts")).alias("first"))
    flat = first.select("id", "rects", "first.place", "first.facts.*").withColumn("n", F.size("rects"))
    scored = flat.withColumn("score", segmentation_score(F.col("rects"), F.col("width")) + F.col("bonus"))
    return ranked_hypotheses(scored, ["id"], "score", "n", ["place"], max(1, min(40, most))).select("id", "rank", "source", "score", "rects")


def pixels_of(row):
    import numpy as np

    return np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width)
