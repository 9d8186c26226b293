"""Grey images as rows (id, width, height, pixels: binary, row by row), with vectorised numpy in mapInArrow.

Experimental: the geometry and thresholds follow the matching rules, pixels are
shrunk by area means and enlarged by cubic curves, and no photograph is part of
the tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

IMAGE = "id string, width int, height int, pixels binary"
#: Relative crops (name, left, top, width, height) of a card's number, from its final place and coarse ones.
CROPS = (("tight", 0.770, 0.952, 0.155, 0.027), ("normal", 0.745, 0.944, 0.190, 0.038), ("wide", 0.715, 0.936, 0.225, 0.050))
COARSE_CROPS = (("0", 0.56, 0.875, 0.39, 0.105), ("1", 0.60, 0.895, 0.35, 0.085), ("2", 0.64, 0.915, 0.31, 0.065), ("3", 0.60, 0.855, 0.35, 0.085), ("4", 0.67, 0.885, 0.28, 0.080))
#: The crop of the rarity, and the star's place (left, top, width, height) in pixels of a card of 744 by 1039.
RARITY_CROP = (("rarity", 0.84, 0.90, 0.10, 0.075),)
STAR_PLACE = (625, 925, 85, 70)
GLYPH_WIDTH, GLYPH_HEIGHT = 40, 56


def otsu(image) -> int:
    """The threshold that parts dark and light with the greatest variance between them."""
    import numpy as np

    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below, weight = np.cumsum(n), np.cumsum(n * np.arange(256))
    total = below[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (weight[-1] * below - weight * total) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def binarise(image):
    """White ink on black: inverted if over half is white."""
    white = image > otsu(image)
    return ~white if white.mean() > 0.5 else white


def resize(image, width: int, height: int):
    """Area means for shrinking, nearest pixels for enlarging."""
    import numpy as np

    def axis(n: int, m: int):
        edges = np.linspace(0, n, m + 1)
        low, high = np.floor(edges[:-1]).astype(int), np.maximum(np.ceil(edges[1:]).astype(int), np.floor(edges[:-1]).astype(int) + 1)
        return low, np.minimum(high, n)

    sums = np.pad(np.cumsum(np.cumsum(image.astype(float), 0), 1), ((1, 0), (1, 0)))
    (y0, y1), (x0, x1) = axis(image.shape[0], height), axis(image.shape[1], width)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    return (sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]) / area


def signature(image) -> str:
    """Size and 32 x 12 bits: whether a cell is at least as light as the mean."""
    small = resize(image, 32, 12).round()
    return f"{image.shape[1]}x{image.shape[0]}:" + "".join("1" if x else "0" for x in (small >= small.mean()).ravel())


def glyph(image, width: int = GLYPH_WIDTH, height: int = GLYPH_HEIGHT, margin: int = 4):
    """The ink's bounding box, scaled to fit and centred."""
    import numpy as np

    ink = binarise(image)
    out = np.zeros((height, width), np.uint8)
    rows, columns = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    if not len(rows):
        return out
    cut = ink[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] * 255.0
    scale = min((width - 2 * margin) / cut.shape[1], (height - 2 * margin) / cut.shape[0])
    w, h = max(1, round(cut.shape[1] * scale)), max(1, round(cut.shape[0] * scale))
    y, x = (height - h) // 2, (width - w) // 2
    out[y : y + h, x : x + w] = resize(cut, w, h).round()
    return out


def cubic(image, scale: int):
    """Enlarged by cubic convolution (slope -0.75) around pixel centres; edges are continued."""
    import numpy as np

    def axis(n: int):
        """Weights of the old pixels for each new one."""
        at = (np.arange(n * scale) + 0.5) / scale - 0.5
        first, a = np.floor(at).astype(int), -0.75
        out = np.zeros((n * scale, n))
        for k in range(-1, 3):
            d = np.abs(at - first - k)
            near, far = ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
            np.add.at(out, (np.arange(n * scale), np.clip(first + k, 0, n - 1)), np.where(d <= 1, near, np.where(d < 2, far, 0)))
        return out

    rows, columns = axis(image.shape[0]), axis(image.shape[1])
    return np.clip(np.floor(rows @ image.astype(float) @ columns.T + 0.5), 0, 255).astype(np.uint8)


def preprocess(image, scale: int = 3):
    """Enlarged, stretched to the whole range of greys, with a white border: a thirtieth of the width (12 at least), an eighth of the height (8 at least)."""
    import numpy as np

    large = cubic(image, scale).astype(float)
    low, high = large.min(), large.max()
    stretched = (large - low) * 255.0 / (high - low) if high > low else large
    h, w = large.shape
    return np.pad(stretched.round().astype(np.uint8), ((max(8, h // 8),) * 2, (max(12, w // 30),) * 2), constant_values=255)


def components(image) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (x, y, w, h) of connected ink, by left edge; runs of a row are joined with those they touch above."""
    import numpy as np

    ink = binarise(image)
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(ink):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.view(np.int8), [0]))))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            mine = None
            for a2, b2, k in above:
                if a2 <= b and a <= b2:  # neighbours also by a corner
                    k = find(k)
                    if mine is None or mine == k:
                        mine = k
                    else:
                        parent[k] = mine
                        p, q = boxes[mine], boxes[k]
                        boxes[mine] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]
            if mine is None:
                mine = len(parent)
                parent.append(mine)
                boxes.append([a, y, b, y + 1])
            p = boxes[mine]
            boxes[mine] = [min(p[0], a), min(p[1], y), max(p[2], b), max(p[3], y + 1)]
            now.append((a, b, mine))
        above = now
    return sorted((p[0], p[1], p[2] - p[0], p[3] - p[1]) for k, p in enumerate(boxes) if find(k) == k)


def _union(boxes: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int]:
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y


def text_rows(boxes: list[tuple[int, int, int, int]], least: int = 3) -> list[list[tuple[int, int, int, int]]]:
    """Components dealt into rows from the top: each joins the row of fitting height and centre that it overlaps most, or begins one. Rows of a few components are left out."""
    from statistics import median

    rows: list[list[tuple[int, int, int, int]]] = []
    for box in sorted(boxes, key=lambda b: b[1]):
        best, share = None, 0.0
        for row in rows:
            _, y, _, h = _union(row)
            m = median(b[3] for b in row)
            overlap = (min(y + h, box[1] + box[3]) - max(y, box[1])) / max(1, min(h, box[3]))
            centred = abs(y + h / 2 - box[1] - box[3] / 2) <= max(h, m) * 0.72
            if 0.28 <= box[3] / max(1.0, m) <= 2.40 and centred and overlap > share:
                best, share = row, overlap
        if best is not None and share >= 0.35:
            best.append(box)
        else:
            rows.append([box])
    return [row for row in rows if len(row) >= least]


#: Left and right padding (share of the median height and least pixels) of a narrow and a generous region; of the variant for cut-off numbers, whose third is for runs of enough characters.
PADDINGS = ((0.16, 3, 0.30, 5), (0.22, 4, 0.62, 10))
WIDE_PADDINGS = ((0.16, 3, 0.30, 5), (0.22, 4, 0.78, 12), (0.22, 4, 1.20, 18))
#: Fixed value: the third padding for runs that lack characters.
SHORT_RUN_PADDING = (0.22, 4, 1.65, 18)


def _region_like(run: list[tuple[int, int, int, int]], width: int, height: int) -> bool:
    """Whether components span a fitting part of the image and enough of them are of about one height."""
    _, _, w, h = _union(run)
    m = sorted(b[3] for b in run)[len(run) // 2]
    alike = sum(0.45 * m <= b[3] <= 1.80 * m for b in run)
    return 0.08 * width <= w <= 0.98 * width and h <= 0.85 * height and alike >= max(3, len(run) // 2)


def row_regions(row: list[tuple[int, int, int, int]], characters: int, width: int, height: int, wide: bool = False) -> list[tuple[int, int, int, int]]:
    """Regions around runs of about so many neighbours of a row, each with every padding, then around a row that is not much longer; clipped to the image."""
    from statistics import median

    def padded(run: list, left: float, least_left: int, right: float, least_right: int) -> tuple[int, int, int, int]:
        x, y, w, h = _union(run)
        m = median(b[3] for b in run)
        dx, dw, dy = max(least_left, round(m * left)), max(least_right, round(m * right)), max(4, round(m * 0.18))
        x0, y0 = max(0, x - dx), max(0, y - dy)
        return x0, y0, min(width, x + w + dw) - x0, min(height, y + h + dy) - y0

    row, out = sorted(row), []
    for size in range(max(3, characters - 1), min(len(row), characters + 2) + 1):
        for k in range(len(row) - size + 1):
            run = row[k : k + size]
            if not _region_like(run, width, height):
                continue
            paddings = PADDINGS if not wide else WIDE_PADDINGS if size >= characters else (*WIDE_PADDINGS[:2], SHORT_RUN_PADDING)
            out += [padded(run, *p) for p in paddings]
    return [*out, padded(row, *(WIDE_PADDINGS if wide else PADDINGS)[-1])] if 0 < len(row) <= characters + 2 else out


def region_boxes(boxes: list[tuple[int, int, int, int]], characters: int, width: int, height: int, wide: bool = False) -> list[tuple[int, int, int, int]]:
    """Regions of all rows of components; with fewer than five, also the image's lower part and the whole of it."""
    out = [r for row in text_rows(boxes) for r in row_regions(row, characters, width, height, wide)]
    if len(out) < 5:
        low = round(height * 0.45)
        out += [(0, min(low, max(0, height - 1)), width, max(1, height - low)), (0, 0, width, height)]
    return out


def right_edge_ink(ink, box: tuple[int, int, int, int]) -> float:
    """The share of ink in a strip at a region's right edge."""
    x, y, w, h = box
    strip = min(max(2, min(5, round(h * 0.08))), w)
    return float(ink[y : y + h, x + w - strip : x + w].mean()) if strip > 0 and h > 0 else 0.0


def opened(ink):
    """Ink that a plus of five pixels fits in."""
    import numpy as np

    def shifts(x, fill: bool):
        p = np.pad(x, 1, constant_values=fill)
        return p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]

    return np.logical_or.reduce(shifts(np.logical_and.reduce(shifts(ink, True)), False))


def has_star(image, light: int = 205) -> bool:
    """Whether a light component of a star's size, shape and raggedness is there, once specks are taken away."""
    import numpy as np

    ink = opened(image > light)
    if not ink.any():
        return False
    for x, y, w, h in components(np.pad(np.where(ink, 255, 0).astype(np.uint8), ((0, ink.shape[0] + 1), (0, 0)))):
        part = ink[y : y + h, x : x + w]
        area = int(part.sum())
        if not (20 <= area <= 900 and min(w, h) >= 5 and 0.55 <= w / h <= 1.65):
            continue
        padded = np.pad(part, 1).astype(int)
        edge = int(np.abs(np.diff(padded, axis=0)).sum() + np.abs(np.diff(padded, axis=1)).sum()) * np.pi / 4
        if 0.12 <= 4 * np.pi * area / edge**2 <= 0.72:
            return True
    return False


def card_has_star(card) -> bool:
    """``has_star`` at the star's place, clipped to the card."""
    left, top, w, h = STAR_PLACE
    x, y = min(left, card.shape[1] - 1), min(top, card.shape[0] - 1)
    return has_star(card[y : y + h, x : x + w])


def _cut_costs(weight, aim: int):
    import numpy as np

    n = len(weight)
    return weight / max(1.0, weight.max()) * 0.82 + np.abs(np.arange(n) - aim) / n * 0.18


def split_places(ink, parts: int) -> list[int]:
    """Columns at which a wide segment is cut into two or three; none where no column is light enough."""
    import numpy as np

    n = ink.shape[1]
    weight = np.convolve(ink.sum(axis=0).astype(float), np.ones(3), mode="same") / np.convolve(np.ones(n), np.ones(3), mode="same")
    # The least and greatest place of each cut as shares of the width, and columns left at either side.
    ranges = {2: ((0.28, 3, 0.72, 3),), 3: ((0.18, 3, 0.46, 7), (0.54, 7, 0.82, 3))}[parts]
    bounds = [(max(a, round(n * low)), min(n - b, round(n * high))) for low, a, high, b in ranges]
    if any(low > high for low, high in bounds):
        return []
    costs = [_cut_costs(weight, n * (k + 1) // parts) for k in range(parts - 1)]
    total = sum(np.expand_dims(c[low : high + 1], axis=tuple(j for j in range(parts - 1) if j != k)) for k, (c, (low, high)) in enumerate(zip(costs, bounds, strict=True)))
    if parts == 3:
        first, second = np.ogrid[bounds[0][0] : bounds[0][1] + 1, bounds[1][0] : bounds[1][1] + 1]
        total = np.where(second - first < 4, np.inf, total)
    places = [low + int(k) for (low, _), k in zip(bounds, np.unravel_index(np.argmin(total), total.shape), strict=True)]
    light = weight[places] <= max(1.0, weight.max()) * 0.62
    return places if np.isfinite(total.min()) and light.all() else []


def split_segment(image, box: tuple[int, int, int, int], parts: int) -> list[tuple[tuple[int, int, int, int], object]]:
    """Boxes and ink of a wide segment's parts, its ink's share of the width carried over to its box; empty where the parts would be too thin, too light or too uneven."""
    import numpy as np

    ink = binarise(image)
    rows, columns = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    if not len(rows) or parts < 2:
        return []
    cut = ink[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    n = cut.shape[1]
    if n < parts * 4 or cut.shape[0] < 6 or not (places := split_places(cut, parts)):
        return []
    x, y, w, h = box
    out = []
    for low, high in zip([0, *places], [*places, n], strict=True):
        left, right = x + round(w * (low / n)), x + round(w * (high / n))
        if high - low < 3 or cut[:, low:high].sum() < 8:
            return []
        out.append(((left, y, max(1, right - left), h), cut[:, low:high]))
    widths = [b[2] for b, _ in out]
    return [] if max(widths) > min(widths) * 2.8 else out


def _images(batches: Iterator, function: Callable) -> Iterator[list]:
    import numpy as np

    for batch in batches:
        for r in batch.to_pylist():
            yield r["id"], function(np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"]))


def map_images(images: DataFrame, function: Callable) -> DataFrame:
    """Each image put through a function from array to array."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, out in _images(batches, function):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([out.shape[1]], pa.int32()), pa.array([out.shape[0]], pa.int32()), pa.array([out.astype("u1").tobytes()], pa.binary())], names=["id", "width", "height", "pixels"])

    return images.select("id", "width", "height", "pixels").mapInArrow(run, IMAGE)


def map_values(images: DataFrame, function: Callable, kind: str) -> DataFrame:
    """id and value: what a function makes of each image, of an SQL type."""
    import pandas as pd

    def run(frames: Iterator) -> Iterator:
        import numpy as np

        for frame in frames:
            values = [function(np.frombuffer(p, np.uint8).reshape(h, w)) for w, h, p in zip(frame["width"], frame["height"], frame["pixels"], strict=True)]
            yield pd.DataFrame({"id": frame["id"], "value": values})

    return images.select("id", "width", "height", "pixels").mapInPandas(run, f"id string, value {kind}")


def upright(image):
    """Turned by a quarter if wider than high."""
    import numpy as np

    return image if image.shape[0] >= image.shape[1] else np.rot90(image, -1)


def distinct_images(images: DataFrame) -> DataFrame:
    """One image of each signature, the one with the smallest id."""
    from pyspark.sql import functions as F

    first = map_values(images, signature, "string").groupBy("value").agg(F.min("id").alias("id")).select("id")
    return images.join(first, "id", "left_semi")


def crops(images: DataFrame, places: tuple = CROPS) -> DataFrame:
    """Fixed relative crops of each image set upright, as id/name; crops under five pixels are left out."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for key, image in _images(batches, lambda x: x):
            image = upright(image)
            h, w = image.shape
            rows = []
            for name, x, y, dw, dh in places:
                cut = image[int(h * y) : int(h * y) + int(h * dh), int(w * x) : int(w * x) + int(w * dw)]
                if min(cut.shape) >= 5:
                    rows.append((f"{key}/{name}", cut.shape[1], cut.shape[0], cut.tobytes()))
            if not rows:
                continue
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["id", "width", "height", "pixels"])

    return images.select("id", "width", "height", "pixels").mapInArrow(run, IMAGE)
