"""Quality classifier: Naive Bayes support vectors.

Features of a text are indicators of hashed n-grams: words, and one to three
adjacent word shapes (letters by case, digits, punctuation as it stands; a word
that repeats the one before has a shape of its own). Each feature is scaled by
its class log-count ratio, counted over all labelled rows. On vectors scaled so
and brought to length one, a linear model with hinge loss is fitted by dual
coordinate descent. The margin gives the score through a logistic curve.

The ratios are gathered by a distributed count whose result is bounded by the
number of feature buckets. The hinge-loss fit takes at most ``sample_rows``
labelled rows (a documented bound, those with the smallest hash of their id, all
rows of an id or none);
scoring covers every row in one pass without a shuffle, with one weight for each
bucket sent to the workers.

Edge cases: null and empty texts have no features, so their score is that of the
intercept. Without labels every score is 0.5; with one class, all scores are on
its side. Labels of repeated ids count once (the largest). Null ids are never
training rows. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, ship

BITS, SAMPLE_ROWS, SMOOTHING, COST, ROUNDS, SEED, MAX_BROADCAST_ROWS = 18, 6000, 1.0, 1.0, 30, 7, 1_000_000
BATCH_BYTES = 1 << 20


def _tables():
    import numpy as np

    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += 32
    shape = np.arange(256, dtype=np.uint8)
    shape[65:91], shape[97:123], shape[128:], shape[48:58] = ord("A"), ord("a"), ord("a"), ord("0")
    return white, lower, shape


def _mix(x):
    """A 64-bit finaliser, so that the top bits depend on all bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(values, starts):
    """A polynomial hash for each run of values that begins at starts."""
    import numpy as np

    lengths = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), 0x100000001B3, np.uint64))
    return _mix(np.add.reduceat((values + np.uint64(1)) * powers[place], starts))


def features(texts: list[bytes], bits: int = BITS):
    """The distinct (row, feature) pairs, sorted by row: two arrays."""
    import numpy as np

    white, lower, shape_of = _tables()
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    first = np.cumsum([0] + [len(x) + 1 for x in texts])  # where each row begins
    solid = ~white[data]
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kept = np.flatnonzero(solid)
    begin = np.searchsorted(kept, starts)
    row = np.searchsorted(first, starts, side="right") - 1
    words = _hashes(lower[data[kept]], begin)

    kind = shape_of[data[kept]]
    letter = (kind == 65) | (kind == 97) | (kind == 48)
    same = np.concatenate(([False], kind[1:] == kind[:-1]))
    same[begin] = False
    third = same & np.concatenate(([False], same[:-1])) & np.concatenate(([False, False], same[:-2]))
    use = np.flatnonzero(~(same & letter) & ~third)  # runs of letters once, of punctuation three times at most
    shapes = _hashes(kind[use].astype(np.uint64), np.searchsorted(use, begin))
    shapes[np.concatenate(([False], (words[1:] == words[:-1]) & (row[1:] == row[:-1])))] = np.uint64(0x5EED)

    keys, shift = [], np.uint64(64 - bits)
    for salt, grams, last in ((1, words, 0), (2, shapes, 0), (3, _mix(shapes[1:] * np.uint64(31) + shapes[:-1]), 1), (4, _mix((shapes[2:] * np.uint64(31) + shapes[1:-1]) * np.uint64(31) + shapes[:-2]), 2)):
        inside = row[last:] == row[: len(row) - last]
        bucket = _mix(grams + np.uint64(salt * 0x51ED270B)) >> shift
        keys.append((row[last:][inside].astype(np.int64) << bits) | bucket[inside].astype(np.int64))
    found = np.unique(np.concatenate(keys))
    return found >> bits, found & ((1 << bits) - 1)


def _batched(batches: Iterator) -> Iterator:
    """(other columns' values, texts) of few bytes at a time."""
    for batch in batches:
        rest, texts, size = [], [], 0
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        for k, x in enumerate(batch.columns[-1]):
            texts.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
            rest.append(tuple(c[k] for c in columns))
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                yield rest, texts
                rest, texts, size = [], [], 0
        if texts:
            yield rest, texts


def _count(batches: Iterator, bits: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    n = np.zeros((2, 1 << bits), np.int64)
    rows = np.zeros(2, np.int64)
    for rest, texts in _batched(batches):
        label = np.array([r[0] for r in rest])
        row, feature = features(texts, bits)
        rows += np.bincount(label, minlength=2)[:2]
        for k in (0, 1):
            n[k] += np.bincount(feature[label[row] == k], minlength=1 << bits)
    some = np.flatnonzero(n.any(axis=0))
    columns = [np.append(some, -1), np.append(n[0][some], rows[0]), np.append(n[1][some], rows[1])]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "n0", "n1"])


def _vectors(batches: Iterator, bits: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for rest, texts in _batched(batches):
        row, feature = features(texts, bits)
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        blobs = [feature[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rest], pa.int32()), pa.array(blobs, pa.binary())], names=["label", "features"])


def dual_coordinate_descent(rows: list, labels, width: int, cost=COST, rounds: int = ROUNDS, seed: int = SEED):
    """Weights that minimise |w|²/2 + cost * hinge loss. rows: (indexes, values) each, the last index the intercept; labels: -1 or 1."""
    import numpy as np

    w, alpha, rng = np.zeros(width), np.zeros(len(rows)), np.random.default_rng(seed)
    cost = np.broadcast_to(cost, len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    for _ in range(rounds):
        worst = 0.0
        for k in rng.permutation(len(rows)):
            index, value = rows[k]
            slope = labels[k] * float(w[index] @ value) - 1
            projected = min(slope, 0) if alpha[k] == 0 else max(slope, 0) if alpha[k] == cost[k] else slope
            worst = max(worst, abs(projected))
            if abs(projected) > 1e-12 and square[k]:
                before = alpha[k]
                alpha[k] = min(max(before - slope / square[k], 0), cost[k])
                w[index] += (alpha[k] - before) * labels[k] * value
        if worst < 1e-3:
            break
    return w


@dataclass
class Model:
    """ratio and weight for each feature bucket, the intercept and the curve's steepness."""

    bits: int
    ratio: object
    weight: object
    intercept: float
    steepness: float = 3.0

    def scores(self, texts: list[bytes]):
        import numpy as np

        row, feature = features(texts, self.bits)
        ends = len(texts)
        length = np.sqrt(np.bincount(row, self.ratio[feature] ** 2, ends))
        dot = np.bincount(row, (self.ratio * self.weight)[feature], ends)
        margin = np.divide(dot, length, out=np.zeros(ends), where=length > 0) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.steepness * margin, -500, 500)))


def fit(train: DataFrame, bits: int = BITS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """train: columns id, label (0 or 1) and text."""
    import numpy as np

    ship(train.sparkSession)
    width = 1 << bits
    counted = train.select("label", "text").mapInArrow(lambda b: _count(b, bits), "feature long, n0 long, n1 long")
    n, rows = np.zeros((2, width)), np.zeros(2)
    for r in counted.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().to_pylist():  # one row for each bucket at most
        if r["feature"] < 0:
            rows[:] = r["n0"], r["n1"]
        else:
            n[:, r["feature"]] = r["n0"], r["n1"]
    if not rows.all():
        return Model(bits, np.zeros(width), np.zeros(width), float(np.sign(rows[1] - rows[0])))
    smooth = n + SMOOTHING
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    ratio[n.sum(axis=0) == 0] = 0

    chosen = train.groupBy("id").count().orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample_rows)
    # Over the few ids chosen: as many as have sample_rows rows together.
    so_far = F.sum("count").over(W.orderBy(F.xxhash64("id", F.lit(SEED)), "id"))
    chosen = chosen.withColumn("rows", so_far).where(F.col("rows") <= sample_rows)
    sample = train.join(F.broadcast(chosen.select("id")), "id", "left_semi").select("label", "text").mapInArrow(lambda b: _vectors(b, bits), "label int, features binary").toArrow()
    vectors, labels = [], []
    for label, blob in zip(sample["label"].to_pylist(), sample["features"].to_pylist(), strict=True):
        index = np.frombuffer(blob, "<u4").astype(np.int64)
        value = ratio[index]
        length = np.sqrt(value @ value)
        vectors.append((np.append(index, width), np.append(value / length if length else value, 1.0)))
        labels.append(2 * label - 1)
    order = sorted(range(len(labels)), key=lambda k: (labels[k], len(vectors[k][0]), vectors[k][0].tobytes()))
    vectors, labels = [vectors[k] for k in order], np.array([labels[k] for k in order])
    sides = {y: max(1, int((labels == y).sum())) for y in (-1, 1)}
    cost = np.array([COST * len(labels) / 2 / sides[y] for y in labels])
    w = dual_coordinate_descent(vectors, labels, width + 1, cost)
    return Model(bits, ratio, w[:width], float(w[width]))


def _score(batches: Iterator, model) -> Iterator:
    """Batches of columns, the last one a text, with the text's score put after them."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        found = [model.value.scores(texts) for _, texts in _batched([batch.select([batch.num_columns - 1])])]
        scores = pa.array(np.concatenate(found) if found else [], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "__score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """score (0 to 1, higher: label 1 likelier) for each row, after the columns in carry (by default the id alone)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carry = [id_col] if carry is None else carry
    rows = docs.select(*(F.col(c) for c in carry if c != text_col), F.col(text_col))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    scored = rows.mapInArrow(lambda b: _score(b, sent), f"{kinds}, __score double")
    return scored.select(*carry, F.col("__score").alias("score"))


def training_rows(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Labelled rows of docs for which keep holds; labels without a class are left out."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = Scratch(docs.sparkSession, "labels").table(known, "known")
    # Counted to be few, labels are broadcast (12 bytes each) and texts stay where they are; else both sides are shuffled.
    known = F.broadcast(known) if known.count() <= MAX_BROADCAST_ROWS else known
    return docs.where(keep).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(known, "id")


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus
