"""The near-dedup stage's links against the exact similarity of shingle sets."""

import random

import numpy as np
import pytest
from larkspur.llm import simhash
from larkspur.llm.common import Scratch
from pyspark.sql import functions as F

from .conftest import words
from .test_dedup import components


def grams(text, width=5):
    w = text.lower().split()
    return {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}


def similarity(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())


def test_texts_below_the_similarity_stay(spark):
    """Scattered edits leave word pairs alike, but not shingles of five words."""
    rng, rows = random.Random(7), []
    for k in range(30):
        base = words(rng, 400).split()
        other = list(base)
        for at in range(10, 390, 33):
            other[at] = f"x{rng.randrange(999)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        assert 0.7 < similarity(rows[-1][1], rows[-2][1]) < 0.8
    assert kept(spark, rows) == [i for i, _ in rows]


@pytest.mark.parametrize("size", [200, 600])
def test_block_edits_are_found(spark, size):
    """A block added or cut, at the start, within or at the end."""
    rng, rows = random.Random(size), []
    for k in range(120):
        base = words(rng, size).split()
        aim = 0.80 + 0.1 * (k % 11) / 10
        block, at = int((size - 8) / aim) - size, [0, size // 3, size][k % 3]
        other = base[:at] + words(rng, block).split() + base[at:]
        rows += [(2 * k + k % 2, " ".join(base)), (2 * k + 1 - k % 2, " ".join(other))]
        assert 0.8 <= similarity(rows[-1][1], rows[-2][1]) < 0.95
    assert kept(spark, rows) == [2 * k for k in range(120)]


def test_large_groups_lose_no_link(spark):
    """Cells beyond a few rows, tiled: the components are those of all pairs."""
    rng, texts = random.Random(8), {}
    for family in range(2):
        base = words(rng, 200).split()
        for k in range(60):
            other = list(base)
            for _ in range(rng.randrange(5)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(999)}"
            texts[100 * family + k] = " ".join(other)
    texts = {i: t for k, (i, t) in enumerate(sorted(texts.items())) if t not in list(texts.values())[:k]}
    ids = sorted(texts)
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and similarity(texts[a], texts[b]) >= 0.8])
    docs = spark.createDataFrame(sorted(texts.items()), "id long, text string")
    sets = {i: simhash.shingle_hashes(t.encode(), 5) for i, t in texts.items()}
    nodes = spark.createDataFrame([(i, len(x), *simhash.signature(x)) for i, x in sets.items()], f"node long, shingles int, {', '.join(f'fp{k} long' for k in range(simhash.LOOKS))}")
    for nearest, cell_rows, n, tile in ((1000, 100_000, 0, 10**6), (1, 100_000, 0, 10**6), (2, 100_000, 10**6, 10**6), (1, 10, 0, 2000)):
        found = simhash.verified_links(docs, nodes, n or len(ids), 5, 0.8, Scratch(spark, "test"), cell_rows=cell_rows, nearest=nearest, tile_shingles=tile).collect()
        assert all(similarity(texts[r.a], texts[r.b]) >= 0.8 for r in found)
        assert components(ids, [(r.a, r.b) for r in found]) == want


def test_a_cell_leaves_no_near_pair():
    """Anchored pairs and, where some are left, pairs between the components of those that are links: all links' components."""
    rng = random.Random(11)
    fps = []
    for _ in range(12):
        base = [rng.getrandbits(64) for _ in range(simhash.CARRIED)]
        for _ in range(rng.randrange(1, 90)):
            fps.append([w ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (1 << 64) - 1 for w in base])
    rng.shuffle(fps)
    sizes = [rng.randrange(80, 120) for _ in fps]
    bounds = [16 + 8 * k for k in range(simhash.CARRIED)]
    table = np.array(fps, np.uint64).T.copy()
    cell = simhash.Cell(table, np.array(sizes), bounds, 0.8)
    far = lambda x, y, k: sum((fps[x][i] ^ fps[y][i]).bit_count() for i in range(k + 1))
    near = {(a, b) for b in range(len(fps)) for a in range(b) if all(far(a, b, k) <= bounds[k] for k in range(simhash.CARRIED)) and min(sizes[a], sizes[b]) / max(sizes[a], sizes[b]) >= 0.8}
    for nearest in (1, 4, 1000):
        x, y, left = cell.anchored(nearest)
        tried = set(zip(y.tolist(), x.tolist(), strict=True))
        assert tried <= near and left == (nearest < 1000)
        links = {p for p in tried if hash(p) % 3}  # some tried pairs turn out to be links
        roots = {k: min(group) for group in components(range(len(fps)), links) for k in group}
        more = np.flatnonzero(cell.open_rows(np.array([roots[k] for k in range(len(fps))])))
        assert set(more.tolist()) == {k for p in near if roots[p[0]] != roots[p[1]] for k in p}
        if nearest == 1000:
            assert tried == near


def test_joining_links():
    """As few links as join what all similar pairs join."""
    rng = random.Random(12)
    base = rng.sample(range(10**6), 60)
    sets = [np.array(sorted({*rng.sample(base, rng.randrange(45, 60)), *rng.sample(range(10**6), rng.randrange(8))})) for _ in range(150)]
    roots = np.array([rng.choice([0, 0, 1, 2, k]) + 500 for k in range(150)])
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8
    pairs = [(a, b) for b in range(150) for a in range(b) if alike(sets[a].tolist(), sets[b].tolist())]
    same = [(a, b) for b in range(150) for a in range(b) if roots[a] == roots[b]]
    found = simhash.joining_links(np.arange(150) + 1000, roots, sets, 0.8)
    links = [(a - 1000, b - 1000) for a, b in found]
    assert all(tuple(sorted(p)) in set(pairs) for p in links)
    assert components(range(150), same + links) == components(range(150), same + pairs)
    assert len(links) == len(components(range(150), same)) - len(components(range(150), same + pairs))


def test_tables_grow_slowly():
    """Rows per text have no large step, and grow as a power of the number of texts of about a third."""
    sizes = [10**k for k in range(5, 11)]
    rows = [simhash.tables_for(n, 0.8)[1] for n in sizes]
    assert rows == sorted(rows) and rows[0] <= 24
    assert all(b / a <= 10**0.45 for a, b in zip(rows, rows[1:], strict=False)) and rows[-1] / rows[0] <= 10 ** (0.36 * 5)
    share = simhash.share_differing(0.8)
    assert all(simhash.meeting(*simhash.tables_for(n, 0.8), share) >= simhash.RECALL for n in sizes)


@pytest.mark.parametrize("texts", [10_000, 10_000_000])
def test_recall_of_the_tables(texts):
    """Generated copies with a similarity of 0.80 to 0.85, by scattered words and by blocks, as if among so many texts."""
    rng, met, n = random.Random(texts), 0, 300
    masks = simhash.table_masks(*simhash.tables_for(texts, 0.8))
    share = simhash.share_differing(0.8)
    for k in range(n):
        size = rng.choice([60, 200, 700])
        base, other = words(rng, size).split(), None
        while other is None or not 0.8 <= similarity(" ".join(base), " ".join(other)) < 0.85:
            other = list(base)
            if k % 2:
                at, block = rng.randrange(size), rng.randrange(1, size // 4)
                other[at:at] = words(rng, block).split()
            else:
                for at in rng.sample(range(size), max(1, rng.randrange(size // 60 + 1, size // 30 + 2))):
                    other[at] = f"x{rng.randrange(999)}"
        a, b = (simhash.signature(simhash.shingle_hashes(" ".join(x).encode(), 5)) for x in (base, other))
        close = all(sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[: k + 1], b[: k + 1], strict=True)) <= simhash.distance_within(64 * (k + 1), share, simhash.SPREAD) for k in range(simhash.CARRIED))
        met += close and any(all((x ^ y) & m == 0 for x, y, m in zip(a, b, t, strict=True)) for t in masks)
    assert met / n >= 0.97


def test_odd_rows_of_the_near_stage(odd_docs, no_docs):
    assert simhash.drop_near_duplicates(no_docs).count() == 0
    got = simhash.drop_near_duplicates(odd_docs.where(F.col("doc_id").isNull() | ~F.col("doc_id").isin(5, 7)))
    assert got.columns == odd_docs.columns
    assert sorted(r.doc_id for r in got.select("doc_id").collect() if r.doc_id is not None) == [-3, 1, 6, 9, 10, 12]
    assert got.where("doc_id IS NULL").count() == 2


def test_a_cell_discards_by_its_distance_table():
    """Pivots tell groups of near copies apart, and discard no pair within the bounds."""
    rng = np.random.default_rng(5)
    fps = np.repeat(rng.integers(0, 2**64, (4, 6), np.uint64), 30, axis=1)
    for _ in range(12):
        fps[rng.integers(0, 4, 180), np.arange(180)] ^= np.uint64(1) << rng.integers(0, 64, 180, np.uint64)
    bounds = [simhash.distance_within(64 * (k + 1), simhash.share_differing(0.8), simhash.SPREAD) for k in range(4)]
    order = rng.permutation(180)
    cell = simhash.Cell(np.ascontiguousarray(fps[:, order]), np.full(180, 50), bounds, 0.8)
    far = np.bitwise_count(cell.fps[:, :, None] ^ cell.fps[:, None, :]).astype(int)
    table = np.array([far.sum(axis=0)[row] for row in np.linspace(0, 179, simhash.PIVOTS).astype(int)])
    assert (cell.table == table).all()
    apart = np.abs(table[:, :, None] - table[:, None, :]).max(axis=0)
    assert (apart > bounds[-1]).mean() > 0.5
    near = (far.cumsum(axis=0) <= np.array(bounds)[:, None, None]).all(axis=0) & (np.arange(180)[None, :] < np.arange(180)[:, None])
    x, y, distance = cell.near(np.arange(180), np.arange(180))
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    assert (distance == far.sum(axis=0)[x, y]).all()
    # A table that sets rows apart keeps them apart, whatever their fingerprints.
    cell.table = np.where(np.arange(180) % 2, 0, 256).astype(np.int16)[None, :]
    x, y, _ = cell.near(np.arange(180), np.arange(180))
    assert len(x) and (x % 2 == y % 2).all()
