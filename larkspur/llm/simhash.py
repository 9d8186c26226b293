"""SimHash near-dedup with pivot distance tables.

Fingerprint: a bit is 1 where it is set in over half of the XXH64 hashes
(seed 42) of a text's word shingles. Documents whose fingerprints differ in at
most ``radius`` bits are linked; a class is a connected component.

Links are found between distinct fingerprints by their Hamming distances to
reference fingerprints (pivots). By the triangle inequality, two fingerprints
within the radius have distances to any pivot that differ by the radius at most;
pairs with a larger maximum coordinate difference are discarded and survivors
verified.

Two families of pivots are used. The first is zero and the 64 unit fingerprints,
dealt into B groups of bits: relative to the distance to zero, the
coordinate of unit i is -1 or +1 as bit i is set or not, so a fingerprint's
coordinates in a group are its bits there. Two fingerprints within the radius
agree in all the coordinates of at least B less the radius groups. Each choice
of that many groups gives a cell, and only fingerprints of one cell are
compared; no link is lost. B grows with the number of fingerprints, so that cells
of unrelated ones stay small. The second family is random: in a cell, its distance
table discards pairs before their distance is computed.

Links can ask for more: with ``confirm``, a fingerprint over shingles of another
length must be within a radius of its own. Near copies whose edits break many
long shingles differ in many bits of a long-shingle fingerprint, too many for
cells; short-shingle fingerprints find them (with two ``looks``, either of two
independent ones), the long one confirms them.
For shingles with similarity s, two fingerprints are expected to differ in
64 acos(2s / (1 + s)) / pi bits; ``radius_for`` adds three standard deviations.

The near copies of the pipeline are pairs with a stated Jaccard similarity of
their shingle sets. Fingerprints estimate it, wherever a text was edited, but two
texts at 0.8 differ in about a seventh of the bits, too many for cells that lose
nothing. There, fingerprints of LOOKS * 64 bits are dealt into cells by drawn
pivots: each of T tables takes the coordinates of k unit pivots, and texts that
agree in all k meet in a cell of it. k and T are those of least cost (rows moved
and pairs compared) for the number of texts at which a pair of exactly the stated
similarity is met with a probability of RECALL, and a closer one with more. In a
cell, the distance table of a second family of pivots discards pairs by their
coordinates. Here these are some of the cell's own fingerprints: at such a radius
random ones, half the bits away from all texts, tell nothing apart, while one of a
group of near copies tells it from all others. Then the distances over one to four
words of the fingerprint and the numbers of shingles discard pairs; survivors are
verified by the sets themselves.

In a cell, links are reduced to a star for each component found there, so a cell
of many near copies gives as many links as it has members. A cell larger than
``cell_rows`` is split into tiles of which each pair of parts meets in one: no
task holds an unbounded cell, and every pair is still compared. Only
fingerprints move, 8 bytes for each choice of groups.

Edge cases: null text counts as empty; texts without words have fingerprint
zero, which links like any other. Null ids sort after all others: a class of
null ids only has a null component_id. Repeated rows give a row each. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .components import star_roots

RADIUS, CELL_ROWS, CELL_AIM, PIVOTS, SEED, MAX_BROADCAST_ROWS, TILE_SHINGLES = 4, 16_384, 32, 12, 42, 1_000_000, 4_000_000
#: Near copies: words of a fingerprint, words carried to cells, the probability with which a pair at the stated similarity meets, standard deviations that its distance may lie above the expected one, near anchors that a row of a cell is tried with first, tables dealt at once, and the costs of moving a row to a cell and of comparing a pair there: nanoseconds of one core, the former with as much again for disk and network.
LOOKS, CARRIED, RECALL, SPREAD, NEAREST, TABLES_AT_ONCE, ROW_COST, PAIR_COST = 4, 4, 0.998, 4.5, 4, 24, 10_000, 3


def fingerprint(text: bytes, words: int, looks: int = 1) -> list[int]:
    """The fingerprints of one text, A-Z in lower case, as signed integers. Looks after the first are over scrambled hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return [0] * looks
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    counts, n = np.zeros((looks, 64), np.int64), len(tokens) - width + 1
    for k in range(0, n, 65536):
        spans = zip(starts[k : min(n, k + 65536)].tolist(), ends[k + width - 1 : k + width - 1 + 65536].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        for look in range(looks):
            if look:
                hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                hashes ^= hashes >> np.uint64(29)
            counts[look] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def _fingerprints(batches: Iterator, kinds: list[tuple[int, int]]) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = []
        for x in batch.column(1):
            text = x.as_buffer().to_pybytes() if x.is_valid else b""
            found.append([fp for words, looks in kinds for fp in fingerprint(text, words, looks)])
        columns = list(zip(*found, strict=True)) if found else [[]] * sum(looks for _, looks in kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", *(f"fp{k}" for k in range(len(columns)))])


def fingerprints(docs: DataFrame, kinds: list[tuple[int, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp0, fp1, ... (64 bits each, as a signed long) for each row. kinds: words of a shingle and number of looks."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = ", ".join(f"fp{k} long" for k in range(sum(looks for _, looks in kinds)))
    return rows.mapInArrow(lambda batches: _fingerprints(batches, kinds), f"id long, {names}")


def radius_for(similarity: float) -> int:
    """Differing bits of 64 that three in a thousand pairs of this similarity exceed, at most."""
    return distance_within(64, share_differing(similarity), 3)


def share_differing(similarity: float) -> float:
    """Of the bits of two fingerprints, those expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def distance_within(bits: int, share: float, deviations: float) -> int:
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def pivots(n: int = PIVOTS) -> list[int]:
    rng = random.Random(SEED)
    return [rng.getrandbits(64) for _ in range(n)]


def cell_stars(fps, seconds, radius: int, second_radius: int):
    """Of the fingerprints of a cell: places of members and of the first member of each one's component, without the first ones."""
    import numpy as np

    table = np.bitwise_count(fps[None, :] ^ np.array(pivots(), np.uint64)[:, None]).astype(np.int8)
    left, nodes, roots = np.arange(len(fps)), [], []
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            x = todo.pop()
            near = left[np.abs(table[0][left] - table[0][x]) <= radius]
            for column in table[1:]:
                if not len(near):
                    break
                near = near[np.abs(column[near] - column[x]) <= radius]
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]
            if seconds is not None:
                near = near[np.bitwise_count(seconds[near] ^ seconds[x]) <= second_radius]
            if len(near):
                left = np.setdiff1d(left, near, assume_unique=True)
                todo.extend(near.tolist())
                nodes.append(near)
                roots.append(np.full(len(near), root))
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (left, left)


def _links(batches: Iterator, radius: int, second_radius: int, small: int = 64) -> Iterator:
    """Links in rows sorted by cell (columns choice, cell, tile, node, fp and maybe second). Cells of a few rows are compared in step, at growing offsets; others by their own trees."""
    import numpy as np
    import pyarrow as pa

    refs = np.array(pivots(), np.uint64)

    def found(rows) -> pa.RecordBatch:
        cell, node, fps = rows[:3], rows[3], rows[4:].view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(axis=0))))
        sizes = np.diff(np.append(starts, len(node)))
        a, b = [], []
        places = np.flatnonzero(np.repeat((sizes <= small) & (sizes > 1), sizes))
        group, few = np.repeat(np.arange(len(sizes)), sizes)[places], fps[0][places]
        table = [np.bitwise_count(few ^ p).astype(np.int8) for p in refs]
        for step in range(1, small):
            at = np.flatnonzero(group[step:] == group[:-step])
            if not len(at):
                break
            for column in table:  # discarding as they go
                at = at[np.abs(column[at] - column[at + step]) <= radius]
            at = at[np.bitwise_count(few[at] ^ few[at + step]) <= radius]
            x, y = places[at], places[at + step]
            if len(fps) > 1:
                near = np.bitwise_count(fps[1][x] ^ fps[1][y]) <= second_radius
                x, y = x[near], y[near]
            a.append(node[x])
            b.append(node[y])
        for k in np.flatnonzero(sizes > small):
            own = slice(starts[k], starts[k] + sizes[k])
            x, y = cell_stars(fps[0][own], fps[1][own] if len(fps) > 1 else None, radius, second_radius)
            a.append(node[own][x])
            b.append(node[own][y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], names=["a", "b"])

    held = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns])
        rows = rows if held is None else np.concatenate((held, rows), axis=1)
        if not rows.shape[1]:
            continue
        last = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield found(rows[:, :cut])
        held = rows[:, cut:]
    if held is not None and held.shape[1]:
        yield found(held)


def groups_of_bits(blocks: int) -> list[int]:
    """Masks of the unit pivots in each group, as equal as 64 allows."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [sum(1 << i for i in range(a, b)) for a, b in itertools.pairwise(edges)]


def groups_for(fingerprints: int, radius: int) -> int:
    """Groups of bits so that unrelated fingerprints fill a cell with CELL_AIM on average at most."""
    blocks = radius + 2
    while fingerprints / 2 ** (64 * (blocks - radius) / blocks) > CELL_AIM:
        blocks += 1
    return blocks


def links(nodes: DataFrame, n: int, radius: int = RADIUS, second_radius: int = 0, cell_rows: int = CELL_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """Links (a, b) between n nodes, whose components are those of all pairs within the radius. nodes: node (distinct), fp and, for pairs that must also be near in it, second."""
    scratch, own = scratch or Scratch(nodes.sparkSession, "links"), [c for c in ("node", "fp", "second") if c in nodes.columns]
    blocks = groups_for(n, radius)
    masks = [sum(x) for x in itertools.combinations(groups_of_bits(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("choice", "cell")
    crowded = nodes.select(choices).groupBy("choice", "cell").count().where(F.col("count") > cell_rows).withColumn("parts", F.ceil(F.col("count") / cell_rows)).drop("count")
    crowded = scratch.table(crowded, f"crowded-{uuid.uuid4().hex}")
    cells, n_crowded = nodes.select(*own, choices), crowded.count()
    if n_crowded:  # as many cells as rows / cell_rows at most; broadcast if they are few, else joined by key
        cells = cells.join(F.broadcast(crowded) if n_crowded <= 20_000 else crowded, ["choice", "cell"], "left")
        part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
        tile = lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j)
        tiles = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), tile)))
        cells = cells.select("choice", "cell", F.explode(tiles).alias("tile"), *own)
    else:
        cells = cells.select("choice", "cell", F.lit(-1).cast("long").alias("tile"), *own)
    dealt = cells.repartition("choice", "cell", "tile").sortWithinPartitions("choice", "cell", "tile", "node")
    return dealt.mapInArrow(lambda batches: _links(batches, radius, second_radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, looks: int = 1, confirm: tuple[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable), n_rows and n_fingerprints of the class.

    looks: independent fingerprints, of which a link needs one within the
    radius. confirm: words and similarity of another fingerprint that a link
    must also be near in.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, [(words, looks), *([(confirm[0], 1)] if confirm else [])], id_col, text_col), "rows")
    own = rows.columns[1:]
    nodes = rows.groupBy(*own).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.table(nodes, "nodes")
    n, found = nodes.count(), None
    for look in range(looks):
        by = nodes.select("node", F.col(f"fp{look}").alias("fp"), *([F.col(own[-1]).alias("second")] if confirm else []))
        some = links(by, n, radius, radius_for(confirm[1]) if confirm else 0, scratch=scratch)
        found = some if found is None else found.unionByName(some)
    member = nodes.join(star_roots(found, scratch), "node", "left").withColumn("root", F.coalesce("root", "node"))
    member = scratch.table(member, "member")
    classes = member.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_fingerprints"))
    named = member.select(*own, "root").join(scratch.table(classes, "classes"), "root").drop("root")
    return rows.join(named, own).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id", "n_rows", "n_fingerprints")


def shingle_hashes(text: bytes, words: int):
    """The distinct XXH64 hashes of a text's shingles, sorted; A-Z in lower case."""
    import numpy as np
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    grams = {b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))}
    return np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def signature(hashes) -> list[int]:
    """Of distinct shingle hashes: the LOOKS words of the fingerprint, as signed integers."""
    import numpy as np

    ones = np.zeros((LOOKS, 64), np.int64)
    for k in range(0, len(hashes), 4096):
        some = hashes[k : k + 4096]
        for look in range(LOOKS):
            if look:
                some = (some ^ (some >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                some ^= some >> np.uint64(29)
            ones[look] += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view(np.int64).ravel().tolist()


def meeting(bits: int, tables: int, share: float, width: int = 64 * LOOKS) -> float:
    """The probability that two fingerprints agree in all drawn bits of a table, where each of their bits differs with the probability share."""
    found = 0.0
    for d in range(width - bits + 1):
        likely = math.exp(math.lgamma(width + 1) - math.lgamma(d + 1) - math.lgamma(width - d + 1) + d * math.log(share) + (width - d) * math.log1p(-share)) if share else float(d == 0)
        agree = math.prod((width - d - i) / (width - i) for i in range(bits))
        found += likely * -math.expm1(tables * math.log1p(-agree)) if agree < 1 else likely
    return found


@functools.lru_cache(maxsize=64)
def tables_for(texts: int, similarity: float) -> tuple[int, int]:
    """Bits of a table and number of tables, of least cost for so many texts."""
    share, best = share_differing(similarity), (math.inf, 0, 0)
    for bits in range(1, 41):
        low, high = 0, 1
        while meeting(bits, high, share) < RECALL and high * ROW_COST < best[0]:
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if meeting(bits, middle, share) >= RECALL else (middle, high)
        best = min(best, (high * (ROW_COST + texts / 2**bits / 2 * PAIR_COST), bits, high))
    return best[1:]


def table_masks(bits: int, tables: int) -> list[list[int]]:
    """For each table the drawn unit pivots, as a mask over each word of the fingerprint."""
    rng, out = random.Random(SEED), []
    for _ in range(tables):
        masks = [0] * LOOKS
        for k in rng.sample(range(64 * LOOKS), bits):
            masks[k // 64] |= 1 << k % 64
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def _hashes_of(batch, words: int) -> list:
    return [shingle_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch.column(1)]


def _signatures(batches: Iterator, words: int) -> Iterator:
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    for batch in batches:
        sets = _hashes_of(batch, words)
        fps = [signature(x) for x in sets]
        columns = [batch.column(0), pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), *(pa.array([x[k] for x in fps], pa.int64()) for k in range(LOOKS))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "shingles", *(f"fp{k}" for k in range(LOOKS))])


def _shingle_sets(batches: Iterator, words: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = batch.slice(k, 256)
            sets = _hashes_of(some, words)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([some.column(0), lists], names=["id", "shingles"])


class Cell:
    """Fingerprints and numbers of shingles of the texts that met, how far apart they may be, and their distances to pivots: PIVOTS of the fingerprints, evenly spread over the rows."""

    def __init__(self, fps, shingles, bounds: list[int], similarity: float):
        import numpy as np

        self.fps, self.shingles, self.bounds, self.similarity = fps, shingles, bounds, similarity
        refs = fps[:, np.linspace(0, fps.shape[1] - 1, min(PIVOTS, fps.shape[1])).astype(np.int64)]
        self.table = np.bitwise_count(fps[:, None, :] ^ refs[:, :, None]).sum(axis=0, dtype=np.int16)

    def near(self, rows, columns):
        """Places (of rows, of columns) of the pairs that nothing discards, and their distances. Only columns before the row are met."""
        import numpy as np

        word, coordinate, radius = self.fps[0], self.table[0], self.bounds[-1]
        met = np.abs(coordinate[rows][:, None] - coordinate[columns][None, :]) <= radius
        met &= np.bitwise_count(word[rows][:, None] ^ word[columns][None, :]) <= self.bounds[0]
        r, c = np.nonzero(met)
        x, y = rows[r], columns[c]
        ahead = y < x
        x, y = x[ahead], y[ahead]
        for coordinate in self.table[1:]:  # discarding as they go
            some = np.abs(coordinate[x] - coordinate[y]) <= radius
            x, y = x[some], y[some]
        far = np.bitwise_count(word[x] ^ word[y]).astype(np.int16)
        for other, bound in zip(self.fps[1:], self.bounds[1:], strict=True):
            far += np.bitwise_count(other[x] ^ other[y])
            some = far <= bound
            x, y, far = x[some], y[some], far[some]
        some = np.minimum(self.shingles[x], self.shingles[y]) / np.maximum(self.shingles[x], self.shingles[y]) >= self.similarity
        return x[some], y[some], far[some]

    def anchored(self, nearest: int, block: int = 128):
        """Pairs of rows and earlier anchors, and whether some pairs are left. A row that is near ``nearest`` anchors meets the nearest of them and becomes no anchor, so that a group of near copies gives few pairs a row."""
        import numpy as np

        m, anchors, left, a, b = self.fps.shape[1], np.empty(0, np.int64), False, [], []
        for start in range(0, m, block):
            rows = np.arange(start, min(m, start + block))
            x, y, far = self.near(rows, np.concatenate((anchors, rows)))
            if np.bincount(x - start, minlength=1).max() < nearest:
                a.append(x)
                b.append(y)
                anchors = np.concatenate((anchors, rows))
                continue
            order = np.lexsort((y, far, x))
            x, y = x[order], y[order]
            open_, ends = np.ones(len(rows), bool), np.searchsorted(x, np.append(rows, m))
            for k, row in enumerate(rows):
                met = y[ends[k] : ends[k + 1]]
                met = met[(met < start) | open_[np.maximum(met - start, 0)]]
                if len(met) >= nearest:
                    met, open_[k], left = met[:nearest], False, True
                a.append(np.full(len(met), row))
                b.append(met)
            anchors = np.concatenate((anchors, rows[open_]))
        return np.concatenate(a), np.concatenate(b), left

    def open_rows(self, roots, block: int = 128):
        """Whether a row is near one of another root."""
        import numpy as np

        _, place, n = np.unique(roots, return_inverse=True, return_counts=True)
        order = np.argsort(place != n.argmax(), kind="stable")  # the largest component comes first, and needs no comparison within
        own, out = Cell(self.fps[:, order], self.shingles[order], self.bounds, self.similarity), np.zeros(len(roots), bool)
        for start in range(int(n.max()), len(roots), block):
            rows = np.arange(start, min(len(roots), start + block))
            x, y, _ = own.near(rows, np.arange(rows[-1] + 1))
            x, y = order[x], order[y]
            differ = roots[x] != roots[y]
            out[x[differ]] = out[y[differ]] = True
        return out


def joining_links(nodes, roots, sets: list, similarity: float) -> list[tuple[int, int]]:
    """Links that join different roots: of all pairs of nodes whose shingle sets have the similarity, as many as it takes to join what they join.

    A node's common shingles with all others are counted at once, through the
    lists of nodes that hold a shingle; no pair is stored.
    """
    import numpy as np

    sizes = np.array([len(x) for x in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(place, kind="stable")
    holders, ends = np.repeat(np.arange(len(sets)), sizes)[order], np.searchsorted(place[order], np.arange(place.max(initial=-1) + 2))
    parent = {r: r for r in roots.tolist()}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    values, n = np.unique(roots, return_counts=True)
    out = []
    for x in np.flatnonzero(roots != values[n.argmax()]).tolist():
        own = place[begin[x] : begin[x] + sizes[x]]
        starts, lengths = ends[own], ends[own + 1] - ends[own]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
        common = np.bincount(holders[at], minlength=len(sets))
        for y in np.flatnonzero((common / (sizes + sizes[x] - common) >= similarity) & (roots != roots[x])).tolist():
            a, b = find(roots[x].item()), find(roots[y].item())
            if a != b:
                parent[a] = b
                out.append((nodes[x].item(), nodes[y].item()))
    return out


def _join_left(table, similarity: float):
    import numpy as np
    import pyarrow as pa

    shingles = table.column("shingles").combine_chunks()
    values, ends = shingles.values.to_numpy(), shingles.offsets.to_numpy()
    sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    found = joining_links(table.column("node").to_numpy(), table.column("root").to_numpy(), sets, similarity)
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _candidates(batches: Iterator, bounds: list[int], similarity: float, nearest: int) -> Iterator:
    """Of rows sorted by cell (columns cell, tile, node, shingles, fp0, ... and maybe root): pairs a, b of rows and anchors, and the cells in which that leaves pairs.

    With roots: as a, with their cell, the rows that are near one of another root.
    """
    import numpy as np
    import pyarrow as pa

    def batch_of(a, b, cells, *nulls: bool) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(x), pa.int64()) if x else pa.nulls(n, pa.int64()) for x, n in zip((a, b, cells), nulls, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "cell"])

    def found(rows) -> Iterator:
        starts = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))))
        a, b, cells = [], [], []
        for start, end in zip(starts.tolist(), np.append(starts[1:], rows.shape[1]).tolist(), strict=True):
            if end - start < 2:
                continue
            own = rows[:, start:end]
            cell = Cell(np.ascontiguousarray(own[4 : 4 + CARRIED]).view(np.uint64), own[3], bounds, similarity)
            if rows.shape[0] == 4 + CARRIED:
                x, y, more = cell.anchored(nearest)
                a.append(own[2][y])
                b.append(own[2][x])
                if more:
                    cells.append(own[0, :1])
            else:
                some = cell.open_rows(own[4 + CARRIED])
                a.append(own[2][some])
                cells.append(own[0][some])
        n = sum(map(len, a))
        if rows.shape[0] > 4 + CARRIED:
            yield batch_of(a, [], cells, n, n, n)
            return
        yield batch_of(a, b, [], n, n, n)
        n = len(cells)
        yield batch_of([], [], cells, n, n, n)

    held = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns])
        rows = rows if held is None else np.concatenate((held, rows), axis=1)
        if not rows.shape[1]:
            continue
        last = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield from found(rows[:, :cut])
        held = rows[:, cut:]
    if held is not None and held.shape[1]:
        yield from found(held)


def verified_links(docs: DataFrame, nodes: DataFrame, n: int, words: int, similarity: float, scratch: Scratch, cell_rows: int = CELL_ROWS, nearest: int = NEAREST, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Links (a, b) whose shingle sets have the similarity at least. Their components are those of all such pairs that meet in a cell.

    docs: id and text; nodes (n of them): node (an id), shingles (their number),
    fp0, .... Rows of a cell are compared in two rounds. The first compares a row
    with the cell's anchors, which are all rows but those near several anchors;
    it joins a large group of near copies. The second compares what is left: in
    cells with such rows, those near a row of another component meet with their
    whole shingle sets, and give as few links as join them.
    Tables are dealt a few at a time, so that the disk holds few rows per text at once.
    """
    share, carried = share_differing(similarity), [f"fp{k}" for k in range(CARRIED)]
    bounds = [distance_within(64 * (k + 1), share, SPREAD) for k in range(CARRIED)]
    masks = table_masks(*tables_for(max(n, 1), similarity))

    def tiled(cells: DataFrame, crowded: DataFrame, own: list) -> DataFrame:
        """Rows with a tile of their cell: of a crowded one's parts, any two meet in one."""
        names = [x if isinstance(x, str) else "shingles" for x in own]
        if not (n_crowded := crowded.count()):
            return cells.select("cell", F.lit(-1).cast("long").alias("tile"), *names)
        # As many cells as rows / cell_rows at most; broadcast if they are few, else joined by key.
        cells = cells.join(F.broadcast(crowded) if n_crowded <= 20_000 else crowded, "cell", "left")
        part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
        tile = lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j)
        tiles = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), tile)))
        return cells.select("cell", F.explode(tiles).alias("tile"), *names)

    def met(texts: DataFrame, first: int, own: list[str], only: DataFrame | None = None) -> DataFrame:
        drawn = enumerate(masks[first : first + TABLES_AT_ONCE], first)
        cell = F.explode(F.array(*(F.xxhash64(F.lit(t), *(F.col(f"fp{k}").bitwiseAND(F.lit(m)) for k, m in enumerate(words_of) if m)) for t, words_of in drawn))).alias("cell")
        cells = texts.select(cell, *own)
        if only is not None:
            cells = cells.join(only, "cell", "left_semi")
        crowded = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("parts")).where("parts > 1")
        cells = tiled(cells, scratch.table(crowded, f"crowded-{uuid.uuid4().hex}"), own)
        dealt = cells.repartition("cell", "tile").sortWithinPartitions("cell", "tile", "node")
        return dealt.mapInArrow(lambda batches: _candidates(batches, bounds, similarity, nearest), "a long, b long, cell long")

    def in_turns(texts: DataFrame, own: list[str], name: str, only: DataFrame | None = None) -> DataFrame:
        rounds = [scratch.table(met(texts, first, own, only), f"{name}{first}") for first in range(0, len(masks), TABLES_AT_ONCE)]
        together = scratch.table(functools.reduce(DataFrame.unionByName, rounds).distinct(), name)
        scratch.drop(*(f"{name}{first}" for first in range(0, len(masks), TABLES_AT_ONCE)))
        return together

    def shingle_sets(asked: DataFrame) -> DataFrame:
        asked = scratch.table(asked.distinct(), f"asked-{uuid.uuid4().hex}")
        few = F.broadcast(asked) if asked.count() <= MAX_BROADCAST_ROWS else asked  # 8 bytes each; texts then stay where they are
        return docs.join(few, "id", "left_semi").mapInArrow(lambda batches: _shingle_sets(batches, words), "id long, shingles array<long>")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        sets = scratch.table(shingle_sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))), f"{name}-sets")
        # Row by row in the JVM: the sets of long texts would make large Arrow batches.
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        # The lambda lets the sets be met once, though their common part is used twice.
        alike = F.transform(F.array(F.size(F.array_intersect("x", "y"))), lambda n: n / (F.size("x") + F.size("y") - n))[0]
        found = scratch.table(both.where(alike >= similarity).select("a", "b"), name)
        scratch.drop(f"{name}-sets")
        return found

    own = ["node", F.col("shingles").cast("long").alias("shingles"), *carried]
    tried = in_turns(nodes, own, "tried")
    found = verified(tried.where("cell IS NULL").select("a", "b"), "verified")
    large = scratch.table(tried.where("cell IS NOT NULL").select("cell").distinct(), "large")
    scratch.drop("tried")
    n_large = large.count()
    if not n_large:
        return found
    known = nodes.join(star_roots(found, scratch), "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = scratch.table(known, "known")
    left = in_turns(known, [*own, "root"], "left", F.broadcast(large) if n_large <= 200_000 else large).select("cell", F.col("a").alias("node"))
    left = left.join(known.select("node", "root", "shingles"), "node")
    # Tiles again, by the numbers of shingles.
    crowded = left.groupBy("cell").agg(F.ceil(F.sum("shingles") / tile_shingles).alias("parts")).where("parts > 1")
    rows = tiled(left, scratch.table(crowded, "crowded"), ["node", "root"])
    sets = scratch.table(shingle_sets(left.select(F.col("node").alias("id"))), "left-sets")
    rows = rows.join(sets.withColumnRenamed("id", "node"), "node")
    more = rows.groupBy("cell", "tile").applyInArrow(lambda table: _join_left(table, similarity), "a long, b long")
    return found.unionByName(scratch.table(more, "more"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, with all columns, that are first in their class. Ids must be distinct; rows without an id stay, and link no others.

    Two texts are linked if the sets of their shingles of ``words`` words have
    the Jaccard similarity at least; a class is a connected component.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    fps = [f"fp{k}" for k in range(LOOKS)]
    rows = texts.mapInArrow(lambda batches: _signatures(batches, words), f"id long, digest binary, shingles int, {', '.join(f'{c} long' for c in fps)}")
    rows = scratch.table(rows, "rows")
    nodes = rows.groupBy("digest").agg(F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("shingles", *fps))).drop("digest")
    nodes = scratch.table(nodes, "nodes")
    later = star_roots(verified_links(texts, nodes, nodes.count(), words, similarity, scratch), scratch).select("node")
    firsts = nodes.select("node").join(later, "node", "left_anti")
    repeats = rows.select(F.col("id").alias("__repeat")).join(firsts, F.col("__repeat") == F.col("node"), "left_anti")
    return docs.join(repeats, F.col(id_col) == F.col("__repeat"), "left_anti")
