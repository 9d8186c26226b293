"""Exact dedup, SimHash classes and substring spans against brute force."""

import collections
import hashlib
import random
import re

from larkspur.llm import exact_dedup, simhash, substring_dedup

from .conftest import words

DATA = "/root/testdata/sf0.001"


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def exact_groups(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[norm(t)].append(i)
    return by


def check_exact(rows, got):
    by = exact_groups(rows)
    want = collections.Counter()
    for i, t in rows:
        ids = [x for x in by[norm(t)] if x is not None]
        want[i, min(ids) if ids else None, len(by[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert kept == collections.Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in by})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_on_odd_rows(odd_docs, odd_rows, no_docs):
    check_exact(odd_rows, exact_dedup.exact_duplicates(odd_docs).collect())
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(exact_groups(odd_rows))


def test_exact_across_block_borders(spark):
    rng = random.Random(1)
    n = exact_dedup.BLOCK_CHARS
    a, b, c = ("".join(rng.choice("abc d") for _ in range(n)) for _ in range(3))
    texts = [a, a, a + b, a + b, b + a, a + b + c, a + b + c, a + a, a + a, a + a + a, a + b + a, (a + b)[:-1], a + "x", a + "x", a * 7, a * 7, a * 8]
    texts = [norm(t) for t in texts]
    rows = list(enumerate(texts, 100))
    check_exact(rows, exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def brute_classes(rows, width=4, radius=4):
    fps = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or ""))
        import xxhash

        grams = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
        n = [0] * 64
        for g in grams:
            h = xxhash.xxh64(g.encode(), seed=42).intdigest()
            for b in range(64):
                n[b] += h >> b & 1
        fps.append(sum(1 << b for b in range(64) if n[b] * 2 > len(grams)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return collections.Counter((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows))


def test_simhash_on_odd_rows(odd_docs, odd_rows, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute_classes(odd_rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_on_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute_classes(rows)


def near_pairs(values, radius):
    return [(a, b) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= radius]


def components(values, pairs):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {frozenset(v for v in values if find(v) == r) for r in {find(v) for v in values}}


def test_crowded_cells_lose_no_link(spark):
    """A dense cluster and chains, with cells so small that they are tiled."""
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    values = {centre}
    while len(values) < 400:
        v = rng.choice(sorted(values)) if rng.random() < 0.3 else centre
        for _ in range(rng.randrange(1, 7)):
            v ^= 1 << rng.randrange(63)
        values.add(v)
    values |= {rng.getrandbits(63) for _ in range(200)}
    values = sorted(values)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "node long, fp long")
    want = components(values, near_pairs(values, 4))
    for n in (len(values), 10**9):
        for cell_rows in (50, 100_000):
            found = [(values[r.a], values[r.b]) for r in simhash.links(df, n, cell_rows=cell_rows).collect()]
            assert components(values, found) == want


def test_confirmed_near_duplicates(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        base = words(rng, 400).split()
        rows.append((10 * k, " ".join(base)))
        for c in (1, 2):
            other = list(base)
            for _ in range(4):
                other[rng.randrange(len(other))] = f"x{rng.randrange(999)}"
            rows.append((10 * k + c, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert {k for k in kept if k % 10 == 0} == {10 * k for k in range(40)}
    assert len(kept) <= 41  # of 80 near copies, one may be missed


def brute_spans(rows, least=substring_dedup.MIN_SPAN):
    first, cuts = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        data, start, out = (rows[k][1] or "").encode(), 0, []
        for end in substring_dedup.boundaries(data):
            out.append((start, end, data[start:end]))
            start = end
        cuts.append((k, out))
    for k, out in cuts:
        for start, _, chunk in out:
            first.setdefault(chunk, (k, start))
    found = set()
    for k, out in cuts:
        run = []
        for start, end, chunk in [*out, (0, 0, None)]:
            if chunk is not None and first[chunk] != (k, start):
                run.append((start, end, rows[first[chunk][0]][0]))
                continue
            if run and run[-1][1] - run[0][0] >= least:
                size = collections.Counter()
                for a, b, source in run:
                    size[source] += b - a
                main = max(size, key=lambda i: (size[i], -i))
                found.add((rows[k][0], run[0][0], run[-1][1], main, tuple(sorted(i for i in size if size[i] >= least or i == main))))
            run = []
    return found


def test_spans_on_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").repartition(5)
    rows = [tuple(r) for r in docs.collect()]
    got = {(r.doc_id, r.start, r.end, r.source_id, tuple(r.source_ids)) for r in substring_dedup.repeated_spans(docs).collect()}
    assert got == brute_spans(rows)


def test_spans_on_odd_rows(odd_docs, odd_rows, no_docs):
    got = substring_dedup.repeated_spans(odd_docs).collect()
    assert {r.doc_id for r in got} == {7, 8, 12}
    assert all(r.source_id == 6 for r in got if r.doc_id == 8)
    assert substring_dedup.repeated_spans(no_docs).count() == 0


def test_shifted_passage_and_cut(spark):
    rng = random.Random(4)
    passage, a, b, c = words(rng, 60), words(rng, 200), words(rng, 201), words(rng, 50)
    rows = [(1, f"{a} {passage} {c}"), (2, f"zz {b} {passage}"), (3, words(rng, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.repeated_spans(docs)
    got = spans.collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(2, 1)}
    assert sum(r.end - r.start for r in got) > len(passage) * 0.6
    cut = {r.doc_id: r.text for r in substring_dedup.drop_spans(docs, spans).collect()}
    assert cut[1] == rows[0][1] and cut[3] == rows[2][1]
    s = got[0]
    assert cut[2] == rows[1][1][: s.start] + rows[1][1][s.end :]


def test_gear_hash_is_the_rolling_one():
    gears = [int(x) for x in substring_dedup.gears()]
    data, h, want, start = bytes(random.Random(6).randrange(256) for _ in range(5000)), 0, [], 0
    for k, byte in enumerate(data, 1):
        h = ((h << 1) + gears[byte]) & 0xFFFFFFFF
        if k - start == substring_dedup.MOST or (k - start >= substring_dedup.LEAST and h >> (32 - substring_dedup.MASK_BITS) == 0):
            want.append(k)
            start = k
    if start < len(data):
        want.append(len(data))
    assert substring_dedup.boundaries(data) == want


def test_ranges_of_hashes():
    """Equal ranges of 64 bits, only those that hold a hash, with more parts than hashes too."""
    import numpy as np
    from larkspur.llm.blobs import ranges_of

    rng = np.random.default_rng(4)
    for n, parts in ((0, 5), (1, 1), (50, 7), (50, 1000), (1000, 3)):
        hashes = np.sort(np.concatenate([rng.integers(0, 2**64 - 1, max(0, n - 2), np.uint64, endpoint=True), np.array([0, 2**64 - 1], np.uint64)[:n]]))
        want = {}
        for k, h in enumerate(hashes.tolist()):
            part = max(p for p in range(parts) if (p << 64) // parts <= h)
            want.setdefault(part, []).append(k)
        assert ranges_of(hashes, parts) == [(p, ks[0], ks[-1] + 1) for p, ks in want.items()]
