"""Decontamination, classifier, language model, packing, sharding, preferences and archives."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from larkspur.llm import blobs, decontaminate, katz, packing, preferences, quality, sharding, warc
from pyspark.sql import functions as F

from .conftest import words

DATA = "/root/testdata/sf0.001"


def item_words(t):
    return re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", t.lower()).strip().split(" ")


def grams(w):
    return [" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))]


def brute_contamination(docs, items, least=0.8):
    known = {i: collections.Counter(grams(item_words(t))) for i, t in items}
    out = set()
    for d, t in docs:
        g = grams(item_words(t or ""))
        for i, c in known.items():
            m = sum(c.values())
            if not set(c) & set(g):
                continue
            best = max(sum((w & c).values()) / sum((w | c).values()) for s in range(max(1, len(g) - m + 1)) for w in [collections.Counter(g[s : s + m])])
            if best >= least:
                out.add((d, i, round(best, 6)))
    return out


def test_contamination_on_tables(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in decontaminate.find_contamination(docs, items).collect()}
    assert got == brute_contamination([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])


def test_contamination_edited_short_and_odd(spark, odd_docs, no_docs):
    rng = random.Random(7)
    item = words(rng, 80).split()
    edited = list(item)
    edited[40] = "other"
    far = [x if k % 6 else "no" for k, x in enumerate(item)]
    rows = [(1, f"{words(rng, 50)} {' '.join(item).upper()}, {words(rng, 9)}"), (2, f"{words(rng, 30)} {' '.join(edited)}"), (3, f"{words(rng, 30)} {' '.join(far)}"), (4, None), (5, ""), (None, " ".join(item)), (6, "one two three"), (7, "zero one two three four"), (6, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, " .. "), (4, "One, two three")], "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, items).collect())
    assert got == {(1, 1): 1, (2, 1): 1, (None, 1): 1, (6, 4): 2, (7, 4): 1}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {3, 4, 5}
    assert decontaminate.find_contamination(no_docs, items).count() == 0
    assert decontaminate.find_contamination(odd_docs, items.where("false")).count() == 0
    assert decontaminate.find_contamination(odd_docs, items).count() == 0


def test_many_items_meet_few_windows(spark, monkeypatch):
    """20,000 items that begin with one phrase, which many texts hold: windows are cut for the items a text may hold only."""
    rng, counted = random.Random(9), []
    phrase = "which of the following statements is true about the"
    items = [(k, f"{phrase} {words(rng, 25)}") for k in range(20_000)]
    docs = [(k, f"{words(rng, 20)} {items[37 * k][1]} {words(rng, 20)}" if k < 20 else f"{words(rng, 40)} {phrase} {words(rng, 40)}") for k in range(300)]
    inner = decontaminate.near_windows
    monkeypatch.setattr(decontaminate, "near_windows", lambda windows, *more: (counted.append(windows.count()), inner(windows, *more))[1])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, 37 * k) for k in range(20)}
    assert sum(counted) <= 2 * len(found)


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(63)
        b = a
        for _ in range(rng.randrange(0, 19)):
            b ^= 1 << rng.randrange(63)
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a long, b long")
    shared = F.arrays_overlap(decontaminate._blocks(F.col("a"), 18), decontaminate._blocks(F.col("b"), 18))
    assert df.where(~shared).count() == 0


def test_classifier_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality.remainder("doc_id", 3) == 1
    model = quality.fit(quality.training_rows(docs, labels, ~held))
    found = quality.score(docs, model).join(labels, "doc_id").where(held).select("score", "quality").collect()
    right = sum((r.score >= 0.5) == bool(r.quality) for r in found) / len(found)
    assert len(found) > 50 and right > 0.95
    bad = [r.score for r in found if not r.quality]
    good = [r.score for r in found if r.quality]
    assert sum(a < b for a in bad for b in good) / len(bad) / len(good) > 0.98


def test_classifier_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(quality.training_rows(odd_docs, none, F.lit(True)))
    assert {r.score for r in quality.score(odd_docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    model = quality.fit(quality.training_rows(odd_docs, one, F.lit(True)))
    assert all(r.score > 0.5 for r in quality.score(odd_docs, model).collect())
    assert quality.score(no_docs, model).count() == 0
    two = spark.createDataFrame([(4, 1), (9, 0), (6, 1), (12, 0)], "doc_id long, quality int")
    model = quality.fit(quality.training_rows(odd_docs, two, F.lit(True)))
    got = quality.score(odd_docs, model, carry=["doc_id", "text", "score"])
    assert got.columns[:2] == ["doc_id", "text"] and got.count() == odd_docs.count()


def plain_features(text, bits):
    """The feature buckets of a text, one word and one character at a time."""
    top, whole = 64 - bits, (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & whole
        return x ^ x >> 29

    def run(values):
        power, total = 1, 0
        for v in values:
            power = power * 0x100000001B3 & whole
            total += (v + 1) * power
        return mix(total & whole)

    kind = lambda b: 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b
    words, shapes = [], []
    for w in text.split():
        kinds = [kind(b) for b in w]
        use = [k for i, k in enumerate(kinds) if not (i and k == kinds[i - 1] and (k in (65, 97, 48) or i > 2 and kinds[i - 3 : i] == [k] * 3))]
        words.append(run([b + 32 if 65 <= b <= 90 else b for b in w]))
        shapes.append(0x5EED if len(words) > 1 and words[-1] == words[-2] else run(use))
    grams = [(1, h) for h in words] + [(2, h) for h in shapes]
    grams += [(3, mix(b * 31 + a & whole)) for a, b in zip(shapes, shapes[1:], strict=False)]
    grams += [(4, mix(((c * 31 + b) * 31 + a) & whole)) for a, b, c in zip(shapes, shapes[1:], shapes[2:], strict=False)]
    return {mix(h + salt * 0x51ED270B & whole) >> top for salt, h in grams}


def test_classifier_features_and_scores_by_hand(spark):
    """Buckets, log-count ratios, vectors and scores against plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    bits = 12
    found = {i: plain_features(t, bits) for i, t in rows}
    counts, sizes = np.ones((2, 1 << bits)), collections.Counter()
    seen = set()
    for i, _ in rows:
        if i in known and i not in held:
            sizes[known[i]] += 1
            seen |= found[i]
            for f in found[i]:
                counts[known[i], f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[[f for f in range(1 << bits) if f not in seen]] = 0
    model = quality.fit(quality.training_rows(docs, labels, quality.remainder("doc_id", 3) != 1), bits=bits)
    assert np.allclose(model.ratio, ratio) and min(sizes.values()) > 0
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, _ in rows:
        f = np.array(sorted(found[i]), int)
        length = math.sqrt(sum(ratio[k] ** 2 for k in f))
        margin = (sum(ratio[k] * model.weight[k] for k in f) / length if length else 0.0) + model.intercept
        assert got[i] == pytest.approx(1 / (1 + math.exp(-model.steepness * margin)))


def test_classifier_sample_is_bounded(spark):
    """Repeated ids bring no more rows than the bound."""
    rows = [(k // 40, k % 2, f"a b{k} c") for k in range(400)]
    train = spark.createDataFrame(rows, "id long, label int, text string")
    taken = []
    inner = quality.dual_coordinate_descent
    quality.dual_coordinate_descent = lambda rows, *more: (taken.append(len(rows)), inner(rows, *more))[1]
    try:
        for bound in (100, 39, 1000):
            quality.fit(train, bits=10, sample_rows=bound)
    finally:
        quality.dual_coordinate_descent = inner
    assert taken == [80, 0, 400]


def test_shards_by_hand(spark):
    """The matrix's moves and both permutations, one row at a time."""
    import xxhash

    docs = spark.createDataFrame([(k, "é" * (k % 7)) for k in range(700)], "doc_id long, text string").repartition(5, "doc_id")
    seed, shards = 99, 6
    rows = docs.select("doc_id", F.spark_partition_id().alias("source"), F.monotonically_increasing_id().alias("uid")).collect()
    mixed = lambda uid, salt: int.from_bytes(xxhash.xxh64(salt.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(uid.to_bytes(8, "little"), 42)).digest(), "big", signed=True)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sources = sorted(by)
    matrix = sharding.communication_matrix([len(by[s]) for s in sources], sharding.exact_sizes(700, shards), seed)
    cells = collections.defaultdict(list)
    for s, moves in zip(sources, matrix, strict=True):
        order = iter(sorted(by[s], key=lambda r: mixed(r.uid, seed)))
        for cell, n in enumerate(moves):
            cells[cell] += [next(order) for _ in range(n)]
    want = {r.doc_id: (cell, slot) for cell, held in cells.items() for slot, r in enumerate(sorted(held, key=lambda r: mixed(r.uid, seed + 1)))}
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, shards=shards, seed=seed).collect()}
    assert got == want


def test_dual_descent_solves_the_problem():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 5)), np.where(rng.normal(size=60) > 0, 1, -1)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0, 1, y)
    rows = [(np.arange(5), v) for v in x]
    w = quality.dual_coordinate_descent(rows, y, 5, cost=0.7, rounds=400)
    value = lambda w: w @ w / 2 + 0.7 * np.maximum(0, 1 - y * (x @ w)).sum()
    assert all(value(w) <= value(w + 0.02 * d) + 1e-3 for d in rng.normal(size=(200, 5)))


def brute_katz(docs, held, order):
    counts = [None] + [collections.Counter() for _ in range(order)]
    for (_, t), h in zip(docs, held, strict=True):
        if not h:
            w = (t or "").encode().lower().split() + [b"</s>"]
            counts[1].update((a,) for a in w)
            for m in range(2, order + 1):
                x = [b"<s>", *w]
                counts[m].update(tuple(x[k : k + m]) for k in range(len(x) - m + 1))
    cuts = [None]
    for m in range(1, order + 1):
        n = collections.Counter(counts[m].values())
        cuts.append([1.0, *katz.discounts([0, *(n[r] for r in range(1, 7))])])
    d = lambda m, n: cuts[m][n] if n < len(cuts[m]) else 1.0
    total = sum(counts[1].values())
    kept = sum(d(1, n) * n for n in counts[1].values())
    floor = total + (kept >= total)
    after = collections.defaultdict(list)
    for m in range(2, order + 1):
        for g in counts[m]:
            after[g[:-1]].append(g)
    memo = {}

    def context(h):
        if h not in memo:
            c = sum(counts[len(g)][g] for g in after[h])
            k = sum(d(len(g), counts[len(g)][g]) * counts[len(g)][g] for g in after[h])
            c1 = c + (k >= c)
            memo[h] = c1, (1 - k / c1) / (1 - sum(p(g[-1], h[1:]) for g in after[h]))
        return memo[h]

    def p(w, h):
        if not h:
            return d(1, counts[1][(w,)]) * counts[1][(w,)] / floor if (w,) in counts[1] else 1 - kept / floor
        if h not in after:
            return p(w, h[1:])
        c, alpha = context(h)
        n = counts[len(h) + 1][(*h, w)]
        return d(len(h) + 1, n) * n / c if n else alpha * p(w, h[1:])

    out = []
    for i, t in docs:
        x = [b"<s>", *(t or "").encode().lower().split(), b"</s>"]
        known = sum((w,) in counts[1] for w in x[1:])
        base = sum(math.log10((counts[1][(w,)] + 1) / (total + len(counts[1]) + 1)) for w in x[1:])
        out.append((i, len(x) - 1, known, total, base, sum(math.log10(p(x[k], tuple(x[max(0, k - order + 1) : k]))) for k in range(1, len(x)))))
    return out, p, counts, after


@pytest.mark.parametrize(("order", "chunk"), [(2, 100_000), (2, 500), (3, 2_000), (3, 100_000), (4, 1_500)])
def test_katz_matches_brute_force(spark, order, chunk):
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(0, 90)))) for k in range(150)] + [(None, None), (500, ""), (7, "w1 W1\tw2")]
    docs = spark.createDataFrame([(*r, k % 7 == 2) for k, r in enumerate(rows)], "doc_id long, text string, held boolean").repartition(3)
    want, p, counts, after = brute_katz(rows, [k % 7 == 2 for k in range(len(rows))], order)
    got = katz.score_corpus(docs, F.col("held"), order=order, chunk_tokens=chunk).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(mine, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    for h in list(after)[:25]:
        assert sum(p(w, h) for (w,) in counts[1]) + p(b"?", h) == pytest.approx(1)


def test_katz_in_one_chunk(spark):
    """All n-grams are the chunk's own; a second chunk shares some words and no more."""
    rng = random.Random(10)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(60))) for k in range(60)]
    alone = [(k, f"x{k} " * 30) for k in range(60, 70)]
    for docs, order in ((rows, 2), (rows, 3), (rows + alone, 3)):
        df = spark.createDataFrame([(*r, k % 7 == 2) for k, r in enumerate(docs)], "doc_id long, text string, held boolean")
        df = df.where("doc_id < 60").coalesce(1).unionByName(df.where("doc_id >= 60").coalesce(1))
        want = {i: s for i, *_, s in brute_katz(docs, [k % 7 == 2 for k in range(len(docs))], order)[0]}
        got = {r.doc_id: r.score for r in katz.score_corpus(df, F.col("held"), order=order).collect()}
        assert got == {i: pytest.approx(s, rel=1e-9) for i, s in want.items()}


def test_katz_tables_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b A c"), (3, "d")], "doc_id long, text string")
    got = katz.score_corpus(docs, F.col("doc_id") == 3, model_path=f"file://{tmp_path}/model")
    assert got.first().train_tokens == 8
    words = spark.read.parquet(f"file://{tmp_path}/model/ngrams1").collect()
    assert sorted(n for r in words for n in katz.open_words(r.model, r.kinds)[1].tolist()) == [0, 1, 2, 2, 3]  # d, c, b, end, a
    pairs = spark.read.parquet(f"file://{tmp_path}/model/ngrams2").collect()
    assert sum(n for r in pairs for n in katz.open_pairs(r.model)[2].tolist()) == 8


def test_katz_odd_rows(odd_docs, no_docs):
    assert katz.score_corpus(no_docs, F.lit(False)).count() == 0
    got = katz.score_corpus(odd_docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in got)
    got = katz.score_corpus(odd_docs, F.col("doc_id") == 4).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_blobs_round_trip():
    rng = np.random.default_rng(1)
    for a in (np.array([], np.int64), np.array([0]), rng.integers(0, 1 << 40, 1000), np.full(5, (1 << 62) + 3)):
        assert (blobs.unpack(blobs.pack(a)) == a).all()
        assert (blobs.unpack_sorted(blobs.pack_sorted(np.sort(a))) == np.sort(a)).all()
    x = rng.normal(size=50).round(1)
    assert (blobs.unpack_floats(blobs.pack_floats(x)) == x).all()


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    vocabularies = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN


def check_packed(rows, got, tokenizer, window=2048):
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    left = collections.Counter((r.doc_id, r.start, bytes(r.ids)) for r in got)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted({(r.start, bytes(r.ids)) for r in by[i] if r.doc_tokens == len(ids)})
        at = 0
        for start, data in pieces:
            if start == at and ids[at : at + len(data) // 4].tobytes() == data:
                left[i, start, data] -= 1
                at += len(data) // 4
        assert at == len(ids), i
    assert not any(left.values())
    sequences = collections.defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 > 0
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return sum(r.length for r in got) / (len(sequences) * window)


def test_packing(spark, odd_docs, odd_rows, no_docs, tokenizer):
    t, path, pattern = tokenizer
    check_packed(odd_rows + [], packing.pack_documents(odd_docs, path, pattern).collect(), t)
    assert packing.pack_documents(no_docs, path, pattern).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1)
    got = packing.pack_documents(docs, path, pattern).collect()
    assert check_packed([tuple(r) for r in docs.collect()], got, t) > 0.98


def test_special_strings_are_text(tokenizer):
    t, path, pattern = tokenizer
    for text in ("a<|endoftext|>b", "\u0000­ x", "  lead", "don't  stop\n\n", "𝔘nicode 漢字🙂"):
        assert packing.byte_bpe(path, pattern)(text) == t.encode(text, add_special_tokens=False).ids


def test_differencing():
    rng = random.Random(10)
    for _ in range(30):
        sizes = [rng.randrange(1, 257) for _ in range(rng.randrange(1, 120))]
        found = packing.windows(sizes, 1024)
        assert sorted(k for p in found for k in p) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in p) <= 1024 for p in found)
        sums = [sum(sizes[k] for k in p) for p in packing.differencing(sizes, 3)]
        assert sum(sums) == sum(sizes) and (len(sizes) < 30 or max(sums) - min(sums) <= 3)


def test_shards_in_ranges(spark):
    """Ordering sources and cells in ranges of the hash changes no row's place, nor does a part of a range without rows."""
    docs = spark.range(5_000).selectExpr("id AS doc_id", "repeat('x', int(id % 7)) AS text").repartition(3)
    whole = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, 4, seed=5).collect()}
    for rows_per_range in (1, 100, 900):
        got = sharding.shuffle_into_shards(docs, 4, seed=5, rows_per_range=rows_per_range)
        assert {r.doc_id: (r.shard, r.slot) for r in got.collect()} == whole
    assert [sharding.range_bits(n, 500) for n in (0, 500, 501, 1_000, 1_001)] == [0, 0, 1, 1, 2]
    assert sharding.shuffle_into_shards(docs.limit(0), 4, rows_per_range=1).count() == 0


def test_sharding(spark, odd_docs, odd_rows, no_docs):
    got = sharding.shuffle_into_shards(odd_docs, 5).collect()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 5
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.shuffle_into_shards(no_docs).count() == 0
    many = spark.range(0, 30_000, 1, 3).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shuffle_into_shards(many, 3, seed=1).collect()
    assert {(r.shard, r.slot) for r in rows} == {(s, k) for s in range(3) for k in range(10_000)}
    first = sorted(r.doc_id for r in rows if r.shard == 0)
    assert abs(sum(first) / len(first) - 15_000) < 300  # five deviations


def test_matrix_law():
    sizes, targets = [50, 0, 30], [40, 25, 15]
    seen = collections.Counter()
    for seed in range(3000):
        m = sharding.communication_matrix(sizes, targets, seed)
        assert [sum(r) for r in m] == sizes and [sum(c) for c in zip(*m, strict=True)] == targets
        seen[m[0][0]] += 1
    mean = sum(k * n for k, n in seen.items()) / 3000
    var = sum((k - mean) ** 2 * n for k, n in seen.items()) / 3000
    assert mean == pytest.approx(25, abs=0.2)
    assert var == pytest.approx(50 * 0.5 * 0.5 * 30 / 79, rel=0.12)
    big = sharding.hypergeometric(random.Random(1), 10**10, 4 * 10**10, 10**9)
    assert abs(big - 2.5 * 10**8) < 10**5


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "good")]
    other = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "bad <|im_end|>"), (2, 0, None, None), (None, 0, "user", "x")]
    schema = "pair_id long, turn long, role string, text string, c string, r string, side string, n int"
    pad = lambda rs: [(*x, "c", "r", "s", 1) for x in rs]
    a, b = spark.createDataFrame(pad([*rows, (None, 0, "user", "x")]), schema), spark.createDataFrame(pad(other), schema)
    found = preferences.format_preferences(a, b).collect()
    got = {r.pair_id: r for r in found if r.pair_id}
    one = got[1]
    assert one.common_turns == 3 and one.prompt.count("<|im_start|>") == 3
    assert one.chosen == "<|im_start|>assistant\ngood<|im_end|>\n"
    assert one.rejected == "<|im_start|>assistant\nbad < |im_end|><|im_end|>\n" or "< |im_" in one.rejected
    whole = one.prompt + one.chosen
    assert [whole[s.start : s.end] for s in one.chosen_spans] == ["good<|im_end|>\n"]
    assert [(one.prompt + one.rejected)[s.start : s.end].startswith("bad") for s in one.rejected_spans] == [True]
    assert (got[2].prompt, got[2].chosen, got[2].chosen_spans) == ("", "", []) and got[2].rejected.startswith("<|im_start|>user\n")
    said = "<|im_start|>user\nx<|im_end|>\n"  # without a pair id, a pair of its own
    assert sorted((r.common_turns, r.prompt, r.chosen, r.rejected) for r in found if r.pair_id is None) == [(0, "", "", said), (0, "", said, "")]
    assert preferences.format_preferences(a.where("false"), b.where("false")).count() == 0


def test_swapped_answers(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "d"), (2, 1, "assistant", "e"), (2, 1, "assistant", "e"), (2, None, "user", "x"), (3, 0, "user", "only"), (None, 0, "assistant", "z")]
    turns = spark.createDataFrame([(*r, "p", "q") for r in rows], "conv_id long, turn long, role string, text string, pair_id string, last string")
    chosen, rejected = ({(r.pair_id, r.turn, r.text) for r in df.collect()} for df in preferences.swapped_answers(turns))
    assert chosen == {r[:2] + r[3:] for r in rows}
    assert rejected == {(1, 0, "a"), (1, 1, "e"), (1, 2, "c"), (2, None, "x"), (2, 0, "d"), (3, 0, "only")}
    got = {r.pair_id: r for r in preferences.format_preferences(*preferences.swapped_answers(turns)).collect()}
    assert len(got) == 4 and got[None].chosen.endswith("z<|im_end|>\n") and got[None].rejected == ""
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == (turn("user", "a"), turn("assistant", "b") + turn("user", "c"), turn("assistant", "e") + turn("user", "c"))
    whole = got[1].prompt + got[1].chosen
    assert [whole[s.start : s.end] for s in got[1].chosen_spans] == ["b<|im_end|>\n"]


def test_preferences_on_long_texts_and_hot_ids(spark):
    """A text of a million characters, a pair of 3,000 turns, and many turns without a pair."""
    rows = [(1, 0, "user", "é" * 1_000_000), (1, 1, "assistant", "no")] + [(2, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(3000)] + [(None, k, "assistant", "same") for k in range(500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = preferences.format_preferences(*preferences.swapped_answers(turns)).collect()
    by = {r.pair_id: r for r in got}
    assert len(got) == 502 and len(by[1].prompt) == 1_000_000 + len("<|im_start|>user\n<|im_end|>\n")
    assert by[2].common_turns == 2998 and len(by[2].chosen_spans) == 1 and by[2].rejected.startswith("<|im_start|>user")


def pages_of(spark):
    big, rng = "ü<html>" * 300, random.Random(11)
    rows = [(k, f"https://www.ex{k % 3}.org/p?{k % 4}", "".join(rng.choice("abc\r\n ") for _ in range(rng.randrange(0, 3000)))) for k in range(60)]
    rows += [(100, "http://a/\r\nx", big), (101, None, big), (103, "u", big), (104, "", "small"), (105, "u", "small"), (106, "u", None), (None, "u", big), (107, "u", "WARC/1.1\r\n\r\n\r\n" * 100), (103, "u2", big)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, id string, bytes int").repartition(3), rows


def test_archives_round_trip(spark):
    pages, rows = pages_of(spark)
    got = warc.archive(pages, rows_per_file=10).collect()
    want = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        same = [x for x, _, h in rows if h == html and x is not None]
        revisit = len(data) >= 1000 and i != max(same)
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None] += 1
    assert collections.Counter((r.id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in got) == want
    order = [(r.url_key, r.captured) for r in got]
    assert order == sorted(order) and len({r.run for r in got}) > 3
    assert warc.archive(pages.where("false")).count() == 0


def test_merged_order_over_ranges(spark):
    pages, rows = pages_of(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/archives-test"
    warc.write_archives(pages, path, rows_per_file=7)
    got = [(r.url_key, r.captured) for r in warc.read_index(spark, path, rows_per_range=10).collect()]
    assert got == sorted(got) and len(got) == len(rows)


def test_control_characters_stay_apart(spark):
    urls = [f"http://a/{chr(c)}x" for c in (*range(32), 127)] + ["http://a/x", "http://a/%zz", "http://a/é"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("h"))
    got = {r.id: r.url for r in warc.archive(pages).collect()}
    assert got == {k: "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in u) for k, u in enumerate(urls)}


def test_archives_are_bounded_by_bytes(spark):
    """Payloads from nothing to more than a file takes; each file holds the bytes stated, or one record."""
    rng, path = random.Random(13), f"{spark.conf.get('spark.checkpoint.dir')}/archives-bytes"
    sizes = [0, 10, 900, 1100, 5000, 9000, 40_000, 300_000] * 12
    rows = [(k, "http://a/", "".join(rng.choices("abc é", k=n))) for k, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, path, rows_per_file=64, file_bytes=1 << 17)
    got = warc.read_index(spark, path).collect()
    assert {(r.id, r.payload_digest) for r in got} == {(k, hashlib.sha1(h.encode()).hexdigest()) for k, _, h in rows} and len(got) == len(rows)
    files = collections.defaultdict(list)
    for r in got:
        files[r.run].append(r.payload_bytes)
    assert all(len(x) == 1 or len(x) <= 64 and sum(x) <= 1 << 17 for x in files.values())
    assert sum(map(len, files.values())) / len(files) > 2


def test_archives_are_checked(spark):
    pages, _ = pages_of(spark)
    body = warc.records(pages.where("page_id = 5")).first().value
    assert len(warc.parse_archive("x", zlib_gz((body + warc.END).encode()))) == 1
    with pytest.raises(ValueError, match="digest"):
        warc.parse_archive("x", zlib_gz((body[:-1] + chr(ord(body[-1]) ^ 1) + warc.END).encode()))


def zlib_gz(data):
    import gzip

    half = len(data) // 2
    return gzip.compress(data[:half]) + gzip.compress(data[half:])  # members follow one another


def test_loser_tree():
    rng = random.Random(12)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(0, 9))) for _ in range(k)]
        merged = [runs[r][p] for r, p in warc.loser_tree(runs)]
        assert merged == sorted(x for run in runs for x in run)


def test_url_keys():
    assert warc.url_key("https://www.Example.org:443/A?b=1#c") == "org,example)/a?b=1"
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"
