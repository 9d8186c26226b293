"""The stages of the pipeline against brute force, each on its own input."""

import collections
import re

import corpus_pipeline
import pytest
from larkspur.llm import quality

from .test_dedup import components, norm
from .test_near_copies import grams
from .test_text import brute_contamination, check_packed, tokenizer  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, rows in, rows out) of each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"file://{folder}/{k}")
        after = spark.read.parquet(f"file://{folder}/{k}")
        out[name] = (docs, after)
        docs = after
    return out


def test_order_and_columns(spark, stages):
    assert list(stages) == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == corpus_pipeline.COLUMNS
            assert after.exceptAll(before.select(*corpus_pipeline.COLUMNS)).count() == 0


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_quality_keeps_what_scores(spark, stages):
    before, after = stages["quality classifier"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(quality.training_rows(before, labels, quality.remainder("doc_id", 3) != 1))
    rows = texts(before)
    scores = model.scores([(t or "").encode() for _, t in rows])
    assert sorted(ids(after)) == sorted(i for (i, _), s in zip(rows, scores, strict=True) if s >= 0.5)
    known = {r.doc_id: r.quality for r in labels.collect()}
    kept = set(ids(after))
    assert not [i for i, q in known.items() if q and i not in kept]


def test_exact_stage(stages):
    before, after = stages["exact dedup"]
    firsts = {}
    for i, t in sorted(texts(before)):
        firsts.setdefault(norm(t), i)
    assert sorted(ids(after)) == sorted(firsts.values())


def test_near_stage(stages):
    """The classes of all pairs whose five-word shingle sets have a similarity of 0.8 or more."""
    before, after = stages["SimHash near-dedup"]
    rows = sorted(texts(before))
    found = [grams(t or "") for _, t in rows]
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if len(found[a] & found[b]) / len(found[a] | found[b]) >= 0.8]
    assert sorted(ids(after)) == sorted(rows[min(group)][0] for group in components(range(len(rows)), pairs))


def test_decontamination_stage(spark, stages):
    before, after = stages["benchmark decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {d for d, _, _ in brute_contamination(texts(before), items)}
    assert sorted(ids(after)) == sorted(i for i in ids(before) if i not in held)


def test_packing_stage(spark, stages, tokenizer):  # noqa: F811
    import zlib

    import numpy as np

    before, after = stages["packing"]
    pieces = collections.defaultdict(list)
    for r in after.collect():
        pieces[r.doc_id].append(r)
    for i, t in texts(before):
        want = np.array([*tokenizer[0].encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert r.start == at and zlib.crc32(want[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(want)
    assert not pieces


def test_near_copies_of_the_tables_are_caught(stages):
    """Pairs of kept texts with a five-word similarity of 0.85 or more are rare."""
    _, after = stages["SimHash near-dedup"]
    by, sets = collections.defaultdict(set), {}
    for i, t in texts(after):
        w = re.findall(r"\S+", t.lower())
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        for g in sets[i]:
            by[g].add(i)
    shared = collections.Counter((a, b) for s in by.values() if len(s) < 50 for a in s for b in s if a < b)
    near = [p for p, n in shared.items() if n / len(sets[p[0]] | sets[p[1]]) >= 0.85]
    assert len(near) <= 1


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None


ODD = [(1, None), (2, ""), (3, "a b  c"), (3, "a b  c"), (4, "a b c"), (5, None), (6, "x" * 5000), (7, " " * 1_000_000), (None, "a b c"), (None, None), (8, "clean words that nobody else has in this table")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_and_empty_tables(spark, rows):
    """Each stage on nulls, repeated rows, a long run of spaces, and on no rows. Rows without an id, and texts that no other row has, stay."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], kinds)
    found = {name: stage(spark, docs, DATA).collect() for name, stage in corpus_pipeline.STAGES}
    if not rows:
        assert not any(found.values())
        return
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    of = lambda name: [(r.doc_id, r.text) for r in sorted(found[name], key=key)]
    assert {t for _, t in of("exact dedup")} == {None, "a b  c", "x" * 5000, " " * 1_000_000, ODD[-1][1]}
    assert [i for i, _ in of("exact dedup")] == [1, 3, 6, 7, 8]
    near = [i for i, _ in of("SimHash near-dedup")]
    assert near == [1, 3, 3, 6, 8, None, None]
    assert len(found["benchmark decontamination"]) == len(ODD)
    assert sum(r.start == 0 for r in found["packing"]) == len(ODD)
