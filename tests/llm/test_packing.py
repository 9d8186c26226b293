"""Packing against the vocabulary's tokenizer as it is loaded, and differencing against known results."""

import random

import pytest
from larkspur.llm import packing

from .conftest import words
from .test_text import check_packed


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    vocabularies = pytest.importorskip("public_tokenizers")
    path = vocabularies.path("byte_bpe_50k.json")
    return path, vocabularies.PATTERN, tokenizers.Tokenizer.from_file(path)


def test_added_tokens_in_texts(spark, vocabulary):
    path, pattern, t = vocabulary
    rows = list(enumerate(("a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>  y<|endoftext|><|endoftext|>\n", "<|endoftext| >", "<|ENDOFTEXT|>", "plain", "", None, "don't<|endoftext|>'s 漢字")))
    assert t.encode(rows[0][1], add_special_tokens=False).ids[1] == 50256
    check_packed(rows, packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, pattern).collect(), t)


def test_long_white_space(spark, vocabulary):
    """Runs of a million white-space characters, alone and within words, and of other characters."""
    path, pattern, t = vocabulary
    million = 1_000_000
    texts = [" " * million, "\n" * million, "x" + " " * million + "y", f"a b{' ' * million}c <|endoftext|> d", "\t \n" * 300_000, " " * (packing.LONG_RUN - 1), " " * packing.LONG_RUN + "z", "y" * million, "!" * million]
    rows = list(enumerate(texts))
    check_packed(rows, packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, pattern).collect(), t)


def test_texts_stay_whole(spark, vocabulary):
    """Under 5 % of the texts that fit a window are cut, and windows are filled."""
    path, pattern, t = vocabulary
    rng = random.Random(3)
    rows = [(k, words(rng, int(rng.lognormvariate(4.7, 1)))) for k in range(4000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, pattern).collect()
    pieces, fills = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, [r.doc_tokens]).append(r.length)
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    fitting = [p for p in pieces.values() if p[0] <= packing.WINDOW]
    assert sum(len(p) > 2 for p in fitting) / len(fitting) < 0.05
    assert sum(fills.values()) / len(fills) / packing.WINDOW > 0.97


@pytest.mark.parametrize(
    ("sizes", "parts", "sums"),
    [
        ([8, 7, 6, 5, 4], 2, [14, 16]),  # the method's well-known result; the best is 15, 15
        ([4, 5, 6, 7, 8], 3, [8, 11, 11]),
        ([5, 5, 5, 4, 4, 3, 3, 1], 3, [9, 10, 11]),  # by hand: 555, then 443 with 31, then both
        ([9], 3, [0, 0, 9]),
        ([], 2, []),
    ],
)
def test_known_differencing(sizes, parts, sums):
    found = packing.differencing(sizes, parts)
    assert sorted(k for part in found for k in part) == list(range(len(sizes)))
    assert sorted(sum(sizes[k] for k in part) for part in found) == sums


def test_the_window_count_rises():
    """Three items of 6 need three windows of 10, though two would hold their sum."""
    assert sorted(map(len, packing.windows([6, 6, 6], 10))) == [1, 1, 1]
    assert len(packing.windows([5, 5, 5, 5], 10)) == 2
