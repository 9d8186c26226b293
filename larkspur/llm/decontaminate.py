"""Benchmark decontamination by fingerprints of item-sized windows.

Words are runs of letters and digits in lower case (ASCII punctuation separates;
other characters belong to words). A benchmark item of n words is compared with
windows of n words of each text. A window is looked at if it aligns with the
item at a shared five-word shingle: a window with a similarity above zero shares
one, so no similar alignment is missed. (Items of fewer than five words are one
shingle.) A text and an item are tried only if they share one of the item's
rarest shingles: of m shingles, a similar window holds 0.8 m at least, so one of
any 0.2 m + 1 of them. Rarity is counted in the texts, so a phrase that
many texts and items share tries nothing.

Windows and items get 64-bit SimHash fingerprints. Fingerprints are cut into
``radius + 1`` blocks; two of them within the radius are equal in a block, so an
equi-join on (item, block number, block) finds every aligned pair within it.
Blocks are a few bits, so the item that a window aligned with is part of the key:
a window meets no other item. Pairs within the radius are verified by the
weighted-shingle similarity itself: the shingles' smaller counts over their
larger counts, 0.8 or more.

The texts are read twice: once for shared shingles (an equi-join with the items'
shingles, which are broadcast only if counted to be few), once to cut windows of
texts that are tried. Equal texts are one text until the end, known by SHA-256,
so a group of copies costs one text. All steps are DataFrame expressions.

Edge cases: null and empty texts have no windows; items without words match
nothing. A passage cut off by a text's start or end is compared with the window
at that edge. Repeated rows and ids give a row each; null ids stay null. Empty
tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

WORDS, SIMILARITY, RADIUS, MAX_BROADCAST_ROWS = 5, 0.8, 18, 1_000_000


def _norm(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.trim(plain)


def _shingles(norm: Column, words: int) -> Column:
    """All runs of so many words, in order, in one pass."""
    more = r" \S++" * (words - 1)
    return F.regexp_extract_all(norm, F.lit(rf"(?<!\S)(?=(\S++{more}))\S++"), F.lit(1))


def _fingerprint(hashes: Column) -> Column:
    """Bit b is set if it is set in over half the hashes."""
    half = F.size(hashes)
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.when(F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int")) * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def _blocks(fp: Column, radius: int) -> Column:
    """(number, bits) of radius + 1 blocks."""
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    cut = lambda a, b: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*(F.struct(F.lit(k).alias("block"), cut(a, b).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))


def _similarity(a: Column, b: Column) -> Column:
    """Of two multisets, as arrays: smaller counts over larger counts."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return shared / (F.size(a) + F.size(b) - shared)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if the rows, already counted, are few."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def _rarest(places: DataFrame, counts: DataFrame, similarity: float) -> DataFrame:
    """(hash, item) of each item's rarest shingles, so many that a similar window holds one. Shingles in no text are the rarest."""
    ranked = places.join(counts, "hash", "left").withColumn("place", F.row_number().over(W.partitionBy("item").orderBy(F.coalesce("count", F.lit(0)), "hash", "at")))
    # A little below the similarity, so that rounding loses nothing.
    ranked = ranked.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("item")))
    return ranked.where(F.col("place") <= F.col("m") - F.ceil(F.col("m") * similarity - 1e-6) + 1).select("hash", "item").distinct()


def near_windows(windows: DataFrame, items: DataFrame, radius: int, n_items: int) -> DataFrame:
    """Of windows (key, start, n_words, fp) and the item each aligned with, those whose fingerprint is within the radius of the item's (item, item_fp).

    Two fingerprints within it are equal in one of radius + 1 blocks.
    """
    own, blocks = windows.columns, lambda name: F.explode(_blocks(F.col(name), radius)).alias("b")
    blocked = windows.select(*own, blocks("fp")).select(*own, "b.*")
    item_blocks = items.select("item", "item_fp", blocks("item_fp")).select("item", "item_fp", "b.*")
    near = blocked.join(_few(item_blocks, n_items * (radius + 1)), ["item", "block", "bits"])
    return near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("key", "start", "n_words", "item").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and item it holds: id, item id, similarity, start_word, n_words, text_sha256 (of the raw text).

    The best window of each pair, the first among equals.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).alias("item"), _norm(F.col(item_text_col)).alias("norm")).where("norm <> ''").withColumn("n_words", F.size(F.split("norm", " ")))
    items = items.withColumn("width", F.least("n_words", F.lit(words)))
    by_width = F.coalesce(*(F.when(F.col("width") == k, _shingles(F.col("norm"), k)) for k in range(1, words + 1)))
    items = scratch.table(items.withColumn("grams", by_width).withColumn("fp", _fingerprint(F.transform("grams", lambda x: F.xxhash64(x)))), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most `words` rows
    keyed = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("key"))
    texts = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("key"), F.xxhash64(text_col).alias("quick"), _norm(F.col(text_col)).alias("norm"))

    found = None
    for width in widths:
        own = items.where(F.col("width") == width)
        places = scratch.table(own.select("item", "n_words", F.posexplode("grams").alias("at", "gram")).select("item", "n_words", "at", F.xxhash64("gram").alias("hash")), f"places{width}")
        wanted = scratch.table(places.select("hash").distinct(), f"wanted{width}")
        n = places.count()
        grams = texts.select("key", "quick", F.posexplode(_shingles(F.col("norm"), width)).alias("pos", "gram")).select("key", "quick", "pos", F.xxhash64("gram").alias("hash"))
        shared = scratch.table(grams.join(_few(wanted, n), "hash", "left_semi").distinct(), f"shared{width}")
        rare = _rarest(places, shared.groupBy("hash").count(), similarity)
        tried = scratch.table(shared.select("key", "quick", "hash").distinct().join(_few(scratch.table(rare, f"rare{width}"), n), "hash").select("key", "quick", "item").distinct(), f"tried{width}")
        # Of the texts that are tried, all alignments with the items they are tried for.
        aligned = shared.join(tried.select("key").distinct(), "key", "left_semi").join(_few(places, n), "hash").join(tried.select("key", "item"), ["key", "item"], "left_semi")
        starts = scratch.table(aligned.select("key", "item", "n_words", (F.col("pos") - F.col("at")).alias("start")).distinct(), f"starts{width}")

        # A short hash finds the texts again without a shuffle of all texts; the join on the key below is exact.
        sources = scratch.table(tried.select("quick").distinct(), f"sources{width}")
        sharing = texts.join(_few(sources, sources.count()), "quick", "left_semi").dropDuplicates(["key"]).select("key", _shingles(F.col("norm"), width).alias("all"))
        size = F.col("n_words") - (width - 1)
        clipped = F.greatest(F.lit(0), F.least(F.col("start"), F.size("all") - size))
        windows = starts.join(sharing, "key").withColumn("start", clipped).withColumn("grams", F.slice("all", F.col("start") + 1, size)).drop("all")
        windows = windows.groupBy("key", "n_words", "start").agg(F.first("grams").alias("grams"), F.collect_set("item").alias("items"))
        windows = scratch.table(windows.withColumn("fp", _fingerprint(F.transform("grams", lambda x: F.xxhash64(x)))), f"windows{width}")

        near = near_windows(windows.select("key", "start", "n_words", "fp", F.explode("items").alias("item")), own.select("item", F.col("fp").alias("item_fp")), radius, n)
        pairs = near.join(windows.select("key", "start", "n_words", "grams"), ["key", "start", "n_words"]).join(_few(own.select("item", F.col("grams").alias("item_grams")), n), "item")
        pairs = pairs.withColumn("similarity", _similarity(F.col("grams"), F.col("item_grams"))).where(F.col("similarity") >= similarity)
        best = pairs.groupBy("key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best"))
        best = best.select("key", "item", "best.similarity", (-F.col("best.back")).alias("start_word"), F.col("best.n_words").alias("n_words"))
        found = best if found is None else found.unionByName(best)
    if found is None:
        return keyed.where("false").select(F.col("id").alias(id_col), F.lit(None).cast(benchmark.schema[item_col].dataType).alias(item_col), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.col("key").alias("text_sha256"))
    found = scratch.table(found, "found")
    return keyed.join(found, "key").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity", "start_word", "n_words", F.col("key").alias("text_sha256"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all columns, whose text holds no benchmark item."""
    found = find_contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    held = Scratch(docs.sparkSession, "contaminated").table(found.select(F.col("text_sha256").alias("__held")).distinct(), "texts")
    held = F.broadcast(held) if held.count() <= MAX_BROADCAST_ROWS // 5 else held
    return docs.join(held, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == F.col("__held"), "left_anti")
