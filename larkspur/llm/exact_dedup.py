"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of characters. Equal
blocks get one integer name: the distinct repeated blocks are sorted and
numbered. Adjacent names are then paired and the repeated pairs named in the
same way, until a document is one name. Two documents are equal exactly when
they have the same number of blocks and the same last name; no digest decides.

A block (or pair) that occurs once in the corpus needs no name: its document
equals no other, so it leaves the rounds. All rounds but the first handle
integers only. Counts are combined before each shuffle, and the joins that give
names back are sort-merge joins on two exchanges, which adaptive execution
splits where one block holds many rows.

Everything is DataFrame expressions; tables written between rounds fix the
names before they are used.

Edge cases: null text counts as empty, and empty texts equal each other. Null
ids sort after all others; a group of null ids only has a null keep_id. Rows
that repeat an id and a text are rows of one group, of which one is kept. An
empty table gives an empty result. Extra columns are neither read nor returned
by ``exact_duplicates``; ``drop_exact_duplicates`` returns all input columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, collapsed

BLOCK_CHARS, MAX_BROADCAST_ROWS = 2048, 500_000


def _blocks(norm):
    """Blocks of a text in one pass over it; the empty text is one empty block."""
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit("(?s).{1,%d}" % BLOCK_CHARS), F.lit(0)))


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted repeated keys and an integer name for each."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_same")).where("n_same > 1").drop("n_same")
    return repeated.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_blocks.

    keep_id is the smallest id among equal texts; kept marks one row of each group.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    texts = docs.select(F.col(id_col).alias("id"), collapsed(F.col(text_col)).alias("norm"))

    names = scratch.table(_named(texts.select(F.explode(_blocks(F.col("norm"))).alias("block")), ["block"]), "blocks")
    rows = texts.withColumn("uid", F.monotonically_increasing_id()).withColumn("sha", F.sha2("norm", 256)).withColumn("blocks", _blocks(F.col("norm")))
    cut = rows.select("id", "uid", "sha", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("at", "block"))
    cut = cut.withColumn("sha", F.when(F.col("at") == 0, F.col("sha")))
    level = scratch.table(cut.join(names, "block", "left").select("id", "uid", "sha", "n_blocks", "at", "name"), "level")
    scratch.drop("blocks")

    firsts = level.where("at = 0").select("id", "uid", "sha", "n_blocks")
    done = level.where("n_blocks = 1 AND name IS NOT NULL").select("uid", "n_blocks", "name")
    open_ = scratch.table(_lists(level.where("n_blocks > 1")), "open0")
    k = 0
    while not open_.isEmpty():
        pairs = open_.select("uid", "n_blocks", "parts", F.posexplode(_pairs()).alias("at", "pair")).select("uid", "n_blocks", F.ceil(F.size("parts") / 2).alias("parts"), "at", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
        pair_names = scratch.table(_named(pairs.select("a", "b"), ["a", "b"]), f"pairs{k}")
        named = pairs.join(pair_names, ["a", "b"], "left")
        lists = scratch.table(_lists(named, F.col("parts")), f"open{k + 1}")
        done = done.unionByName(lists.where("size(parts) = 1").select("uid", "n_blocks", F.col("parts")[0].alias("name")))
        open_, k = lists.where("size(parts) > 1"), k + 1

    groups = done.join(firsts.select("uid", "id"), "uid").withColumn("key", F.struct(F.col("id").isNull().alias("none"), "id", "uid"))
    # Written, so that both sides of the join are plain exchanges and a large group can be split.
    kept = scratch.table(groups.groupBy("n_blocks", "name").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    member = groups.select("uid", "n_blocks", "name").join(kept, ["n_blocks", "name"]).select("uid", F.col("first.id").alias("keep_id"), F.col("first.uid").alias("keep_uid"), "group_size", F.lit(True).alias("grouped"))
    return firsts.join(member, "uid", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("n_blocks").cast("long").alias("n_blocks"),
    )


def _lists(rows: DataFrame, total=None) -> DataFrame:
    """Per document the names in order, of documents whose every part has one."""
    total = F.col("n_blocks") if total is None else total
    whole = rows.groupBy("uid", "n_blocks").agg(F.max(total).alias("total"), F.collect_list(F.when(F.col("name").isNotNull(), F.struct("at", "name"))).alias("found"))
    return whole.where(F.size("found") == F.col("total")).select("uid", "n_blocks", F.transform(F.array_sort("found"), lambda x: x["name"]).alias("parts"))


def _pairs():
    """Adjacent names; an odd last one is paired with -1, which names nothing."""
    at = F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / 2).cast("int"))
    return F.transform(at, lambda i: F.struct(F.get("parts", i * 2).alias("a"), F.coalesce(F.get("parts", i * 2 + 1), F.lit(-1)).alias("b")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns: one for each distinct text."""
    found = Scratch(docs.sparkSession, "exact-kept").table(exact_duplicates(docs, id_col, text_col), "rows")
    keys = found.groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    keys = Scratch(docs.sparkSession, "exact-keys").table(keys.where("NOT kept OR n > 1"), "keys")
    gone = keys.where("NOT kept").select("__id", "__sha")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone  # 100 bytes each; texts then stay where they are
    sha = F.sha2(collapsed(F.col(text_col)), 256)
    rows = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (sha == F.col("__sha")), "left_anti")
    if keys.where("kept").isEmpty():
        return rows
    # Rows that repeat both id and text: none was taken away, and one stays.
    return rows.withColumn("__sha", sha).dropDuplicates([id_col, "__sha"]).drop("__sha")
