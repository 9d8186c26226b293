"""Lookups of queries in a catalogue. Codes compare in upper case; ties go to the catalogue's order (column pos).

Equi-lookups are left to the planner, which broadcasts a small side and shuffles
by key otherwise. Lookups without an equal key (prefix, nearest) first reduce
both sides to distinct keys and split off what an equi-join can answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identifiers import UNKNOWN, blank, inventory_id, key, known_number, normalize_code, printed_number, set_prefix
from .blocks import met

#: Distinct keys up to which a nearest lookup broadcasts them (a few MB).
MAX_BROADCAST_KEYS = 200_000
#: Characters up to which forms without two characters are made (at most 326 of them).
LONGEST_TWO_EDITS = 24
#: Catalogue rows of one id that an exact lookup lists together.
LISTED_ROWS = 1024


def known_numbers(catalogue: DataFrame, id_col: str = "id") -> DataFrame:
    """The distinct printed numbers, as a column number."""
    return catalogue.select(known_number(F.col(id_col)).alias("number")).where(~blank(F.col("number"))).distinct()


def first_by(df: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def exact_lookup(queries: DataFrame, catalogue: DataFrame, query_col: str = "code") -> DataFrame:
    """All catalogue rows whose id is the query, in either case.

    Where an id has many rows, all queries for it meet all of them. Its rows are then
    listed in parts of about LISTED_ROWS, a query goes to each part, and parts
    spread over all tasks, so that no id is one task. A stream is joined as it is.
    """
    if queries.isStreaming or catalogue.isStreaming:
        return queries.join(catalogue, key(F.col(query_col)) == key(F.col("id")))
    rows = catalogue.select(key(F.col("id")).alias("__key"), F.struct(*catalogue.columns).alias("__row"), F.xxhash64(*(c for c, kind in catalogue.dtypes if "map<" not in kind)).alias("__deal"))
    crowded = rows.where("__key IS NOT NULL").groupBy("__key").agg(F.ceil(F.count(F.lit(1)) / LISTED_ROWS).alias("__parts")).where("__parts > 1")
    if crowded.isEmpty():
        return queries.join(catalogue, key(F.col(query_col)) == key(F.col("id")))
    n, most = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.coalesce("__parts", F.lit(1).cast("long"))
    many = F.broadcast(crowded)  # a row for each LISTED_ROWS of the catalogue at most
    listed = rows.join(many, "__key", "left").groupBy("__key", F.pmod("__deal", most).alias("__part")).agg(F.collect_list("__row").alias("__rows"))
    asked = queries.withColumn("__key", key(F.col(query_col))).where("__key IS NOT NULL").join(many, "__key", "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
    # A stated number of partitions: few bytes in, many rows out, so they must not be put together by their bytes.
    met = asked.repartition(n, "__key", "__part").join(listed.repartition(n, "__key", "__part"), ["__key", "__part"])
    return met.select(*queries.columns, F.explode("__rows").alias("__row")).select(*queries.columns, "__row.*")


def variants_lookup(queries: DataFrame, catalogue: DataFrame, query_col: str = "code") -> DataFrame:
    """All catalogue rows with the query's printed number."""
    return queries.join(catalogue, key(F.trim(printed_number(F.col(query_col)))) == known_number(F.col("id")))


def prefix_lookup(queries: DataFrame, catalogue: DataFrame, query_col: str = "code", shortest: int = 3) -> DataFrame:
    """All catalogue rows whose id begins with the query.

    Equi-joins: on the leading characters for a query of ``shortest`` characters or
    more, and for a shorter one on the ids' own short prefixes, of which each id has
    ``shortest`` at most.
    """
    q, c = key(F.col(query_col)), key(F.col("id"))
    long = queries.where(F.length(query_col) >= shortest).withColumn("__lead", F.substring(q, 1, shortest))
    led = long.join(catalogue.withColumn("__lead", F.substring(c, 1, shortest)), "__lead").where(c.startswith(q)).drop("__lead")
    short = queries.where(F.length(query_col) < shortest).withColumn("__lead", q)
    begins = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(shortest - 1)), lambda n: F.substr(c, F.lit(1), n)))
    return led.unionByName(short.join(catalogue.withColumn("__lead", F.explode(begins)), "__lead").drop("__lead"))


def cascade_match(queries: DataFrame, catalogue: DataFrame, query_col: str = "code", rarity_col: str = "wanted_rarity", unique_rarity: bool = False) -> DataFrame:
    """One row per query: the id match if it is the only one, else the first with the wanted rarity (or the only one, with unique_rarity), else none.

    Query columns, n_matches and match_id.
    """
    hits = catalogue.select(key(F.col("id")).alias("__key"), F.col("id").alias("__id"), F.col("rarity").alias("__rarity"), F.col("pos").alias("__pos"))
    counts = hits.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("__pos", "__id")).alias("__only"))
    by_rarity = hits.groupBy("__key", key(F.col("__rarity")).alias("__wanted")).agg(F.count(F.lit(1)).alias("__nr"), F.min(F.struct("__pos", "__id")).alias("__first"))
    wanted = F.when(~blank(F.col(rarity_col)) & (key(F.col(rarity_col)) != UNKNOWN), key(F.col(rarity_col)))
    found = queries.withColumn("__key", key(F.col(query_col))).withColumn("__wanted", wanted).join(counts, "__key", "left").join(by_rarity, ["__key", "__wanted"], "left")
    second = F.when(F.col("__nr") == 1, F.col("__first.__id")) if unique_rarity else F.col("__first.__id")
    chosen = F.when(F.col("__n") == 1, F.col("__only.__id")).when(F.col("__n") > 1, second)
    return found.select(*queries.columns, F.coalesce("__n", F.lit(0)).cast("long").alias("n_matches"), chosen.alias("match_id"))


def exact_preferred_prefix(queries: DataFrame, catalogue: DataFrame, query_col: str = "code") -> DataFrame:
    """One row per query with a prefix match: the id equal to the query, else the first that begins with it."""
    hits = prefix_lookup(queries.withColumn("__q", F.monotonically_increasing_id()), catalogue, query_col)
    exact = key(F.col("id")) == key(F.col(query_col))
    return first_by(hits, [F.col("__q")], [exact.desc(), F.col("pos")]).drop("__q")


def inner_first(left: DataFrame, catalogue: DataFrame, left_key: str) -> DataFrame:
    """Each left row with the first catalogue row of its key; rows without one are dropped."""
    firsts = first_by(catalogue, [key(F.col("id"))], [F.col("pos")])
    return left.join(firsts, key(F.col(left_key)) == key(F.col("id")))


def with_images(catalogue: DataFrame, images: DataFrame) -> DataFrame:
    """image_path for each catalogue row, null without one. images: stem and path, one row per stem."""
    return catalogue.join(images.select(key(F.col("stem")).alias("__stem"), F.col("path").alias("image_path")), key(F.col("id")) == F.col("__stem"), "left").drop("__stem")


def _nearby(texts: DataFrame, numbers: DataFrame, on: Column, by: str) -> DataFrame:
    """Texts against known numbers, in blocks if they are many."""
    return met(texts, numbers, on, MAX_BROADCAST_KEYS, by)


def _dropped(x: Column) -> Column:
    """A text and its forms without one character. Two texts within one edit share a form."""
    n = F.length(x)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(F.array(x), F.transform(places, lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))))


def _dropped_two(x: Column) -> Column:
    """A text and its forms without one or two characters. Two texts within two edits share a form."""
    return F.array_distinct(F.flatten(F.transform(_dropped(x), _dropped)))


def nearest_number(queries: DataFrame, numbers: DataFrame, query_col: str = "code") -> DataFrame:
    """Each query with the known number of the least edit distance, then length difference, then order: number, distance and similarity.

    Distinct texts are resolved once: known numbers by equality, texts one or two
    edits from a number by equi-joins on their forms with as many characters dropped
    (for two, of texts of up to LONGEST_TWO_EDITS characters), and only the rest
    against all numbers, in blocks.
    """
    texts = queries.select(key(F.col(query_col)).alias("__text")).where(~blank(F.col("__text"))).distinct()
    exact = texts.join(numbers, F.col("__text") == F.col("number"), "left_semi").select("__text", F.col("__text").alias("number"), F.lit(0).alias("distance"))
    rest = texts.join(numbers, F.col("__text") == F.col("number"), "left_anti")
    found, n = exact, F.col("number")
    for edits, forms, sized in ((1, _dropped, lambda x: F.lit(True)), (2, _dropped_two, lambda x: F.length(x) <= LONGEST_TWO_EDITS + 2)):
        near = rest.where(sized("__text")).withColumn("__form", F.explode(forms(F.col("__text")))).join(numbers.where(sized("number")).select("number", F.explode(forms(n)).alias("__form")), "__form")
        near = near.select("__text", "number").distinct().where(F.levenshtein("__text", "number") <= edits)
        # Above the bound, a number within two edits may be too long to have forms; such texts wait for the comparison with all.
        near = _closest(near if edits == 1 else near.where(F.length("__text") <= LONGEST_TWO_EDITS))
        found, rest = found.unionByName(near), rest.join(near, "__text", "left_anti")
    found = found.unionByName(_closest(_nearby(rest, numbers, F.lit(True), "number")))
    longest = F.greatest(F.length("__text"), F.length("number"))
    found = found.withColumn("similarity", F.greatest(F.lit(0.0), 100.0 * (1 - F.col("distance") / longest)))
    return queries.join(found, key(F.col(query_col)) == F.col("__text")).drop("__text")


def _closest(pairs: DataFrame) -> DataFrame:
    scored = pairs.withColumn("d", F.levenshtein("__text", "number"))
    best = scored.groupBy("__text").agg(F.min(F.struct("d", F.abs(F.length("number") - F.length("__text")).alias("off"), "number")).alias("best"))
    return best.select("__text", F.col("best.number").alias("number"), F.col("best.d").alias("distance"))


def correct_codes(queries: DataFrame, catalogue: DataFrame, query_col: str = "code") -> DataFrame:
    """corrected: the normalised query if it is an id; else the only id of its set within one edit; else the normalised query.

    Distances are case-sensitive. An id within one edit agrees with the query on
    its set prefix, which is the join key where the query has one.
    """
    texts = queries.where(~blank(F.col(query_col))).select(F.col(query_col).alias("__raw"), normalize_code(F.col(query_col)).alias("__text")).distinct()
    texts = texts.withColumn("__prefix", set_prefix(F.col("__text")))
    ids = first_by(catalogue.where(~blank(F.col("id"))), [key(F.col("id"))], [F.col("pos")]).select(F.col("id").alias("__id"), key(F.col("id")).alias("__key"))
    known = texts.join(ids, key(F.col("__text")) == F.col("__key"), "left_semi").select("__raw", F.col("__text").alias("corrected"))
    rest = texts.join(ids, key(F.col("__text")) == F.col("__key"), "left_anti")
    in_set = rest.where("__prefix IS NOT NULL").join(ids.withColumn("__set", key(set_prefix(F.col("__id")))), key(F.col("__prefix")) == F.col("__set"))
    anywhere = _nearby(rest.where("__prefix IS NULL"), ids, F.abs(F.length("__id") - F.length("__text")) <= 1, "__id")
    near = in_set.drop("__set").unionByName(anywhere).withColumn("d", F.levenshtein("__text", "__id")).where("d <= 1")
    best = near.groupBy("__raw").agg(F.min("d").alias("d"), F.count_if(F.col("d") == 0).alias("n0"), F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "__id")).alias("best"))
    unique = best.where("IF(d = 0, n0, n) = 1").select("__raw", F.col("best.__id").alias("__fix"))
    fixed = rest.join(unique, "__raw", "left").select("__raw", F.coalesce("__fix", "__text").alias("corrected"))
    return queries.join(known.unionByName(fixed), F.col(query_col) == F.col("__raw"), "left").withColumn("corrected", F.coalesce("corrected", F.col(query_col))).drop("__raw")


def free_slots(containers: DataFrame, taken: DataFrame) -> DataFrame:
    """Free places (container, slot) of active containers. containers: code, capacity, is_active; taken: container_code, slot_number."""
    places = containers.where("is_active AND capacity > 0").select(F.col("code").alias("container"), F.explode(F.sequence(F.lit(1), F.col("capacity"))).alias("slot"))
    used = taken.where("container_code IS NOT NULL AND slot_number IS NOT NULL").select(key(F.col("container_code")).alias("__c"), F.col("slot_number").alias("__s")).distinct()
    return places.join(used, (key(F.col("container")) == F.col("__c")) & (F.col("slot") == F.col("__s")), "left_anti")


def first_free_slot(containers: DataFrame, taken: DataFrame) -> DataFrame:
    """The first free place by container, then slot; no row if there is none."""
    return free_slots(containers, taken).orderBy(key(F.col("container")), "container", "slot").limit(1)


def require_slot(containers: DataFrame, taken: DataFrame) -> tuple[str, int]:
    """The first free place; an error if there is none."""
    found = first_free_slot(containers, taken).first()
    if found is None:
        raise LookupError("no free slot in an active container")
    return found["container"], found["slot"]


def not_imported(scans: DataFrame, items: DataFrame, path_col: str = "path") -> DataFrame:
    """Scans whose path no item has yet; paths compare by case."""
    return scans.join(items.select(F.col("original_scan_path").alias("__path")).where("__path IS NOT NULL"), F.col(path_col) == F.col("__path"), "left_anti")


def allocate_ids(df: DataFrame, base: int, order: list[str]) -> DataFrame:
    """inventory_id for each row, counted on from base in the given order.

    Ranges of the order are counted first, so numbering is no single task.
    """
    spark, n = df.sparkSession, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = dealt.join(F.broadcast(starts), "__part")  # one row for each range
    return numbered.withColumn("inventory_id", inventory_id(F.lit(base) + F.col("__start") + F.col("__row") + 1)).drop("__at", "__part", "__row", "__start")
