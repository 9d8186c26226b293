"""Lookups, catalogue analysis and inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators import aggregates, lookups, ordered
from ..sources.readers import index_paths
from .stand_ins import BASE, CATALOGUE, catalogue, containers, items, observations, people, table, taken

#: Names of conditions and states, in the order of their numbers.
CONDITIONS = ("MT", "NM", "EX", "GD", "LP", "PL", "PO")
STATES = ("NEW", "SCANNED", "STORED", "LISTED", "RESERVED", "SOLD", "SHIPPED", "ARCHIVED")


def _asked(spark, sf_dir):
    return observations(spark, sf_dir).select("code").distinct()


def printed_number_set(spark, sf_dir):
    return lookups.known_numbers(catalogue(spark, sf_dir))


def catalog_exact_lookup(spark, sf_dir):
    return lookups.exact_lookup(_asked(spark, sf_dir), catalogue(spark, sf_dir)).select("code", "pos", "id")


def catalog_variants_lookup(spark, sf_dir):
    return lookups.variants_lookup(_asked(spark, sf_dir), catalogue(spark, sf_dir)).select("code", "pos", "id")


def catalog_prefix_lookup(spark, sf_dir):
    prefixes = _asked(spark, sf_dir).select(F.explode(F.array(ids.set_prefix(F.col("code")), F.substring("code", 1, 2))).alias("code")).where("code IS NOT NULL").distinct()
    return lookups.prefix_lookup(prefixes, catalogue(spark, sf_dir)).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def _wanted(spark, sf_dir):
    return observations(spark, sf_dir).select("pos", "code", F.lower("rarity").alias("wanted_rarity")).withColumnRenamed("pos", "asked")


def cascade_match(spark, sf_dir):
    return lookups.cascade_match(_wanted(spark, sf_dir), catalogue(spark, sf_dir)).select("asked", "code", "n_matches", "match_id")


def cascade_match_unique(spark, sf_dir):
    return lookups.cascade_match(_wanted(spark, sf_dir), catalogue(spark, sf_dir), unique_rarity=True).select("asked", "code", "n_matches", "match_id")


def exact_preferred_prefix_match(spark, sf_dir):
    return lookups.exact_preferred_prefix(_asked(spark, sf_dir), catalogue(spark, sf_dir)).select("code", "pos", "id", ids.set_code(F.col("id")).alias("set_code"))


def inventory_view(spark, sf_dir):
    rows = lookups.inner_first(items(spark, sf_dir), people(spark, sf_dir), "card_data_id")
    name = lambda names, k: F.element_at(F.array(*map(F.lit, names)), F.col(k) + 1)
    return rows.select("inventory_id", "id", "name", ids.shown(F.col("rarity")).alias("rarity"), name(CONDITIONS, "condition").alias("condition"), name(STATES, "status").alias("status"), ids.shown(ids.storage_code(F.col("container_code"), F.col("slot_number"))).alias("storage")).orderBy("inventory_id")


def _paths(spark, sf_dir):
    kind = F.col("pos") % 4
    suffix = F.when(kind == 0, ".png").when(kind == 1, ".JPG").when(kind == 2, ".gif").otherwise(".webp")
    return catalogue(spark, sf_dir).select(F.concat(F.lit("/images/"), (F.col("pos") % 3).cast("string"), F.lit("/"), F.lower("id"), suffix).alias("path")).distinct()


def image_index_left_join(spark, sf_dir):
    return lookups.with_images(catalogue(spark, sf_dir), index_paths(_paths(spark, sf_dir))).select("pos", "id", "image_path")


def duplicate_keys(spark, sf_dir):
    return aggregates.duplicate_keys(catalogue(spark, sf_dir))


def variant_histogram(spark, sf_dir):
    return aggregates.variant_histogram(catalogue(spark, sf_dir))


def database_summary(spark, sf_dir):
    return aggregates.catalogue_summary(catalogue(spark, sf_dir))


def dedup_first_by_key(spark, sf_dir):
    return lookups.first_by(catalogue(spark, sf_dir), [ids.key(F.col("id"))], [F.col("pos")]).select("pos", "id", "name")


def shortest_id_per_group(spark, sf_dir):
    return aggregates.shortest_id(catalogue(spark, sf_dir), [ids.known_number(F.col("id")).alias("number")], "id", "pos").select("number", "shortest", F.array_join("ids", ",").alias("ids"), "n")


def numbers_by_length(spark, sf_dir):
    return aggregates.numbers_by_length(lookups.known_numbers(catalogue(spark, sf_dir)))


def shared_value_or_unknown(spark, sf_dir):
    return aggregates.shared_or_unknown(catalogue(spark, sf_dir), [F.col("id")], "category", "pos")


def first_free_slot(spark, sf_dir):
    return lookups.first_free_slot(containers(spark, sf_dir), taken(spark, sf_dir))


def free_slots(spark, sf_dir):
    return lookups.free_slots(containers(spark, sf_dir), taken(spark, sf_dir))


def _scans(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("/scans/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"))


def not_imported_scans(spark, sf_dir):
    return lookups.not_imported(_scans(spark, sf_dir), items(spark, sf_dir))


def allocated_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookups.allocate_ids(rows, 1_000, ["o_custkey", "o_orderkey"])


def untrained_anti_join(spark, sf_dir):
    trained = _scans(spark, sf_dir).where(F.col("path").rlike("[02468]\\.png$")).select(F.upper("path").alias("path"))
    return ordered.untrained(_scans(spark, sf_dir), trained)


def import_outcomes(spark, sf_dir):
    found = lookups.cascade_match(_wanted(spark, sf_dir), catalogue(spark, sf_dir))
    outcome = F.when(F.col("n_matches") == 0, "skipped").when(F.col("match_id").isNull(), "rejected").otherwise("accepted")
    return aggregates.outcome_counts(found, outcome).select("outcome", "n", F.round("share", 6).alias("share"))


def capped_per_class(spark, sf_dir):
    return aggregates.capped_per_class(catalogue(spark, sf_dir), "category", ["pos"], F.lit(150), most=200).select("category", "pos")


def id_formatting(spark, sf_dir):
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        ids.inventory_id(s).alias("inventory_id"),
        ids.container_code(s).alias("container"),
        ids.storage_code(F.when(s % 5 != 0, ids.container_code(s)), F.when(s % 3 != 0, s)).alias("storage"),
        ids.safe_file_name(F.concat(F.col("s_name"), F.lit("/a:b"))).alias("file_name"),
        ids.strip_copy_suffix(F.concat(F.col("s_name"), F.lit("_C"), s.cast("string"))).alias("stripped"),
        ids.list_text(F.array(F.col("s_name"), F.lit(" "), F.when(s % 2 == 0, F.lit("x")))).alias("listed"),
        ids.file_stem(F.concat(F.lit("/a.b/"), F.col("s_name"), F.lit(".tar.gz"))).alias("stem"),
        ids.file_extension(F.concat(F.lit("/a.b/"), F.col("s_name"), F.lit(".PNG"))).alias("extension"),
    )


def normalize_ocr_text(spark, sf_dir):
    raw = F.concat(F.lower("code"), F.lit(" — "), F.col("pos").cast("string"), F.lit("_ols z"))
    return observations(spark, sf_dir).select("pos", ids.normalize_code(raw).alias("normalized"), ids.letter_prefix(F.col("code")).alias("letters"), ids.first_letters(F.col("code")).alias("first_letters"), ids.set_code(F.col("code")).alias("set_code"), ids.set_prefix(F.col("code")).alias("set_prefix"))


def extract_code_regex(spark, sf_dir):
    pos = F.col("pos")
    head = F.when(pos % 5 == 0, "0p").when(pos % 5 == 1, "st ").when(pos % 5 == 2, "xx P -").when(pos % 5 == 3, "prb").otherwise("none ")
    raw = F.concat(F.lit("a "), head, F.when(pos % 5 == 2, "").otherwise("o1–"), F.lpad((pos % 1000).cast("string"), 3, "O"), F.lit(" z"))
    found = ids.extract_code(raw)
    return observations(spark, sf_dir).select("pos", found.alias("code"), ids.plausible_structure(found).alias("plausible"), F.coalesce(ids.supported_format(found), F.lit(False)).alias("supported"))


def variant_label(spark, sf_dir):
    return catalogue(spark, sf_dir).select("pos", ids.variant_label(F.col("id")).alias("label"), ids.variant_label(F.col("id"), F.col("pos") % 2 == 0).alias("starred"))


def symbol_order(spark, sf_dir):
    letters = catalogue(spark, sf_dir).select(F.explode(F.split("id", "")).alias("symbol")).where("symbol <> ''")
    return letters.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("place", ids.symbol_rank(F.col("symbol"))).orderBy("place", "symbol")


QUERIES = {
    f.__name__: f
    for f in (printed_number_set, catalog_exact_lookup, catalog_variants_lookup, catalog_prefix_lookup, cascade_match, cascade_match_unique, exact_preferred_prefix_match, inventory_view, image_index_left_join, duplicate_keys, variant_histogram, database_summary, dedup_first_by_key, shortest_id_per_group, numbers_by_length, shared_value_or_unknown, first_free_slot, free_slots, not_imported_scans, allocated_ids, untrained_anti_join, import_outcomes, capped_per_class, id_formatting, normalize_ocr_text, extract_code_regex, variant_label, symbol_order)
}

ASKED = "asked AS (SELECT DISTINCT code FROM observations)"
_CASCADE = f"""{BASE}, hits AS (SELECT upper(id) AS k, count(*) AS n, arg_min(id, pos) AS only_id FROM catalogue GROUP BY 1),
    rare AS (SELECT upper(id) AS k, upper(rarity) AS r, count(*) AS nr, arg_min(id, pos) AS first_id FROM catalogue GROUP BY 1, 2)
    SELECT o.pos AS asked, code, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN only_id WHEN n > 1 {{}} THEN first_id END AS match_id
    FROM observations o LEFT JOIN hits ON hits.k = upper(code) LEFT JOIN rare ON rare.k = upper(code) AND r = upper(o.rarity)"""
_SLOTS = """places AS (SELECT printf('BC-%03d', s_suppkey) AS container, unnest(range(1, 2 + s_suppkey % 9)) AS slot FROM supplier WHERE s_suppkey % 4 <> 0),
    free AS (SELECT container, CAST(slot AS INTEGER) AS slot FROM places WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE printf('BC-%03d', l_suppkey) = container AND l_linenumber = slot))"""
_SCANS = "scans AS (SELECT '/scans/' || o_orderkey || '.png' AS path, o_orderkey FROM orders)"

ORACLES = {
    "printed_number_set": f"WITH {CATALOGUE} SELECT DISTINCT upper(trim(split_part(id, '_', 1))) AS number FROM catalogue",
    "catalog_exact_lookup": f"{BASE}, {ASKED} SELECT code, pos, id FROM asked JOIN catalogue ON upper(code) = upper(id)",
    "catalog_variants_lookup": f"{BASE}, {ASKED} SELECT code, pos, id FROM asked JOIN catalogue ON upper(code) = upper(split_part(id, '_', 1))",
    "catalog_prefix_lookup": f"""{BASE}, {ASKED}, prefixes AS (SELECT substr(code, 1, 2) AS code FROM asked UNION SELECT substr(code, 1, instr(code, '-')) FROM asked WHERE instr(code, '-') > 1)
        SELECT code, count(*) AS n, min(id) AS first_id FROM prefixes JOIN catalogue ON starts_with(upper(id), upper(code)) GROUP BY code""",
    "cascade_match": _CASCADE.format(""),
    "cascade_match_unique": _CASCADE.format("AND nr = 1"),
    "exact_preferred_prefix_match": f"""{BASE}, {ASKED}, hits AS (SELECT code, pos, id, row_number() OVER (PARTITION BY code ORDER BY upper(id) = upper(code) DESC, pos) AS place
        FROM asked JOIN catalogue ON starts_with(upper(id), upper(code)))
        SELECT code, pos, id, CASE WHEN instr(id, '-') > 1 THEN substr(id, 1, instr(id, '-') - 1) ELSE '' END AS set_code FROM hits WHERE place = 1""",
    "inventory_view": f"""SELECT printf('VCV-%06d', o_orderkey) AS inventory_id, 'c' || c_custkey AS id, c_name AS name,
        CASE WHEN trim(coalesce(c_mktsegment, '')) = '' THEN '-' ELSE c_mktsegment END AS rarity,
        list_extract({list(CONDITIONS)}, o_orderkey % 7 + 1) AS condition, list_extract({list(STATES)}, o_orderkey % 8 + 1) AS status,
        CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN printf('BC-%03d-%04d', o_orderkey % 100, o_orderkey % 40) ELSE '-' END AS storage
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "image_index_left_join": f"""WITH {CATALOGUE}, paths AS (SELECT DISTINCT '/images/' || (pos % 3) || '/' || lower(id) || CASE pos % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' ELSE '.webp' END AS path, lower(id) AS stem
        FROM catalogue WHERE pos % 4 <> 2), firsts AS (SELECT upper(stem) AS k, min(path) AS path FROM paths GROUP BY 1)
        SELECT pos, id, path AS image_path FROM catalogue LEFT JOIN firsts ON k = upper(id)""",
    "duplicate_keys": f"WITH {CATALOGUE} SELECT arg_min(id, pos) AS id, count(*) AS n FROM catalogue GROUP BY upper(id) HAVING count(*) > 1",
    "variant_histogram": f"WITH {CATALOGUE}, v AS (SELECT count(*) AS variants FROM catalogue GROUP BY upper(split_part(id, '_', 1))) SELECT variants, count(*) AS numbers FROM v GROUP BY 1",
    "database_summary": f"WITH {CATALOGUE} SELECT count(*) AS rows, count(DISTINCT upper(id)) AS ids, count(DISTINCT upper(split_part(id, '_', 1))) AS numbers, count(*) FILTER (contains(id, '_')) AS variants FROM catalogue",
    "dedup_first_by_key": f"WITH {CATALOGUE} SELECT min(pos) AS pos, arg_min(id, pos) AS id, arg_min(name, pos) AS name FROM catalogue GROUP BY upper(id)",
    "shortest_id_per_group": f"""WITH {CATALOGUE}, r AS (SELECT *, upper(split_part(id, '_', 1)) AS number, row_number() OVER (PARTITION BY upper(split_part(id, '_', 1)) ORDER BY length(id), pos) AS place FROM catalogue)
        SELECT number, max(id) FILTER (place = 1) AS shortest, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids, count(*) AS n FROM r GROUP BY number""",
    "numbers_by_length": f"{BASE} SELECT CAST(length(number) AS INTEGER) AS length, count(*) AS n, min(number) AS first, max(number) AS last FROM numbers GROUP BY 1",
    "shared_value_or_unknown": f"WITH {CATALOGUE} SELECT id, CASE WHEN count(DISTINCT upper(category)) = 1 THEN arg_min(category, pos) ELSE 'UNBEKANNT' END AS shared FROM catalogue GROUP BY id",
    "first_free_slot": f"WITH {_SLOTS} SELECT container, slot FROM free ORDER BY container, slot LIMIT 1",
    "free_slots": f"WITH {_SLOTS} SELECT container, slot FROM free",
    "not_imported_scans": f"WITH {_SCANS} SELECT path FROM scans WHERE o_orderkey % 2 <> 0",
    "allocated_ids": "SELECT o_orderkey, o_custkey, printf('VCV-%06d', 1000 + row_number() OVER (ORDER BY o_custkey, o_orderkey)) AS inventory_id FROM orders",
    "untrained_anti_join": f"WITH {_SCANS} SELECT path FROM scans WHERE o_orderkey % 2 <> 0",
    "import_outcomes": f"""WITH found AS ({_CASCADE.format("")}) SELECT CASE WHEN n_matches = 0 THEN 'skipped' WHEN match_id IS NULL THEN 'rejected' ELSE 'accepted' END AS outcome,
        count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM found GROUP BY 1""",
    "capped_per_class": f"WITH {CATALOGUE} SELECT category, pos FROM catalogue QUALIFY row_number() OVER (PARTITION BY category ORDER BY pos) <= 50",
    "id_formatting": """SELECT s_suppkey, printf('VCV-%06d', s_suppkey) AS inventory_id, printf('BC-%03d', s_suppkey) AS container,
        CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 THEN printf('BC-%03d-%04d', s_suppkey, s_suppkey) END AS storage,
        s_name || '_a_b' AS file_name, s_name AS stripped, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ', x' ELSE '' END AS listed, s_name || '.tar' AS stem, '.png' AS extension FROM supplier""",
    "normalize_ocr_text": f"""{BASE} SELECT pos, replace(code, ' ', '') || '-' || pos || '-015' || '2' AS normalized, regexp_extract(code, '^[A-Za-z]+') AS letters,
        substr(regexp_replace(code, '[^A-Za-z]', '', 'g'), 1, 3) AS first_letters, CASE WHEN instr(code, '-') > 1 THEN substr(code, 1, instr(code, '-') - 1) ELSE '' END AS set_code,
        CASE WHEN instr(code, '-') > 1 THEN substr(code, 1, instr(code, '-')) END AS set_prefix FROM observations""",
    "extract_code_regex": f"""{BASE}, c AS (SELECT pos, CASE pos % 5 WHEN 4 THEN NULL ELSE CASE pos % 5 WHEN 0 THEN 'OP01-' WHEN 1 THEN 'ST01-' WHEN 2 THEN 'P-' ELSE 'PRB01-' END || lpad(CAST(pos % 1000 AS VARCHAR), 3, '0') END AS code FROM observations)
        SELECT pos, code, code IS NOT NULL AS plausible, code IS NOT NULL AS supported FROM c""",
    "variant_label": f"""WITH {CATALOGUE}, l AS (SELECT pos, CASE WHEN NOT contains(id, '_') THEN 'Standard' WHEN split_part(id, '_', 2) IN ('P1', 'P2', 'P3', 'P4') THEN 'Parallel / Alt Art ' || split_part(id, '_', 2) ELSE split_part(id, '_', 2) END AS label FROM catalogue)
        SELECT pos, label, CASE WHEN pos % 2 <> 0 THEN label WHEN label = 'Standard' THEN 'Parallel / Alt Art ⭐' ELSE label || ' ⭐' END AS starred FROM l""",
    "symbol_order": f"""WITH {CATALOGUE}, s AS (SELECT unnest(string_split(id, '')) AS symbol FROM catalogue)
        SELECT symbol, count(*) AS n, CAST(CASE instr('0123456789OPEBSTR-/\\', symbol) WHEN 0 THEN 100 ELSE instr('0123456789OPEBSTR-/\\', symbol) END AS INTEGER) AS place FROM s GROUP BY symbol""",
}
