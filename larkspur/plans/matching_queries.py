"""Nearest numbers, corrections, lattice scores and the evaluation of readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import evaluation, lookups, matching
from .stand_ins import BASE, EVALUATED, FROM, NEAREST, READINGS, TO, catalogue, evaluated, observations, readings


def _numbers(spark, sf_dir):
    return lookups.known_numbers(catalogue(spark, sf_dir))


def nearest_key(spark, sf_dir):
    found = lookups.nearest_number(observations(spark, sf_dir), _numbers(spark, sf_dir))
    return found.select("pos", "code", "number", F.col("distance").cast("long").alias("distance"), F.round("similarity", 6).alias("similarity"))


def unique_within_one_correction(spark, sf_dir):
    cards = lookups.known_numbers(catalogue(spark, sf_dir)).select(F.col("number").alias("id"), F.xxhash64("number").alias("pos"))
    return lookups.correct_codes(observations(spark, sf_dir).select("pos", "code"), cards)


def _scored(spark, sf_dir):
    return readings(spark, sf_dir).withColumn("length", F.explode(F.sequence(F.greatest(F.lit(3), F.length("reading") - 5), F.length("reading") + 2))).join(_numbers(spark, sf_dir).withColumn("length", F.length("number")), "length")


def window_similarity(spark, sf_dir):
    return _scored(spark, sf_dir).select("reading", "number", F.round(scoring.window_similarity(F.col("reading"), F.col("number"), 2), 6).alias("two"), F.round(scoring.window_similarity(F.col("reading"), F.col("number"), 3), 6).alias("three"))


def alignment_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("reading", "number", F.round(scoring.alignment(F.col("lattice"), F.col("number")), 6).alias("score"))


def _quick(name):
    def query(spark, sf_dir):
        return matching.candidates(readings(spark, sf_dir), _numbers(spark, sf_dir), scoring.PROFILES[name]).select("reading", "number", F.round("quick", 6).alias("quick"))

    return query


def _lattice(name):
    def query(spark, sf_dir):
        found = matching.lattice_match(readings(spark, sf_dir), _numbers(spark, sf_dir), name)
        return found.select("reading", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), F.round("confidence", 6).alias("confidence"), F.size("top").cast("long").alias("n_top"))

    return query


def failure_classes(spark, sf_dir):
    return evaluation.failure_histogram(evaluated(spark, sf_dir)).select("failure", "n")


def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(evaluated(spark, sf_dir), top=None)


def confusion_report(spark, sf_dir):
    return evaluation.confusion_matrix(evaluated(spark, sf_dir), top=50)


def accuracy_summary(spark, sf_dir):
    return evaluation.accuracy_summary(evaluated(spark, sf_dir)).select("tested", "correct", "characters", "correct_characters", F.round("accuracy", 6).alias("accuracy"), F.round("character_accuracy", 6).alias("character_accuracy"))


def db_effect(spark, sf_dir):
    return evaluation.database_effect(evaluated(spark, sf_dir))


def stem_accuracy(spark, sf_dir):
    rows = evaluated(spark, sf_dir).select(F.lower("expected").alias("stem"), F.col("text").alias("code"))
    return evaluation.stem_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


def _candidates(spark, sf_dir):
    """Readings of one part type as the candidates of an image."""
    pos = F.col("pos")
    return evaluated(spark, sf_dir).select(F.col("expected").alias("image_of"), pos, (pos % 11 != 0).alias("usable"), F.col("segment_count"), "greedy", "text", (pos % 97 * 1.0).alias("database"), (pos % 83 * 1.0).alias("geometry"), (pos % 89 * 1.0).alias("image"), F.abs(F.col("segment_count") - F.length("text")).alias("length_difference"))


def _global(rows):
    return rows.withColumn("global_score", scoring.global_hypothesis(F.col("database"), F.col("image"), F.col("geometry"), F.col("length_difference"), F.col("greedy"), F.col("text")))


def global_hypothesis(spark, sf_dir):
    rows = _global(_candidates(spark, sf_dir))
    sure = scoring.conclusive(F.col("usable"), F.col("length_difference"), F.col("database") + 4, F.col("image"), F.col("geometry"), F.col("greedy"), F.col("text"))
    return rows.select("pos", F.round("global_score", 6).alias("global_score"), sure.alias("conclusive"))


def better_candidate_fold(spark, sf_dir):
    rows = _global(_candidates(spark, sf_dir)).withColumn("name", F.col("greedy"))
    best = matching.best_candidate(rows, "image_of", "pos").select("image_of", "best.*")
    return best.withColumn("global_score", F.round("global_score", 6)).withColumn("length_difference", F.col("length_difference").cast("int"))


def early_exit(spark, sf_dir):
    rows = _global(_candidates(spark, sf_dir))
    return matching.early_exit(rows, "image_of", "pos", F.col("usable") & (F.col("global_score") >= 85) & (F.col("length_difference") == 0), "global_score").select("image_of", "pos", F.round("global_score", 6).alias("global_score"))


def evaluated_regions(spark, sf_dir):
    """Candidates looked at until a conclusive one, twelve at least."""
    rows = _global(_candidates(spark, sf_dir))
    found = matching.evaluated_until(rows, "image_of", "pos", F.col("usable") & (F.col("global_score") >= 85) & (F.col("length_difference") == 0), 12)
    return found.groupBy("image_of").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("global_score"), 6).alias("best"))


PROFILES = ("core", "engine", "benchmark", "live", "recovery")
QUERIES = {f.__name__: f for f in (nearest_key, unique_within_one_correction, window_similarity, alignment_score, failure_classes, confusion_matrix, confusion_report, accuracy_summary, db_effect, stem_accuracy, global_hypothesis, better_candidate_fold, early_exit, evaluated_regions)}
QUERIES |= {f"quick_score_topk_{name}": _quick(name) for name in PROFILES} | {f"lattice_match_{name}": _lattice(name) for name in PROFILES}


# SQL text of the scores, on columns t (reading), c (number), n and m (their lengths).
def _cell(segment: str, ch: str, other: str) -> str:
    return f"CASE WHEN {ch} = {segment} THEN 90.0 WHEN {ch} = translate({segment}, '{FROM}', '{TO}') THEN 70.0 ELSE {other} END"


def _window(more: int) -> str:
    lengths = f"range(greatest(1, n - 2), least(m, n + {more}) + 1)"
    inner = "list_transform(range(1, m - k + 2), lambda i: 100.0 * (1 - levenshtein(substr(t, i, k), c)::DOUBLE / greatest(n, k)))"
    return f"CASE WHEN contains(t, c) THEN 100.0 ELSE coalesce(list_max(flatten(list_transform({lengths}, lambda k: {inner}))), 0.0) END"


def _offset(p: scoring.Profile) -> str:
    other = str(p.miss) if p.greedy_miss is None else f"CASE WHEN substr(t, j + o, 1) = substr(c, j, 1) THEN {p.greedy_miss} ELSE {p.miss} END"
    one = f"CASE WHEN j - 1 + o < 0 OR j - 1 + o >= m THEN -{p.missing} ELSE {_cell('substr(t, j + o, 1)', 'substr(c, j, 1)', other)} END"
    total = f"list_sum(list_transform(range(1, n + 1), lambda j: {one})) - (m - greatest(0, least(m, n + o) - greatest(0, o))) * {p.extra}"
    best = f"list_max(list_transform(range(-{p.offsets}, {p.offsets} + 1), lambda o: ({total}) / greatest(1, n)))"
    return f"least(greatest({best}, 0.0), 100.0)" if p.clamped else best


_LETTERS = "regexp_extract(t, '^[A-Za-z]{1,3}')"
_BONUS = "CASE WHEN l3 <> '' AND c3 <> '' AND (starts_with(l3, c3) OR starts_with(c3, l3)) THEN 5.0 ELSE 0.0 END"
_SCORED = f"""{BASE}, {READINGS}, scored AS (SELECT reading, number, reading AS t, number AS c, CAST(length(number) AS BIGINT) AS n, CAST(length(reading) AS BIGINT) AS m,
        substr(regexp_replace(reading, '[^A-Za-z]', '', 'g'), 1, 3) AS l3, regexp_extract(number, '^[A-Za-z]{{1,3}}') AS c3
        FROM readings JOIN numbers ON length(number) BETWEEN greatest(3, length(reading) - 5) AND length(reading) + 2)"""


def _banded(p: scoring.Profile) -> str:
    if not p.prefix:
        return "banded AS (SELECT * FROM scored)"
    return f"""fits AS (SELECT *, {_LETTERS} <> '' AND starts_with(upper(c), upper({_LETTERS})) AS fit FROM scored),
        banded AS (SELECT * FROM (SELECT *, count(*) FILTER (fit) OVER (PARTITION BY reading) AS nf FROM fits) WHERE fit OR nf < 3)"""


def _quick_sql(p: scoring.Profile) -> str:
    bonus = f" + {_BONUS}" if p.prefix else ""
    return f"""{_SCORED}, {_banded(p)}, quicks AS (SELECT *, ({_offset(p)}) * {p.quick_base} + ({_window(p.window_more)}) * {p.quick_window}{bonus} AS quick FROM banded),
        kept AS (SELECT * FROM quicks QUALIFY row_number() OVER (PARTITION BY reading ORDER BY quick DESC, number) <= {p.candidates})"""


def _align_cte(p: scoring.Profile, source: str) -> str:
    """The alignment table segment by segment: a cell is the best of those left of it after an upper or diagonal step, less the skipped characters."""
    match = _cell("substr(t, i + 1, 1)", "substr(c, j, 1)", str(scoring.UNLISTED))
    return f"""grid AS (SELECT reading, number, 0::BIGINT AS i, list_transform(range(0, n + 1), lambda j: -{p.missing} * j)::DOUBLE[] AS prev, t, c, n, m FROM {source}
        UNION ALL SELECT reading, number, i + 1, list_transform(range(0, n + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k:
            (CASE WHEN k = 0 THEN prev[1] - {p.extra} ELSE greatest(prev[k + 1] - {p.extra}, prev[k] + {match.replace("substr(c, j, 1)", "substr(c, k, 1)")}) END) - {p.missing} * (j - k)))), t, c, n, m FROM grid WHERE i < m),
        aligned AS (SELECT reading, number, least(greatest(prev[n + 1] / (100.0 * n) * 100.0, 0.0), 100.0) AS align FROM grid WHERE i = m)"""


def _anchored_sql(p: scoring.Profile) -> str:
    dash = "CASE n WHEN 5 THEN 1 WHEN 8 THEN 4 WHEN 9 THEN 5 END"
    score = lambda at, ch: _cell(f"substr(t, {at} + 1, 1)", ch, str(scoring.UNLISTED))
    one = f"CASE WHEN j - 1 + s - ({dash}) < 0 OR j - 1 + s - ({dash}) >= m THEN -{p.missing} ELSE {score(f'(j - 1 + s - ({dash}))', 'substr(c, j, 1)')} END"
    used = f"greatest(0, least(m, n + s - ({dash})) - greatest(0, s - ({dash})))"
    at = f"CASE WHEN {score('s', chr(39) + '-' + chr(39))} >= 35.0 THEN list_sum(list_transform(range(1, n + 1), lambda j: {one})) - (m - {used}) * 3.0 END"
    fits = f"n IN (5, 8, 9) AND substr(c, ({dash}) + 1, 1) = '-'"
    return f"CASE WHEN {fits} THEN least(greatest(coalesce(list_max(list_transform(range(0, m), lambda s: {at})) / n, 0.0), 0.0), 100.0) ELSE 0.0 END"


def _lattice_sql(p: scoring.Profile) -> str:
    bonus = f" + {_BONUS}" if p.prefix else ""
    bonus += f" + ({_anchored_sql(p)}) * {p.anchored}" if p.anchored else ""
    text = _quick_sql(p).replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{text}, {_align_cte(p, "kept")},
        finals AS (SELECT reading, number, least(greatest(align * {p.align} + ({_window(p.window_more)}) * {p.window}{bonus} + CASE WHEN contains(t, c) THEN 8.0 ELSE 0.0 END, 0.0), 100.0) AS final FROM kept JOIN aligned USING (reading, number)),
        tops AS (SELECT reading, max(final) AS score, list_sort(list(final), 'DESC') AS l, least(count(*), 5) AS n_top FROM finals GROUP BY reading),
        m AS (SELECT reading, score, greatest(0.0, l[1] - coalesce(l[2], 0.0)) AS margin, n_top FROM tops)
        SELECT reading, round(score, 6) AS score, round(margin, 6) AS margin, round(least(greatest(score * 0.75 + least(100.0, margin * 10.0) * 0.25, 0.0), 100.0), 6) AS confidence, n_top FROM m"""


_E = f"{BASE}, {NEAREST}, {EVALUATED}"
_PAIRS = """pairs AS (SELECT coalesce(nullif(substr(expected, spot, 1), ''), '∅') AS expected, coalesce(nullif(substr(text, spot, 1), ''), '∅') AS actual
        FROM (SELECT expected, text, unnest(range(1, greatest(length(expected), length(text)) + 1)) AS spot FROM evaluated WHERE is_usable)),
        confused AS (SELECT expected, actual, count(*) AS n FROM pairs WHERE expected <> actual GROUP BY 1, 2)"""
_CANDIDATES = f"""{_E}, cand AS (SELECT expected AS image_of, pos, pos % 11 <> 0 AS usable, greedy, text, pos % 97 * 1.0 AS database, pos % 83 * 1.0 AS geometry, pos % 89 * 1.0 AS image,
        abs(segment_count - length(text)) AS ld FROM evaluated),
     globals AS (SELECT *, least(greatest(database * 0.58 + image * 0.18 + geometry * 0.16 + CASE WHEN (length(text) = 5 AND substr(text, 2, 1) = '-') OR (length(text) = 8 AND substr(text, 5, 1) = '-') OR (length(text) = 9 AND substr(text, 6, 1) = '-') THEN 100.0 ELSE 0.0 END * 0.08
        + CASE WHEN upper(greedy) = upper(text) THEN 4.0 ELSE 0.0 END - ld * 7.5, 0.0), 104.0)::DOUBLE AS g FROM cand)"""

ORACLES = {
    "nearest_key": f"""{BASE}, {NEAREST} SELECT pos, code, number, CAST(distance AS BIGINT) AS distance, round(greatest(0.0, 100.0 * (1 - distance::DOUBLE / greatest(length(code), length(number)))), 6) AS similarity
        FROM observations JOIN nearest USING (code)""",
    "unique_within_one_correction": f"""{BASE}, norm AS (SELECT DISTINCT code, CASE WHEN contains(code, '-') THEN regexp_extract(code, '^(.*-)[^-]*$', 1) || translate(regexp_extract(code, '([^-]*)$', 1), 'OILBSZ', '011852') ELSE code END AS txt FROM observations),
        pre AS (SELECT *, CASE WHEN instr(txt, '-') > 1 THEN substr(txt, 1, instr(txt, '-')) END AS p FROM norm),
        near AS (SELECT code, number, levenshtein(txt, number) AS d FROM pre JOIN numbers ON p IS NULL OR starts_with(number, p)),
        best AS (SELECT code, min(d) AS d, arg_min(number, d) AS number, count(*) FILTER (d = (SELECT min(d) FROM near n2 WHERE n2.code = near.code)) AS n FROM near GROUP BY code)
        SELECT pos, o.code, CASE WHEN txt IN (SELECT number FROM numbers) THEN txt WHEN d <= 1 AND n = 1 THEN number ELSE txt END AS corrected
        FROM observations o JOIN pre USING (code) LEFT JOIN best USING (code)""",
    "window_similarity": f"{_SCORED} SELECT reading, number, round({_window(2)}, 6) AS two, round({_window(3)}, 6) AS three FROM scored",
    "alignment_score": f"{_SCORED.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_align_cte(scoring.PROFILES['core'], 'scored')} SELECT reading, number, round(align, 6) AS score FROM aligned",
    "failure_classes": f"""{_E}, wrong AS (SELECT * FROM evaluated WHERE NOT is_usable OR expected <> text),
        marks AS (SELECT *, list_filter(list_transform(range(1, greatest(length(expected), length(text)) + 1), lambda i: coalesce(nullif(substr(expected, i, 1), ''), '∅') || coalesce(nullif(substr(text, i, 1), ''), '∅')), lambda x: substr(x, 1, 1) <> substr(x, 2, 1)) AS d FROM wrong),
        kinds AS (SELECT *, len(list_filter(d, lambda x: regexp_matches(x, '[0-9]'))) > 0 AS digit, len(list_filter(d, lambda x: NOT regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]'))) > 0 AS alpha,
            len(list_filter(d, lambda x: NOT regexp_matches(x, '[0-9A-Za-z]'))) > 0 AS other FROM marks)
        SELECT CASE WHEN NOT is_usable THEN 'SegmentationFailed' WHEN segment_count < length(expected) THEN 'TooFewSegments' WHEN segment_count > length(expected) THEN 'TooManySegments'
            WHEN greedy = expected AND text <> expected THEN 'DatabaseWrongDecision' WHEN regexp_extract(expected, '^[A-Za-z]+') <> regexp_extract(text, '^[A-Za-z]+') THEN 'PrefixMismatch'
            WHEN digit AND NOT alpha AND NOT other THEN 'DigitMismatch' WHEN alpha AND NOT digit AND NOT other THEN 'LetterMismatch' WHEN margin < 2.0 THEN 'LowConfidence'
            WHEN digit OR alpha OR other THEN 'MixedMismatch' ELSE 'Unknown' END AS failure, count(*) AS n FROM kinds GROUP BY 1""",
    "confusion_matrix": f"{_E}, {_PAIRS} SELECT expected, actual, n FROM confused",
    "confusion_report": f"{_E}, {_PAIRS} SELECT expected, actual, n FROM confused ORDER BY n DESC, expected, actual LIMIT 50",
    "accuracy_summary": f"""{_E}, {_PAIRS}, s AS (SELECT count(*) AS tested, count(*) FILTER (is_usable AND expected = text) AS correct,
        CAST(sum(CASE WHEN is_usable THEN greatest(length(expected), length(text)) ELSE length(expected) END) AS BIGINT) AS characters FROM evaluated)
        SELECT *, round(correct * 100.0 / tested, 6)::DOUBLE AS accuracy, round(correct_characters * 100.0 / characters, 6)::DOUBLE AS character_accuracy FROM s, (SELECT count(*) AS correct_characters FROM pairs WHERE expected = actual)""",
    "db_effect": f"""{_E} SELECT count(*) AS tested, count(*) FILTER (is_usable AND greedy <> expected AND text = expected) AS corrected, count(*) FILTER (is_usable AND greedy = expected AND text <> expected) AS worsened,
        count(*) FILTER (is_usable AND greedy = expected AND text = expected) AS unchanged_right, count(*) FILTER (is_usable AND greedy <> expected AND text <> expected) AS unchanged_wrong,
        count(*) FILTER (NOT is_usable) AS segmentation_failures, count(*) FILTER (is_usable AND margin < 2.0) AS low_margin FROM evaluated""",
    "stem_accuracy": f"{_E} SELECT count(*) AS total, count(*) FILTER (expected = text) AS correct, round(count(*) FILTER (expected = text) * 100.0 / count(*), 6)::DOUBLE AS accuracy FROM evaluated",
    "global_hypothesis": f"{_CANDIDATES} SELECT pos, round(g, 6) AS global_score, usable AND ld = 0 AND database + 4 >= 99.7 AND image >= 82.0 AND geometry >= 82.0 AND upper(greedy) = upper(text) AS conclusive FROM globals",
    "evaluated_regions": f"""{_CANDIDATES}, o AS (SELECT *, row_number() OVER w AS at_row, coalesce(max(CASE WHEN usable AND g >= 85 AND ld = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY image_of ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
        FROM globals WINDOW w AS (PARTITION BY image_of ORDER BY pos)) SELECT image_of, count(*) AS n, round(max(g), 6) AS best FROM o WHERE done = 0 OR at_row <= 12 GROUP BY 1""",
    "early_exit": f"""{_CANDIDATES} SELECT image_of, pos, round(g, 6) AS global_score FROM (SELECT *, usable AND g >= 85 AND ld = 0 AS ok FROM globals)
        QUALIFY row_number() OVER (PARTITION BY image_of ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN 0.0 ELSE -g END, pos) = 1""",
}
ORACLES |= {f"quick_score_topk_{name}": f"{_quick_sql(scoring.PROFILES[name])} SELECT reading, number, round(quick, 6) AS quick FROM kept" for name in PROFILES}
ORACLES |= {f"lattice_match_{name}": _lattice_sql(scoring.PROFILES[name]) for name in PROFILES}
_BETTER = """CASE WHEN a.usable <> b.usable THEN a.usable WHEN NOT a.usable THEN a.image > b.image WHEN abs(a.g - b.g) > 0.35 THEN a.g > b.g
        WHEN a.ld <> b.ld THEN a.ld < b.ld WHEN abs(a.database - b.database) > 0.25 THEN a.database > b.database
        WHEN abs(a.geometry - b.geometry) > 0.5 THEN a.geometry > b.geometry ELSE a.image > b.image END"""
ORACLES["better_candidate_fold"] = f"""{_CANDIDATES.replace("WITH ", "WITH RECURSIVE ", 1)},
     sequence AS (SELECT image_of, {{'usable': usable, 'g': g, 'ld': ld, 'database': database::DOUBLE, 'geometry': geometry::DOUBLE, 'image': image::DOUBLE, 'name': greedy}} AS c, row_number() OVER (PARTITION BY image_of ORDER BY pos) AS k FROM globals),
     fold AS (SELECT image_of, c AS b, k FROM sequence WHERE k = 1
        UNION ALL SELECT image_of, CASE WHEN {_BETTER} THEN a ELSE b END, k FROM (SELECT f.image_of, f.b, n.c AS a, n.k FROM fold f JOIN sequence n ON n.image_of = f.image_of AND n.k = f.k + 1))
     SELECT image_of, b.usable AS usable, round(b.g, 6) AS global_score, CAST(b.ld AS INTEGER) AS length_difference, b.database AS database, b.geometry AS geometry, b.image AS image, b.name AS name
     FROM fold QUALIFY k = max(k) OVER (PARTITION BY image_of)"""
