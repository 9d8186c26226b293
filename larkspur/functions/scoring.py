"""Scores of a code against a reading, as column expressions.

A reading has a greedy text and a lattice: for each segment a map from character
to score (0 to 100). Everything stays in Catalyst expressions: the alignment is
a nested ``aggregate`` over the lattice, offsets and windows are ``transform``s.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import clamp, first_letters, letter_prefix, plausible_structure


@dataclass(frozen=True)
class Profile:
    """Constants of one way of matching; see the fixed values below."""

    offsets: int
    miss: float
    greedy_miss: float | None
    clamped: bool
    quick_base: float
    quick_window: float
    window_more: int
    candidates: int
    missing: float
    extra: float
    align: float
    window: float
    prefix: bool = False
    anchored: float = 0.0


#: The four matching profiles, and the engine's one with an anchored-format share.
PROFILES = {
    "core": Profile(3, 18.0, None, True, 0.65, 0.35, 3, 100, 28.0, 16.0, 0.65, 0.35),
    "engine": Profile(2, 25.0, None, False, 1.0, 0.75, 2, 80, 28.0, 16.0, 0.65, 0.35),
    "benchmark": Profile(2, 25.0, 65.0, False, 1.0, 0.75, 2, 100, 28.0, 16.0, 0.65, 0.35),
    "live": Profile(3, 18.0, None, True, 0.60, 0.35, 3, 25, 30.0, 18.0, 0.62, 0.33, prefix=True),
    "recovery": Profile(2, 25.0, None, False, 1.0, 0.75, 2, 80, 28.0, 16.0, 0.55, 0.30, anchored=0.15),
}
#: Default score of a character that a segment doesn't list, and the substring bonus.
UNLISTED, SUBSTRING_BONUS, PREFIX_BONUS = 18.0, 8.0, 5.0


def _range(n: Column) -> Column:
    """1 to n; empty for n below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _character(code: Column, at: Column) -> Column:
    return F.substr(code, at, F.lit(1))


def alignment(lattice: Column, code: Column, missing: float = 28.0, extra: float = 16.0) -> Column:
    """Best alignment of segments and characters, 0 to 100.

    A skipped segment costs ``extra``, a skipped character ``missing``; a match
    earns the segment's score for the character. A row of the table is built per
    segment, from the row before.
    """
    n = F.length(code)
    start = F.transform(F.sequence(F.lit(0), n), lambda j: -missing * j.cast("double"))

    def row(before: Column, segment: Column) -> Column:
        first = F.array(F.get(before, F.lit(0)) - extra)

        def cell(now: Column, j: Column) -> Column:
            match = F.get(before, j - 1) + F.coalesce(F.try_element_at(segment, _character(code, j)), F.lit(UNLISTED))
            return F.concat(now, F.array(F.greatest(F.get(before, j) - extra, F.get(now, j - 1) - missing, match)))

        return F.aggregate(_range(n), first, cell)

    best = F.get(F.aggregate(lattice, start, row), n)
    return F.when(n == 0, F.lit(0.0)).otherwise(clamp(best / (100.0 * n) * 100.0))


def best_offset(lattice: Column, greedy: Column, code: Column, profile: Profile) -> Column:
    """The best mean score over shifts of the code along the lattice; missing characters and unused segments cost."""
    n, segments = F.length(code), F.size(lattice)

    def at(offset: Column) -> Column:
        def one(total: Column, j: Column) -> Column:
            place = j - 1 + offset
            inside = (place >= 0) & (place < segments)
            other = F.lit(profile.miss)
            if profile.greedy_miss is not None:
                other = F.when(_character(greedy, place + 1) == _character(code, j), profile.greedy_miss).otherwise(other)
            listed = F.try_element_at(F.get(lattice, place), _character(code, j))
            return total + F.when(inside, F.coalesce(listed, other)).otherwise(-profile.missing)

        used = F.greatest(F.lit(0), F.least(segments, n + offset) - F.greatest(F.lit(0), offset))
        total = F.aggregate(_range(n), F.lit(0.0), one) - (segments - used) * profile.extra
        mean = total / F.greatest(F.lit(1), n)
        return mean if profile.greedy_miss is None else F.when(used > 0, mean)

    best = F.array_max(F.transform(F.sequence(F.lit(-profile.offsets), F.lit(profile.offsets)), at))
    return clamp(best) if profile.clamped else best


def text_similarity(a: Column, b: Column) -> Column:
    """100 less the share of edits, letters in either case."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise(clamp(100.0 * (1 - F.levenshtein(F.upper(a), F.upper(b)) / longest)))


def window_similarity(text: Column, code: Column, more: int = 2) -> Column:
    """The best similarity of the code with a stretch of the text of nearly its length; 100 if it is contained, 0 if one is empty."""
    t, c = F.upper(text), F.upper(code)
    n, m = F.length(c), F.length(t)
    lengths = F.sequence(F.greatest(F.lit(1), n - 2), F.least(m, n + more))
    by_length = F.transform(
        F.when(F.greatest(F.lit(1), n - 2) <= F.least(m, n + more), lengths).otherwise(F.array().cast("array<int>")),
        lambda k: F.array_max(F.transform(F.sequence(F.lit(1), m - k + 1), lambda i: 100.0 * (1 - F.levenshtein(F.substr(t, i, k), c) / F.greatest(n, k)))),
    )
    return F.when((F.trim(t) == "") | (F.trim(c) == ""), 0.0).when(t.contains(c), 100.0).otherwise(F.coalesce(F.array_max(by_length), F.lit(0.0)))


def prefix_bonus(text: Column, code: Column) -> Column:
    """Letters that begin one another: the text's first three anywhere, the code's leading three."""
    a, b = F.upper(first_letters(text)), F.upper(letter_prefix(code, 3))
    return F.when((a != "") & (b != "") & (a.startswith(b) | b.startswith(a)), PREFIX_BONUS).otherwise(0.0)


def anchored_format(lattice: Column, code: Column, missing: float = 28.0, least_dash: float = 35.0, outside: float = 3.0) -> Column:
    """The code laid over the lattice so that its dash meets a segment that may be one; the best such place, 0 to 100."""
    n, segments = F.length(code), F.size(lattice)
    dash = F.when(n == 5, 1).when(n == 8, 4).when(n == 9, 5)
    score = lambda place, ch: F.coalesce(F.try_element_at(F.get(lattice, place), ch), F.lit(UNLISTED))

    def at(place: Column) -> Column:
        offset = place - dash

        def one(total: Column, j: Column) -> Column:
            here = j - 1 + offset
            return total + F.when((here >= 0) & (here < segments), score(here, _character(code, j))).otherwise(-missing)

        used = F.greatest(F.lit(0), F.least(segments, n + offset) - F.greatest(F.lit(0), offset))
        return F.when(score(place, F.lit("-")) >= least_dash, F.aggregate(_range(n), F.lit(0.0), one) - (segments - used) * outside)

    places = F.when(segments > 0, F.sequence(F.lit(0), segments - 1)).otherwise(F.array().cast("array<int>"))
    best = F.array_max(F.transform(places, at))
    return F.when(plausible_structure(code) & best.isNotNull(), clamp(best / n)).otherwise(0.0)


def quick_score(lattice: Column, greedy: Column, code: Column, profile: Profile) -> Column:
    score = best_offset(lattice, greedy, code, profile) * profile.quick_base + window_similarity(greedy, code, profile.window_more) * profile.quick_window
    return score + prefix_bonus(greedy, code) if profile.prefix else score


def final_score(lattice: Column, greedy: Column, code: Column, profile: Profile) -> Column:
    score = alignment(lattice, code, profile.missing, profile.extra) * profile.align + window_similarity(greedy, code, profile.window_more) * profile.window
    if profile.prefix:
        score = score + prefix_bonus(greedy, code)
    if profile.anchored:
        score = score + anchored_format(lattice, code, profile.missing) * profile.anchored
    return clamp(score + F.when(F.upper(greedy).contains(F.upper(code)), SUBSTRING_BONUS).otherwise(0.0))


def database_confidence(top: Column, margin: Column) -> Column:
    return clamp(top * 0.75 + F.least(F.lit(100.0), margin * 10.0) * 0.25)


def overall_confidence(reading: Column, database: Column, any_candidate: Column) -> Column:
    """Reading and database together; without candidates a share of the reading's."""
    read = clamp(reading)
    return clamp(F.when(any_candidate, read * 0.45 + database * 0.55).otherwise(read * 0.6))


def global_hypothesis(database: Column, image: Column, geometry: Column, length_difference: Column, greedy: Column, code: Column) -> Column:
    """Up to 104: agreement of greedy text and code adds four. Rounded to nine decimals, so that thresholds and ties compare decimals: a sum of 85 is no 84.99999999999999."""
    shape = F.when(plausible_structure(code), 100.0).otherwise(0.0)
    exact = F.when(F.upper(greedy) == F.upper(code), 4.0).otherwise(0.0)
    return F.round(clamp(database * 0.58 + image * 0.18 + clamp(geometry) * 0.16 + shape * 0.08 + exact - length_difference * 7.5, 0, 104), 9)


def conclusive(usable: Column, length_difference: Column, database: Column, image: Column, geometry: Column, greedy: Column, code: Column) -> Column:
    return usable & (length_difference == 0) & (database >= 99.7) & (image >= 82.0) & (geometry >= 82.0) & (F.upper(greedy) == F.upper(code))


def vector_similarity(a: Column, b: Column, spread: float = 255.0) -> Column:
    """100 less the mean absolute difference as a share of the spread."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 100.0 - total / F.size(a) / spread * 100.0


def template_score(similarity: Column, ink_difference: Column) -> Column:
    """Pixels and share of ink."""
    return similarity * 0.84 + clamp(100.0 - ink_difference * 250.0) * 0.16


#: Failure classes in the order of their tests.
FAILURES = ("SegmentationFailed", "TooFewSegments", "TooManySegments", "DatabaseWrongDecision", "PrefixMismatch", "DigitMismatch", "LetterMismatch", "LowConfidence", "MixedMismatch", "Unknown")


def failure_class(expected: Column, text: Column, greedy: Column, segments: Column, usable: Column, margin: Column) -> Column:
    """Why a reading failed; the first test that holds."""
    place = F.sequence(F.lit(1), F.greatest(F.length(expected), F.length(text), F.lit(1)))
    letter = lambda x, j: F.coalesce(F.nullif(_character(x, j), F.lit("")), F.lit("∅"))
    pairs = F.filter(F.transform(place, lambda j: F.struct(letter(expected, j).alias("e"), letter(text, j).alias("a"))), lambda p: p["e"] != p["a"])
    either = lambda p, pattern: p["e"].rlike(pattern) | p["a"].rlike(pattern)
    digit = F.exists(pairs, lambda p: either(p, r"\p{Nd}"))
    alpha = F.exists(pairs, lambda p: ~either(p, r"\p{Nd}") & either(p, r"\p{L}"))
    other = F.exists(pairs, lambda p: ~either(p, r"\p{Nd}") & ~either(p, r"\p{L}"))
    return (
        F.when(~F.coalesce(usable, F.lit(False)), FAILURES[0])
        .when(segments < F.length(expected), FAILURES[1])
        .when(segments > F.length(expected), FAILURES[2])
        .when((greedy == expected) & (text != expected), FAILURES[3])
        .when(letter_prefix(expected) != letter_prefix(text), FAILURES[4])
        .when(digit & ~alpha & ~other, FAILURES[5])
        .when(alpha & ~digit & ~other, FAILURES[6])
        .when(margin < 2.0, FAILURES[7])
        .when(digit | alpha | other, FAILURES[8])
        .otherwise(FAILURES[9])
    )
