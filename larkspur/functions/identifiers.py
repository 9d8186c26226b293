"""Item codes, file names and display forms, as column expressions.

Codes compare by their upper-case form. A blank value is null, empty or white
space only. Null inputs give null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNBEKANNT"
#: Letters that are read in place of digits, and those digits.
LOOKALIKES, DIGITS = "OILBSZ", "011852"
#: Code prefixes of supported formats.
PREFIXES = ("OP", "ST", "EB", "PRB")
#: Fixed value: the display order of symbols; others come last.
SYMBOL_ORDER = "0123456789OPEBSTR-/\\"


def blank(x: Column) -> Column:
    return x.isNull() | x.rlike(r"(?U)^\s*$")


def key(x: Column) -> Column:
    """The form by which codes are compared, joined and ordered."""
    return F.upper(x)


def printed_number(code: Column) -> Column:
    """A code without its variant, which follows the first underscore."""
    return F.substring_index(code, "_", 1)


def known_number(code: Column) -> Column:
    return key(F.trim(printed_number(code)))


def variant_suffix(code: Column) -> Column:
    """What follows the first underscore, in upper case; null without one."""
    at = F.locate("_", code)
    return F.when(at > 0, F.upper(F.substr(code, at + 1)))


def variant_label(code: Column, has_star: Column | None = None) -> Column:
    """Label of a code's variant; a star turns the standard one into a parallel and marks the others."""
    suffix = variant_suffix(code)
    label = F.when(blank(code), UNKNOWN).when(suffix.isNull(), "Standard").when(suffix.isin("P1", "P2", "P3", "P4"), F.concat(F.lit("Parallel / Alt Art "), suffix)).otherwise(suffix)
    if has_star is None:
        return label
    starred = F.when(label == "Standard", F.lit("Parallel / Alt Art ⭐")).otherwise(F.concat(label, F.lit(" ⭐")))
    return F.when(has_star, starred).otherwise(label)


def set_code(code: Column) -> Column:
    """What precedes the first dash; empty if that is nothing or there is no dash."""
    at = F.locate("-", code)
    return F.when(at > 1, F.substr(code, F.lit(1), at - 1)).otherwise("")


def set_prefix(code: Column) -> Column:
    """The set code with its dash; null without one."""
    at = F.locate("-", code)
    return F.when(at > 1, F.substr(code, F.lit(1), at))


def letter_prefix(code: Column, most: int | None = None) -> Column:
    """Leading letters; empty for blank codes."""
    repeat = "+" if most is None else "{1,%d}" % most
    return F.coalesce(F.regexp_extract(code, rf"^\p{{L}}{repeat}", 0), F.lit(""))


def first_letters(x: Column, n: int = 3) -> Column:
    """The first n letters anywhere."""
    return F.substring(F.regexp_replace(x, r"\P{L}", ""), 1, n)


def fix_digits(x: Column) -> Column:
    return F.translate(x, LOOKALIKES, DIGITS)


def normalize_code(x: Column) -> Column:
    """Upper case, no spaces, plain dashes, and digits for their lookalikes after the last dash."""
    plain = F.translate(F.replace(F.upper(x), F.lit(" "), F.lit("")), "_—–", "---")

    def fixed(p: Column) -> Column:
        tail = F.substring_index(p, "-", -1)
        return F.when(p.contains("-"), F.concat(F.substr(p, F.lit(1), F.length(p) - F.length(tail)), fix_digits(tail))).otherwise(p)

    return F.get(F.transform(F.array(plain), fixed), F.lit(0))  # the plain text is computed once


def extract_code(raw: Column) -> Column:
    """The first code found in noisy text, set codes before promotional ones; null if there is none."""
    text = F.replace(F.translate(F.upper(raw), "_—–", "---"), F.lit("0P"), F.lit("OP"))
    digit = f"[0-9{LOOKALIKES}]"
    in_set = rf"({'|'.join(PREFIXES)})\s*({digit}{{2}})\s*-?\s*({digit}{{3}})"
    promo = rf"(?<![A-Z0-9])P\s*-?\s*({digit}{{3}})"
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(in_set), F.concat(part(in_set, 1), fix_digits(part(in_set, 2)), F.lit("-"), fix_digits(part(in_set, 3)))).when(text.rlike(promo), F.concat(F.lit("P-"), fix_digits(part(promo, 1))))


def supported_format(code: Column) -> Column:
    return code.rlike(rf"(?i)^({'|'.join(PREFIXES)}|P-)")


def plausible_structure(code: Column) -> Column:
    """Five, eight or nine characters with the dash in its place."""
    dash = lambda k: F.substring(code, k, 1) == "-"
    n = F.length(code)
    return F.coalesce(F.when(n == 5, dash(2)).when(n == 8, dash(5)).when(n == 9, dash(6)), F.lit(False))


def plausible_segments(n: Column) -> Column:
    """A number of segments that a code can have."""
    return n.between(4, 14)


def strip_copy_suffix(x: Column) -> Column:
    """Without a trailing _c and number."""
    return F.regexp_replace(x, r"(?i)_c\d+$", "")


def storage_code(container: Column, slot: Column) -> Column:
    """CODE-0007; null if a part is missing."""
    return F.when(~blank(container) & slot.isNotNull(), F.format_string("%s-%04d", container, slot))


def container_code(number: Column) -> Column:
    return F.format_string("BC-%03d", number)


def inventory_id(number: Column) -> Column:
    return F.format_string("VCV-%06d", number)


def safe_file_name(x: Column) -> Column:
    """Characters that file names can't hold become underscores; blank becomes a word for unknown."""
    return F.when(blank(x), "unbekannt").otherwise(F.regexp_replace(x, r'[\x00-\x1F<>:"/\\|?*]', "_"))


def list_text(values: Column) -> Column:
    """Non-blank values with commas; a dash for none."""
    kept = F.filter(values, lambda v: ~blank(v))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise("-")


def shown(x: Column) -> Column:
    """The text, or a dash for blank ones."""
    return F.when(blank(x), "-").otherwise(x)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    """With its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def symbol_rank(symbol: Column) -> Column:
    at = F.call_function("locate", symbol, F.lit(SYMBOL_ORDER))
    return F.when(at == 0, 100).otherwise(at)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def class_label(folder: Column) -> Column:
    """The character that a template folder stands for; null for other folders."""
    return F.when(folder == "Dash", "-").when(folder == "Slash", "/").when(F.length(folder) == 1, folder)


def mapped(counts: Column, name: Column) -> Column:
    """A count from a map, 0 for missing names."""
    return F.coalesce(F.try_element_at(counts, name), F.lit(0))


def duration_text(seconds: Column) -> Column:
    """hh:mm:ss of whole seconds; hours go on beyond a day."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), (F.floor(whole / 60) % 60).cast("long"), whole % 60)


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """What is left of a run at its pace so far; null before anything is done."""
    return F.when(done > 0, elapsed / done * (total - done))
