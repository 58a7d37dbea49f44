"""References, names and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of references in a narration, in order of priority.
PATTERNS = (
    r"(?i)INV[-\s]?\d{4}[-\s]?\d{4,6}",
    r"order[_-][A-Za-z0-9]{10,20}",
    r"pay[_-][A-Za-z0-9]{10,20}",
    r"setl[_-][A-Za-z0-9]{10,20}",
    r"\b[A-Z0-9]{6,14}\b",
    r"\b\d{6,12}\b",
)
#: Words of a company name that say nothing.
COMPANY_WORDS = ("PVT", "LTD", "LLP", "AND", "CO")
#: Kinds of match, best first, with similarity and penalty in thousandths.
KINDS = (("exact", 1000, 0), ("contains", 850, 0), ("last6", 700, 100), ("transposed", 550, 150))


def normalize_ref(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def last6(full: Column) -> Column:
    return F.right(full, F.lit(6))


def ref_keys(refs: Column) -> Column:
    """array of references -> array of struct(full, last6)."""
    return F.transform(refs, lambda r: F.struct(normalize_ref(r).alias("full"), last6(normalize_ref(r)).alias("last6")))


def extract_references(narration: Column) -> Column:
    """Every reference-shaped token, by pattern, each once, in order of first sight."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(narration, F.lit(p), F.lit(0)) for p in PATTERNS)))


def edit_distance(a: Column, b: Column, cap: int = 4) -> Column:
    """Levenshtein distance that gives cap + 1 as soon as the lengths differ by more, or every way to match
    a prefix of `a` with some prefix of `b` does; where neither holds it is the true distance."""
    whole = F.levenshtein(a, b)
    # the last row decides: the least distance of all of `a` to a prefix of `b`
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.length(b)), lambda n: F.levenshtein(a, F.substring(b, F.lit(1), n))))
    return F.when(a == b, F.lit(0)).when((F.abs(F.length(a) - F.length(b)) > cap) | (least > cap), F.lit(cap + 1)).otherwise(whole)


def reference_similarity(a: Column, b: Column) -> Column:
    """0..1; both sides are normalized first."""
    x, y = normalize_ref(a), normalize_ref(b)
    d = edit_distance(x, y)
    far = F.greatest(F.lit(0.0), 1 - d / F.greatest(F.length(x), F.length(y), F.lit(1)))
    return (
        F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).when(F.contains(x, y) | F.contains(y, x), F.lit(0.85))
        .when(last6(x) == last6(y), F.lit(0.7)).when(d <= 2, (75 - d * 10) / F.lit(100.0)).otherwise(far)
    )


def is_transposition(a: Column, b: Column) -> Column:
    """Equal length of 6 or more, the same characters, and exactly two places that differ."""
    letters = lambda x: F.array_sort(F.split(x, ""))
    differ = F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    long_enough = (F.length(a) == F.length(b)) & (F.length(a) >= 6)
    return F.when(long_enough, (letters(a) == letters(b)) & (differ == 2)).otherwise(F.lit(False))


def match_kind(keys: Column, expected: Column) -> Column:
    """Rank of the best way in which any key names any expected reference: 1 exact, 2 contains, 3 last6,
    4 transposed, 5 none. Expected ones shorter than four characters are passed over."""

    def rank(key: Column, want: Column) -> Column:
        full = key["full"]
        inside = (F.length(full) >= 6) & (F.contains(full, want) | F.contains(want, full))
        tail = (F.length(key["last6"]) == 6) & (key["last6"] == last6(want))
        return F.when(full == want, 1).when(inside, 2).when(tail, 3).when(is_transposition(full, want), 4).otherwise(5)

    wanted = F.filter(F.transform(F.filter(expected, lambda e: e.isNotNull()), normalize_ref), lambda w: F.length(w) >= 4)
    ranks = F.flatten(F.transform(wanted, lambda w: F.transform(keys, lambda k: rank(k, w))))
    return F.coalesce(F.array_min(ranks), F.lit(5))


def kind_name(rank: Column) -> Column:
    out = F.lit("none")
    for i, (name, _, _) in enumerate(KINDS, 1):
        out = F.when(rank == i, F.lit(name)).otherwise(out)
    return out


def kind_value(rank: Column, which: int) -> Column:
    """Similarity (1) or penalty (2) of a kind in thousandths; 0 for none."""
    out = F.lit(0)
    for i, row in enumerate(KINDS, 1):
        out = F.when(rank == i, F.lit(row[which])).otherwise(out)
    return out


def name_tokens(name: Column) -> Column:
    words = F.split(F.regexp_replace(F.upper(name), "[^A-Z0-9 ]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*COMPANY_WORDS)))


def name_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the token sets; 0 if either is empty."""
    x, y = name_tokens(a), name_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def date_only(value: Column) -> Column:
    """The first ten characters as a date; a stamp's own calendar day, never moved to another zone."""
    return F.to_date(F.substring(value.cast("string"), 1, 10))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def dates_in_order(issue: Column, captured: Column, settled: Column, value: Column) -> Column:
    s = F.coalesce(settled, captured)
    return (issue <= captured) & (captured <= s) & (s <= value)


def days_since(day: Column, today: str = "2026-03-31") -> Column:
    """Whole days up to the fixed day of report, never negative, 0 for no date."""
    return F.greatest(F.lit(0), F.coalesce(F.datediff(F.lit(today).cast("date"), day), F.lit(0)))


def group_key(*ids: Column) -> Column:
    """Sorted ids joined by |, which is equal for equal sets."""
    return F.array_join(F.array_sort(F.concat(*ids)), "|")


def padded_id(prefix: str, number: Column, width: int = 6) -> Column:
    return F.format_string(f"{prefix}-%0{width}d", number)
