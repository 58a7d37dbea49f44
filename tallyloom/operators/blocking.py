"""Joins by closeness, order and containment as equi-joins on blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs
from ..scratch import drop
from .pools import checkpointed


def _bucket(x: Column, width: int) -> Column:
    return F.floor(x / width).cast("bigint")


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tolerance: int, extra: Column | None = None) -> DataFrame:
    """Rows of both sides whose numbers differ by tolerance at most.

    Buckets are tolerance + 1 wide, so partners lie in the same bucket or the next; the right side is
    copied into the three it may meet. No range condition reaches the planner without an equality.
    """
    wide = tolerance + 1
    a = left.withColumn("_b", _bucket(F.col(left_on), wide))
    b = right.withColumn("_b", F.explode(F.array(*(_bucket(F.col(right_on), wide) + i for i in (-1, 0, 1)))))
    near = F.abs(a[left_on] - b[right_on]) <= tolerance
    out = a.join(b, "_b").where(near if extra is None else near & extra)
    return out.drop("_b")


def date_band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, days: int) -> DataFrame:
    """Rows of both sides whose dates are at most so many days apart."""
    epoch = F.lit("1970-01-01").cast("date")
    a, b = left.withColumn("_l", F.datediff(left_on, epoch).cast("bigint")), right.withColumn("_r", F.datediff(right_on, epoch).cast("bigint"))
    return band_join(a, b, "_l", "_r", days).drop("_l", "_r")


def _cells(left: DataFrame, right: DataFrame, amounts: tuple[str, str], tolerance: int, days: tuple[str, str] | None, within: int) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with a cell of amount and day (_a, _d), the right one in every cell in which its partners may lie, and
    the condition of being near."""
    epoch = F.lit("1970-01-01").cast("date")
    day = lambda side: _bucket(F.datediff(days[side], epoch), within + 1) if days else F.lit(0).cast("bigint")
    around = lambda x, wide: F.explode(F.array(*(x + i for i in ((-1, 0, 1) if wide else (0,)))))
    a = left.withColumns({"_a": _bucket(F.col(amounts[0]), tolerance + 1), "_d": day(0)})
    b = right.withColumn("_a", around(_bucket(F.col(amounts[1]), tolerance + 1), tolerance)).withColumn("_d", around(day(1), days and within))
    near = F.abs(F.col(amounts[0]) - F.col(amounts[1])) <= tolerance
    return a, b, near & (refs.days_apart(F.col(days[0]), F.col(days[1])) <= within) if days else near


def grid_join(left: DataFrame, right: DataFrame, amounts: tuple[str, str], tolerance: int, days: tuple[str, str], within: int) -> DataFrame:
    """Rows of both sides whose amounts differ by tolerance, and whose days by so many, at most.

    Cells of amount and day are equi-joined, so records of one price meet those of their own days alone.
    """
    a, b, near = _cells(left, right, amounts, tolerance, days, within)
    return a.join(b, ["_a", "_d"]).where(near).drop("_a", "_d")


#: A cell is crowded if its pairs are over so many for each of its rows.
CROWD = 16
#: References this short may be named inside longer words.
SHORT = (4, 5)


def _swaps(x: Column) -> list[Column]:
    """Texts with two letters swapped have the same letters, and every third letter alike from the first, second or third on."""
    letters = F.array_join(F.array_sort(F.split(x, "")), "")
    every = lambda i: F.array_join(F.filter(F.split(x, ""), lambda _, at: at % 3 == i), "")
    return [F.concat(F.lit(f"s{i}"), letters, every(i)) for i in range(3)]


def _anchors(texts: Column, as_key: bool, kinds: int) -> Column:
    """Where references and keys must meet to be of one of the first kinds: by side, so that a tail of the one meets the places of
    the other."""
    own, other = ("k", "w") if as_key else ("w", "k")

    def places(x: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - n, F.lit(0))), lambda i: F.concat(F.lit(other), F.substring(x, i + 1, F.lit(n))))

    def of(x: Column) -> Column:
        inside = [places(x, n) for n in ((ANCHOR, *SHORT) if as_key else (ANCHOR,))]  # a short reference has no six places
        return F.concat(F.array(F.concat(F.lit(own), refs.last6(x)), *(_swaps(x) if kinds >= 4 else [])), *inside)

    return F.array_distinct(F.flatten(F.transform(texts, of)))


def named_join(
    left: DataFrame, right: DataFrame, ids: tuple[list[str], list[str]], amounts: tuple[str, str], tolerance: int, wanted: list[str], keys: str, kinds: int,
    days: tuple[str, str] | None = None, within: int = 0, crowd: int = CROWD,
) -> DataFrame:
    """Rows near in amount, and in day if days are given, of which the right one's keys name a wanted reference of the left
    one by one of the first `kinds` kinds of match_kind(), which is column kind. ids: columns that tell the rows of each side.

    Cells of amount and day are equi-joined. Where one is crowded, as when thousands of records have one price, its rows meet by
    reference inside the cell instead: a tail of the one at a place of the other, or equal letters and every third alike. What is crowded is
    counted, by a partial count of both sides. Neither way loses a pair.
    """
    a, b, near = _cells(left, right, amounts, tolerance, days, within)
    kind = refs.match_kind(F.col(keys), F.array(*wanted))
    count = lambda df, name: df.groupBy("_a", "_d").agg(F.count(F.lit(1)).alias(name))
    busy = count(a, "n").join(count(b, "m"), ["_a", "_d"]).where(F.col("n") * F.col("m") > crowd * (F.col("n") + F.col("m")))
    busy = checkpointed(busy.select("_a", "_d"))
    out = lambda pairs: pairs.where(near).withColumn("kind", kind).where(F.col("kind") <= kinds).drop("_a", "_d")
    if not busy.take(1):
        return out(a.join(b, ["_a", "_d"]))
    few = out(a.join(busy, ["_a", "_d"], "left_anti").join(b, ["_a", "_d"]))
    met = crowded_pairs(a, b, busy, ids, wanted, keys, kinds)
    return few.unionByName(out(met.join(left, ids[0]).join(right, ids[1])).select(*few.columns))


def crowded_pairs(a: DataFrame, b: DataFrame, busy: DataFrame, ids: tuple[list[str], list[str]], wanted: list[str], keys: str, kinds: int) -> DataFrame:
    """The different pairs of ids whose rows share a cell of busy and an anchor of a reference."""
    wants = F.filter(F.transform(F.filter(F.array(*wanted), lambda w: w.isNotNull()), refs.normalize_ref), lambda w: F.length(w) >= SHORT[0])
    of = lambda df, own, texts, as_key: df.join(busy, ["_a", "_d"], "left_semi").select(*own, "_a", "_d", F.explode(_anchors(texts, as_key, kinds)).alias("_on"))
    x, y = of(a, ids[0], wants, False), of(b, ids[1], F.transform(keys, lambda k: k["full"]), True)
    return x.join(y, ["_a", "_d", "_on"]).select(*ids[0], *ids[1]).distinct()


def _substrings(column: str, lengths: list[int]) -> Column:
    """The different substrings of the given lengths."""
    of = lambda n: F.expr(f"if(length({column}) >= {n}, transform(sequence(1, length({column}) - {n} + 1), i -> substring({column}, i, {n})), array())")
    return F.array_distinct(F.flatten(F.array(*map(of, lengths))))


#: Containment is anchored on so many last characters of the shorter text.
ANCHOR = 6


def _tail(column: str) -> Column:
    return F.right(F.col(column), F.lit(ANCHOR))


def grams(texts: DataFrame, column: str) -> DataFrame:
    """(column, _on): every six characters of the texts that have so many, as a table."""
    return checkpointed(texts.select(column, F.explode(_substrings(column, [ANCHOR])).alias("_on")))


def anchored(needle_grams: DataFrame, hay_grams: DataFrame, needle: str, hay: str) -> DataFrame:
    """(needle, hay): hays with the rarest six characters of a needle, all of whose others some hay has as well.

    How many hays have six characters is counted; a stem or an ending that all texts share anchors none of them.
    """
    seen = hay_grams.groupBy("_on").agg(F.count(F.lit(1)).alias("n"))
    rarest = needle_grams.join(seen, "_on", "left").groupBy(needle).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_on")).alias("x"))
    return rarest.where("x.n > 0").select(needle, F.col("x._on").alias("_on")).join(hay_grams, "_on").select(needle, hay)


def inside(needles: DataFrame, hays: DataFrame, needle: str, hay: str, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pairs (needle, hay) of different texts, one column each, in which the first is part of the second.

    A needle of six characters or more meets the hays that have its rarest six characters: an equi-join, and a check. Shorter
    needles meet the substrings of their few lengths. tables: grams() of both sides, if they are there already.
    """
    own, places = tables or (grams(needles, needle), grams(hays, hay))
    out = anchored(own, places, needle, hay).where(F.contains(F.col(hay), F.col(needle)))
    short = hays.select(hay, F.explode(_substrings(hay, list(range(1, ANCHOR)))).alias(needle))
    few = needles.where((F.length(needle) < ANCHOR) & (F.col(needle) != ""))
    return out.unionByName(short.join(few, needle).select(needle, hay)) if few.take(1) else out


def reference_join(keys: DataFrame, wanted: DataFrame, swapped: bool = False) -> DataFrame:
    """Pairs (key_id, full, want_id, target) in which a key names a wanted reference in any of the four ways.

    keys: key_id, full; wanted: want_id, target (both normalized). Every way is an equality: of the
    whole, of the tail, of the sorted letters, and for containment of the rarest anchor of the one with
    a place of the other. Different texts meet first, so a word that all lines share meets a reference
    once; their rows are looked up by the texts that did match. swapped: of texts with the same letters only those with two of
    them swapped, which meet by the letters and every third in place; numbers have the letters of many others.
    """
    k = keys.where("full <> ''").select("key_id", "full")
    w = wanted.where("length(target) >= 4").select("want_id", "target")
    f, t = checkpointed(k.select("full").distinct()), checkpointed(w.select("target").distinct())
    long = f.where("length(full) >= 6")
    letters = lambda texts, c: texts.select(c, F.array_join(F.array_sort(F.split(F.col(c), "")), "").alias("on"))
    swaps = lambda texts, c: texts.where(F.length(c) >= 6).select(c, F.explode(F.array(*_swaps(F.col(c)))).alias("on"))
    near = F.levenshtein("full", "target", 2) >= 0  # two places differ at most
    of_keys, of_wanted = grams(long, "full"), grams(t, "target")
    by = [
        f.select("full", F.col("full").alias("target")).join(t, "target"),
        long.withColumn("on", _tail("full")).join(t.withColumn("on", _tail("target")), "on"),
        swaps(long, "full").join(swaps(t, "target"), "on").where(near) if swapped else letters(long, "full").join(letters(t, "target"), "on"),
        inside(long, t, "full", "target", (of_keys, of_wanted)),
        inside(t, long, "target", "full", (of_wanted, of_keys)),
    ]
    met = [checkpointed(x.select("full", "target")) for x in by]  # one way after the other, so their shuffles do not add up
    drop(of_keys, of_wanted, f, t)
    pairs = checkpointed(reduce(DataFrame.unionByName, met).distinct())
    drop(*met)
    return k.join(pairs, "full").join(w, "target").select("key_id", "full", "want_id", "target")


def contained(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Keys (column full) equal to, inside, or around some known reference (column target), distinct."""
    k, t = checkpointed(keys.select("full").distinct()), checkpointed(known.select("target").distinct())
    of_keys, of_known = grams(k, "full"), grams(t, "target")
    named = checkpointed(inside(k, t, "full", "target", (of_keys, of_known)).select("full").distinct())
    around = checkpointed(inside(t, k, "target", "full", (of_known, of_keys)).select("full").distinct())
    drop(of_keys, of_known, k, t)
    return named.unionByName(around).distinct()
