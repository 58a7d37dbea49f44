"""Quality rules judged by host: rule failures by domain, shrunk with an empirical beta prior."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, long_rows, materialize, table, word_count

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: What a document fails, by rule; the first two also reject the document itself.
RULES = {
    "few_words": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "10 * n_dup_lines > n_words",
}
BASE = ("few_words", "repetitive")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen, covered, upto = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one whole text; zeros for null."""
    words = text.split() if text else []  # for bytes: exactly the white space of the contract
    if not words:
        return 0, 0, 0, 0, 0
    solid = b"".join(words)
    chars = len(solid.translate(None, _CONTINUATION))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, host, COUNTS...) of docs with columns doc_id, source, text."""
    few = long_rows(docs.select("doc_id", F.col("source").alias("host"), F.col("text").cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))], ["doc_id", "host", *COUNTS])

    kinds = ", ".join(f"{c} {few.schema[c].dataType.simpleString()}" for c in ("doc_id", "host"))
    return few.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return F.expr(" or ".join(f"({RULES[r]})" for r in BASE))


def host_verdicts(stats: DataFrame, max_rate: float = 0.5, most_strength: float = 10_000.0) -> DataFrame:
    """(host, n, blocked) of every host, null being one of them.

    For each rule the prior is a beta distribution fitted by moments to the hosts' failure rates:
    mean = failures / documents; spread = the rates' mean squared distance from it, less what
    drawing n documents would give by itself. The shrunk rate of a host is its posterior mean.
    A host is blocked when any rule's shrunk rate is over max_rate.
    """
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(x)).alias(r) for r, x in RULES.items()))
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(r).alias(r) for r in RULES)).first()
    if not total.n:
        return hosts.select("host", "n", F.lit(False).alias("blocked"))
    mean = {r: total[r] / total.n for r in RULES}
    spread = hosts.agg(*(F.avg(F.pow(F.col(r) / F.col("n") - F.lit(m), 2) - F.lit(m * (1 - m)) / F.col("n")).alias(r) for r, m in mean.items())).first()
    over = F.lit(False)
    for r, m in mean.items():
        strength = most_strength if spread[r] <= 0 else min(most_strength, max(1.0, m * (1 - m) / spread[r] - 1))
        over = over | ((F.col(r) + F.lit(m * strength)) / (F.col("n") + F.lit(strength)) > max_rate)
    return hosts.select("host", "n", over.alias("blocked"))


def judge(docs: DataFrame, **options) -> DataFrame:
    """Verdicts on documents: doc_id, COUNTS, base_failed, kept, host_blocked; one row per input row.

    docs: doc_id, text, source (the host); other columns are ignored. kept is false if the document
    fails a base rule itself or its host is blocked. A null text counts as empty and fails; rows with
    a null source form one host; repeated rows count each. An empty table gives an empty result.
    The verdict of a host reaches its documents by a join whose large hosts AQE splits.
    """
    stats = materialize(counted(docs), "counts")
    hosts = host_verdicts(stats, **options).select(F.col("host").alias("of"), "blocked")
    joined = stats.join(hosts, F.col("host").eqNullSafe(F.col("of")))
    return joined.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~(base_failed() | F.col("blocked"))).alias("kept"), F.col("blocked").alias("host_blocked"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """docs that judge() keeps; all columns stay and texts are not shuffled.

    Texts are read twice, for the hosts and for the documents, as that costs less than a shuffle of them.
    Words are counted by a native function, and only texts with enough of them go to Python.
    """
    host = free_name(docs, "_host")
    blocked = host_verdicts(materialize(counted(docs), "counts"), **options).where("blocked").select(F.col("host").alias(host))
    n_words = word_count(F.col("text"))

    @F.pandas_udf("boolean")
    def repetitive(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: isinstance(x, str) and 100 * repeat_words(words := x.encode().split()) > 50 * len(words)).astype(bool)

    good = docs.join(blocked, docs["source"].eqNullSafe(blocked[host]), "left_anti").where(n_words >= 50)
    return good.where(~repetitive("text")).select(*docs.columns)


def op2_host_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; see judge()."""
    return judge(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB SQL.
SQL = rf"""
with d as (select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
grams as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
twice as (select rid, g from grams group by rid, g having count(*) > 1),
covered as (select rid, count(distinct i + k) as n_repeat_words from grams join twice using (rid, g) cross join (values (0), (1), (2)) v(k) group by rid),
lines as (select rid, line from (select rid, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select rid, count(*) - count(distinct line) as n_dup_lines from lines group by rid),
s as (select doc_id, host, len(ws)::bigint as n_words, coalesce(length(array_to_string(ws, '')), 0)::bigint as word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
      coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join covered using (rid) left join dups using (rid)),
h as (select host, count(*) as n, {", ".join(f"count(*) filter ({x}) as {r}" for r, x in RULES.items())} from s group by host),
m as (select {", ".join(f"sum({r}) / sum(n) as {r}_m" for r in RULES)} from h),
v as (select {", ".join(f"avg(pow({r} / n - {r}_m, 2) - {r}_m * (1 - {r}_m) / n) as {r}_v, any_value({r}_m) as {r}_m" for r in RULES)} from h cross join m),
p as (select {", ".join(f"{r}_m, case when {r}_v <= 0 then 10000 else least(10000, greatest(1, {r}_m * (1 - {r}_m) / {r}_v - 1)) end as {r}_s" for r in RULES)} from v),
b as (select host, {" or ".join(f"({r} + {r}_m * {r}_s) / (n + {r}_s) > 0.5" for r in RULES)} as host_blocked from h cross join p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({RULES["few_words"]} or {RULES["repetitive"]}) as base_failed,
  not ({RULES["few_words"]} or {RULES["repetitive"]} or host_blocked) as kept, host_blocked
from s join b on s.host is not distinct from b.host
"""
