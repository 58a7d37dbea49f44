"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, table, word_count

#: Weights by a source's place in code-point order (null last), repeating; share of all sizes; copies at most.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2


def water_fill(sizes: list[int], weights: list[float], total: float, copies: int = COPIES) -> list[float]:
    """Share total by weight; none gets over copies times its size, the excess is shared again."""
    target, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / whole > copies * sizes[i]]
        if not over:
            for i in open_:
                target[i] = total * weights[i] / whole
            break
        for i in over:
            target[i] = float(copies * sizes[i])
        total -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def route(capacity: list[int], members: list[list[int]], quota: list[int], copies: int = COPIES) -> list[list[int]]:
    """Min-cost maximum flow from membership patterns to source quotas.

    Pattern p may send capacity[p] words at each repetition to any source in members[p]; the r-th
    repetition costs r - 1 a word, so costs are convex. As only a pattern's own arcs cost anything,
    filling one repetition to its maximum flow before the next is opened gives the least cost.
    Returns the words that each pattern sends to each of its members.
    """
    sent = [[0] * len(m) for m in members]
    into: list[list[tuple[int, int]]] = [[] for _ in quota]
    for p, m in enumerate(members):
        for k, s in enumerate(m):
            into[s].append((p, k))
    left, room = list(quota), [0] * len(capacity)
    for _ in range(copies):
        room = [r + c for r, c in zip(room, capacity, strict=True)]
        while True:
            # breadth-first over patterns with room; a step back from a source frees words of another pattern
            via: dict[int, tuple[int, int]] = {}
            came: dict[int, tuple[int, int] | None] = {p: None for p, r in enumerate(room) if r}
            todo, end = deque(came), None
            while todo and end is None:
                p = todo.popleft()
                for k, s in enumerate(members[p]):
                    if s in via:
                        continue
                    via[s] = (p, k)
                    if left[s]:
                        end = s
                        break
                    for q, j in into[s]:
                        if q not in came and sent[q][j]:
                            came[q] = (s, j)
                            todo.append(q)
            if end is None:
                break
            path, s = [], end
            while True:
                p, k = via[s]
                path.append((p, k, came[p]))
                if came[p] is None:
                    break
                s = came[p][0]
            amount = min([left[end], room[path[-1][0]], *(sent[p][back[1]] for p, _, back in path if back)])
            for p, k, back in path:
                sent[p][k] += amount
                if back:
                    sent[p][back[1]] -= amount
            left[end] -= amount
            room[path[-1][0]] -= amount
    return sent


def _cuts(sized: DataFrame, wanted: dict[str, int], rows: int, per_bucket: int = 50_000) -> dict[str, tuple]:
    """Where in each pattern's seeded order the wanted words end.

    Sums by bucket of the order find the bucket, and only its rows are sorted: no pattern, however
    large, is ordered in one task. Gives bucket, place, words still wanted there, words there.
    """
    spark = sized.sparkSession
    n = max(16, rows // per_bucket)
    ask = F.broadcast(spark.createDataFrame(list(wanted.items()), "pattern string, wanted long"))  # a row for each pattern
    placed = sized.withColumn("bucket", F.pmod("place", F.lit(n)))
    before = lambda sums, by: sums.withColumn("before", F.expr(f"sum(words) over (partition by pattern order by {by} rows unbounded preceding) - words"))
    here = lambda df: df.where("wanted > before and wanted <= before + words")
    at = here(before(placed.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")), "bucket").join(ask, "pattern"))
    at = materialize(at.select("pattern", "bucket", (F.col("wanted") - F.col("before")).alias("wanted")), "cut-buckets")
    inside = placed.join(F.broadcast(at), ["pattern", "bucket"]).groupBy("pattern", "bucket", "place").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    found = here(before(inside, "place")).select("pattern", "bucket", "place", (F.col("wanted") - F.col("before")).alias("part"), "words")
    return {r.pattern: (r.bucket, r.place, r.part, r.words) for r in found.collect()}, n  # a row for each pattern


def mix(docs: DataFrame, sources: Column, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = 0, max_patterns: int = 50_000) -> DataFrame:
    """Choose how many words of each document a mix takes so that sources meet target shares.

    docs: doc_id, text, and whatever columns `sources` reads: an array of the sources that a document
    belongs to (a null element is a source of its own, after all others). Returns docs' columns and
    size, source_size and target (of the first source in order), taken.
    Weights go to the sources in code-point order, repeating. A document is taken at most `copies`
    times. A null or empty text has size 0 and is never taken; an empty table gives an empty result;
    rows that repeat one doc_id share one place in the order and, at the cut, its words by size.
    Clashing column names in docs (size, target, ...) are replaced.

    The patterns' table is all that the driver holds; over max_patterns different patterns are
    refused with a ValueError. Documents are neither sorted nor shuffled with their texts.
    """
    spark = docs.sparkSession
    pattern = F.coalesce(F.to_json(F.array_sort(F.array_distinct(sources))), F.lit("[null]"))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = materialize(docs.select(pattern.alias("pattern"), place.alias("place"), word_count(F.col("text")).alias("size")), "sizes")
    sums = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sums.sort(key=lambda r: r.pattern)
    groups = [json.loads(r.pattern) or [None] for r in sums]
    names = sorted({s for g in groups for s in g}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    members = [[index[s] for s in g] for g in groups]
    sizes = [0] * len(names)
    for r, m in zip(sums, members, strict=True):
        for s in m:
            sizes[s] += r.size
    targets = water_fill(sizes, [float(weights[i % len(weights)]) for i in range(len(names))], share * sum(r.size for r in sums), copies)
    flows = [sum(x) for x in route([r.size for r in sums], members, [int(t + 0.5) for t in targets], copies)]
    rest = {r.pattern: f % r.size for r, f in zip(sums, flows, strict=True) if r.size and f % r.size}
    cuts, n = _cuts(sized, rest, sum(r.n for r in sums)) if rest else ({}, 16)
    rows = [
        (r.pattern, sizes[first := min(m)], targets[first], f // r.size if r.size else 0, *cuts.get(r.pattern, (-1, None, 0, 1)))
        for r, m, f in zip(sums, members, flows, strict=True)
    ]
    made = ["size", "source_size", "target", "taken"]
    keep = [c for c in docs.columns if c.lower() not in made]
    kinds = {"pattern": "string", "total": "long", "goal": "double", "whole": "long", "bucket": "long", "spot": "long", "part": "long", "words": "long"}
    names = {c: free_name(docs, f"_{c}") for c in (*kinds, "at", "count")}
    of = {c: F.col(n) for c, n in names.items()}
    plan = F.broadcast(spark.createDataFrame(rows, ", ".join(f"{names[c]} {k}" for c, k in kinds.items())))
    at = F.pmod(of["at"], F.lit(n))
    first = (at < of["bucket"]) | (at == of["bucket"]) & (of["at"] < of["spot"])
    here = (at == of["bucket"]) & (of["at"] == of["spot"])
    share = F.expr(f"{names['part']} * {names['count']} div {names['words']}")
    more = F.when(first, of["count"]).when(here, share).otherwise(F.lit(0))
    ready = docs.select(*keep, word_count(F.col("text")).alias(names["count"]), pattern.alias(names["pattern"]), place.alias(names["at"]))
    taken = (of["whole"] * of["count"] + more).cast("long")
    out = ready.join(plan, names["pattern"])
    return out.select(*keep, of["count"].alias("size"), of["total"].alias("source_size"), of["goal"].alias("target"), taken.alias("taken"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents by their source; see mix()."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, F.array("source")).select("doc_id", "size", "source_size", "target", "taken")
