"""Benchmark decontamination: pigeonhole edit matching.

An item of n characters may occur in a document with up to k = n // chars_per_edit edits. It is
split into k + 1 pieces; k edits leave at least one piece untouched, so every occurrence holds an
exact piece. One Aho-Corasick automaton finds all pieces of all items in one pass over a text, and
Myers' bit-parallel distance verifies the stretch of text around each hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import long_rows, materialize, table

_PLAIN = bytes(32 if b < 48 or 58 <= b < 97 or 123 <= b < 128 else b for b in range(256))


def normalize(text: bytes | None) -> str:
    """Lower-case letters, turn every run of other ASCII characters than letters and digits into one space.

    One character a UTF-8 byte; bytes outside ASCII stay as they are once lower-cased.
    """
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_PLAIN).split()).decode("latin-1") if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 stretches of nearly equal length that make up the item, with their places."""
    cut = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Pattern:
    """Bit masks of one item for Myers' algorithm."""

    def __init__(self, item: str):
        self.n, self.mask = len(item), {}
        for i, c in enumerate(item):
            self.mask[c] = self.mask.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        """The least number of edits that turn the item into some stretch of text (the empty one included)."""
        full, high, get = (1 << self.n) - 1, 1 << (self.n - 1), self.mask.get
        up, down, score = full, 0, self.n
        best = score
        for c in text:
            same = get(c, 0)
            diagonal = (((same & up) + up) ^ up) | same | down
            plus, minus = down | (full & ~(diagonal | up)), up & diagonal
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
                if score < best:
                    best = score
            plus, minus = plus << 1 & full, minus << 1 & full
            level = same | down
            up, down = minus | (full & ~(level | plus)), plus & level
        return best


class Matcher:
    """All items of one block, ready to be looked for in normalized texts."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items = [(i, Pattern(t), len(t) // chars_per_edit) for i, t in items if t]
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for x, t in enumerate(t for _, t in items if t):
            for begin, piece in pieces(t, self.items[x][2]):
                at.setdefault(piece, []).append((x, begin + len(piece)))
        for piece, places in at.items():
            self.automaton.add_word(piece, places)
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item, least edits) for each item that occurs within its budget."""
        if not self.items or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, places in self.automaton.iter(text):
            for x, offset in places:
                _, p, k = self.items[x]
                begin = end + 1 - offset
                a, b, own = max(0, begin - k), begin + p.n + k, spans.setdefault(x, [])
                if own and a <= own[-1][1] and own[-1][0] <= a:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        found = []
        for x, own in spans.items():
            item, p, k = self.items[x]
            least = min(p.distance(text[a:b]) for a, b in own)
            if least <= k:
                found.append((item, least))
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = 16, block_chars: int = 4_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item that occurs in it.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Texts are compared as
    normalize() gives them, whole. Returns doc_id, item_id, n_edits (int): one row for each document
    row and item row. Null, empty or purely punctuation texts match nothing, on either side; items
    shorter than chars_per_edit must occur exactly, be it inside a word. Null ids are carried through. An
    empty benchmark gives no pairs.

    Only items are sent to the tasks, in blocks of about block_chars characters each, by hash of
    their text and id; every block is held against all rows, so a benchmark of any size is looked for.
    """
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    dealt = benchmark.select("item_id", F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("text", "item_id"), F.lit(n)).alias("block"))
    few = long_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    of = {"doc_id": few.schema["doc_id"].dataType.simpleString(), "item_id": dealt.schema["item_id"].dataType.simpleString()}

    def against(items: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(x, normalize(t)) for x, (_, t) in enumerate(items)], chars_per_edit)
            for b in batches:
                rows = [(d, x, e) for d, t in enumerate(b.column(1)) for x, e in matcher.find(normalize(t.as_py()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], "int32")), pa.array([items[r[1]][0] for r in rows], ids), pa.array([r[2] for r in rows], "int32")], ["doc_id", "item_id", "n_edits"])

        ids = to_arrow_type(dealt.schema["item_id"].dataType)
        return few.mapInArrow(run, f"doc_id {of['doc_id']}, item_id {of['item_id']}, n_edits int")

    blocks = ([(r.item_id, r.text and bytes(r.text)) for r in dealt.where(F.col("block") == b).collect()] for b in range(n))
    return reduce(DataFrame.unionByName, map(against, blocks))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay, rows with a null doc_id too.

    The ids are written first, so that the planner knows how few they are and needs not shuffle texts.
    """
    out = materialize(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "contaminated")
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold; see contaminated()."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
