import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import MEDIUM
from tallyloom.llm import conversation_repair as repair

KIND = "conv_id long, turn long, role string, text string, audit string, sign int, c string, d int, edit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], KIND)


def every_way(signature):
    """The cheapest of all ways to edit, by trying them all: (cost, audit)."""
    best = None
    gaps = ["", "I", "II"]
    for edits in itertools.product(*("D" if repair.TOLD[c][1] in ("blank", "duplicate") else "DKR" for c in signature)):
        for inserts in itertools.product(gaps, repeat=len(signature) + 1):
            audit = inserts[0] + "".join(e + i for e, i in zip(edits, inserts[1:], strict=True))
            cost = 2 * audit.count("I") + 2 * audit.count("R") + 3 * audit.count("D")
            cost += sum(e != "D" and repair.TOLD[c][1] == "truncated" for e, c in zip(edits, signature, strict=True))
            if best and (cost, audit) >= best:
                continue
            row, shapes = 0, [""]
            for e in audit:  # a role of one's choice may be either
                if e == "K":
                    shapes = [s + repair.TOLD[signature[row]][0] for s in shapes]
                elif e in "RI":
                    shapes = [s + x for s in shapes for x in "ua"]
                row += e != "I"
            if any(re.fullmatch("(s?(ua)+)?", s) for s in shapes):
                best = (cost, audit)
    return best


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="".join(repair.SIGNS.values()), max_size=4))
def test_cheapest_of_all_ways(signature):
    assert repair.solve(signature)[4:] == every_way(signature)


def test_long_signature_needs_no_deep_recursion():
    cost, audit = repair.solve("u" * 30_000)[4:]
    assert cost == 30_000 and audit == "KR" * 15_000
    assert repair.solve("ua" * 5_000)[3:] == (0, 0, "K" * 10_000)


def plain(rows):
    """The contract, one conversation after the other."""
    named = lambda x: " " if x is None else str(x)
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, named(role), named(text)))
    for conv, own in by.items():
        hurt = []
        for turn, role, text in own:
            kind = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            hurt += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, signs = set(), ""
        for _, role, text in hurt:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "sound" if solid[-1] in ".!?" else "truncated"
            signs += repair.SIGNS[fault]["sua".find(role[0]) if role and role[0] in "sua" else 3]
            seen.add((role, text))
        turns = [t for t, _, _ in hurt if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        solved = repair.solve(signs)
        left, lines = list(hurt), []
        for e in solved[5]:
            was = None if e == "I" else left.pop(0)
            if e != "D":
                turn = "assistant" if lines and lines[-1].startswith("u") else "user"
                lines.append(f"{was[1] if e == 'K' else turn}:{was[2] if was else ''}")
        out[conv] = (gaps, *solved, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def queried(spark, monkeypatch, df):
    monkeypatch.setattr(repair, "table", lambda *_: df)
    rows = repair.op12_conversation_repair(spark, "").collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_sql(spark):
    assert oracle.compare(repair.op12_conversation_repair(spark, MEDIUM), oracle.connect(MEDIUM), repair.SQL) is None


AWKWARD = [
    *((1, t, r, x) for t in (None, 0, 1, 1, 2, 9) for r, x in (("user", "Hi."), ("assistant", "Well!\n "), ("", "No role"), (None, None), ("système", "é😀?"))),
    *((None, t, "user", f"Question {t}?") for t in (None, 5, 6, None)), *[(2, 0, "user", "Same.")] * 5, (3, None, None, None),
    *((4, t, "assistant" if t % 3 else "user", f"Turn {t % 40}{'.' if t % 5 else ''}") for t in range(600)), (5, 1, "tool", " \n\t"), (5, 2, "system", "S."), (6, -3, "system", "word " * 60_000 + "."),
    *((c, 0, "user", "one") for c in range(100, 160)),
]


def test_awkward_rows(spark, monkeypatch):
    assert queried(spark, monkeypatch, frame(spark, AWKWARD).repartition(7)) == plain(AWKWARD)
    assert queried(spark, monkeypatch, frame(spark, [])) == {}
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert queried(spark, monkeypatch, frame(spark, [(c, 0, "user", "Hi.") for c in gone])) == dict.fromkeys(gone, empty)


def test_repaired_rows_keep_texts(spark):
    df = frame(spark, [(1, 0, "assistant", "A."), (1, 1, "user", "Q?"), (1, 2, "user", "R?"), (2, 0, "user", " ")])
    found = repair.audits(df)
    by = {r.conv_id: r for r in found.collect()}
    assert (by[1].audit, by[1].cost) == ("IKKR", 4) and by[2].audit == "D"
    rows = sorted(map(tuple, repair.repaired(df, found).collect()))
    want = [(None, "user", "", "I"), (0, "assistant", "A.", "K"), (1, "user", "Q?", "K"), (2, "assistant", "R?", "R")]
    assert rows == [(1, i + 1, *r) for i, r in enumerate(want)]


@pytest.mark.parametrize("role", ["user", "System"])
def test_repeats_in_one_turn_are_duplicates(spark, role):
    df = frame(spark, [(1, 0, role, "Hi.")] * 3 + [(1, 1, role, "Hi.")])
    assert repair.audits(df).first().duplicate == 3
