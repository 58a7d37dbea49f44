"""Conversation structure repair: signature deduplication.

A conversation's rows, in order, become one character each, which tells the row's role and fault. Conversations of equal
signatures need equal edits, so each different signature is solved once, by a memoised recursion over its rows and what the
repaired conversation has so far; the audits are joined back by signature, and their edits replayed on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, long_rows, materialize, table

#: A character of a signature for each role, in the order of ROLES, by the row's fault.
ROLES = "suao"  # system, user, assistant, other
SIGNS = {"sound": "suao", "truncated": "SUAO", "blank": "0123", "duplicate": "4567"}
TOLD = {sign: (role, fault) for fault, signs in SIGNS.items() for role, sign in zip(ROLES, signs, strict=True)}

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: What a kept role makes of the conversation so far, which is empty or ends in a system, user or assistant turn.
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
#: The same for a role of one's choice.
TURN = {"": "u", "s": "u", "a": "u", "u": "a"}
NAMES = {"u": "user", "a": "assistant"}
#: The recursion is led from the back in steps of so many rows, so that it never runs deep.
STEP = 100


class Solver:
    """The cheapest edits of one signature; of equal costs the audit that is least in ASCII."""

    def __init__(self, signature: str) -> None:
        self.rows, self.known = [TOLD[c] for c in signature], {}

    def best(self, at: int, so_far: str, inserted: bool = False) -> tuple[float, str]:
        """(cost, first edit) of the cheapest way from row `at` on. No two edits of a state share their initial, so
        of ways that cost the same the least first edit leads to the least audit."""
        key = (at, so_far, inserted)
        if key not in self.known:
            self.known[key] = min(((cost + self.best(*then)[0], edit) for edit, cost, *then in self.edits(at, so_far, inserted)), default=(float("inf"), ""))
            if at == len(self.rows) and so_far in ("", "a"):
                self.known[key] = (0, "")
        return self.known[key]

    def edits(self, at: int, so_far: str, inserted: bool) -> Iterator[tuple]:
        """(edit, cost, next row, conversation then, whether a turn was just inserted)."""
        if at < len(self.rows):
            role, fault = self.rows[at]
            yield "D", DELETE, at + 1, so_far, False
            if fault in ("sound", "truncated"):
                cut = fault == "truncated"
                if (so_far, role) in NEXT:
                    yield "K", KEEP + cut, at + 1, NEXT[so_far, role], False
                yield "R", REROLE + cut, at + 1, TURN[so_far], False
        if not inserted or at == len(self.rows) and so_far == "u":  # two turns in a row help only after a last system turn
            yield "I", INSERT, at, TURN[so_far], True

    def audit(self) -> tuple[int, str]:
        """(cost, edits in order)."""
        for at in range(len(self.rows), 0, -STEP):
            for so_far in ("", *TURN.values(), "s"):
                self.best(at, so_far)
        cost, out, state = self.best(0, "")[0], [], [0, "", False]
        while edit := self.best(*state)[1]:
            state = next(then for e, _, *then in self.edits(*state) if e == edit)
            out.append(edit)
        return int(cost), "".join(out)


def solve(signature: str) -> tuple[int, int, int, int, int, str]:
    """(blank, duplicate, truncated, illegal, cost, audit)."""
    faults = [TOLD[c][1] for c in signature]
    roles = "".join(TOLD[c][0] for c in signature)
    illegal = sum(pair not in ("su", "ua", "au") for pair in zip_pairs(roles))
    return faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, *Solver(signature).audit()


def zip_pairs(text: str) -> Iterator[str]:
    return map("".join, zip(text, text[1:], strict=False))


def _clean(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one space for a null role or text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Rows dealt out by conversation, each conversation's in order: by turn, nulls first, then role and text."""
    order = [F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _digest() -> Column:
    """Tells role and text: 32 bytes. Lengths keep ('a', 'bc') and ('ab', 'c') apart."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _signs() -> Column:
    """A row's character, duplicates apart."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    at = F.expr(f"if(substring(role, 1, 1) in ('s', 'u', 'a'), locate(substring(role, 1, 1), '{ROLES}'), {len(ROLES)})")
    sign = lambda fault: F.substring(F.lit(SIGNS[fault]), at, F.lit(1))
    return F.when(blank, sign("blank")).when(whole, sign("sound")).otherwise(sign("truncated"))


def signatures(conversations: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps): a character a row, as SIGNS has them.

    Which texts come again is found by a partial count of (conversation, digest), so only such rows are joined with where
    they came first. A conversation's characters are strung together in one task, row after row.
    """
    rows = _clean(conversations).withColumns({"digest": _digest(), "sign": _signs()})
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # nulls first
    again = rows.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(turn > F.col("first"), F.lit(False))
    ordered = _in_order(rows.select("conv_id", "turn", "role", "text", "sign", "digest", later.alias("later")))
    ordered = ordered.select("conv_id", "turn", "sign", "digest", "later")
    duplicate = {sign: SIGNS["duplicate"][ROLES.index(role)] for sign, (role, fault) in TOLD.items() if fault != "blank"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.null()
        now, signs, turns, last = None, None, None, None
        done: list[tuple] = []

        def close() -> None:
            if signs is not None:
                low, high, different = turns
                done.append((now, signs.decode(), high - low + 1 - different if different else 0))

        def batch() -> pa.RecordBatch:
            ids, own, gaps = zip(*done, strict=True) if done else ((), (), ())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(own, pa.string()), pa.array(gaps, pa.int64())], ["conv_id", "signature", "gaps"])

        for b in batches:
            kind = b.schema.field(0).type
            for conv, turn, sign, digest, later in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if signs is None or conv != now:
                    close()
                    now, signs, turns, last = conv, bytearray(), [None, None, 0], None
                same = (turn, digest) == last
                signs += duplicate.get(sign, sign).encode() if later or same else sign.encode()
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                last = (turn, digest)
            yield batch()
        close()
        if done:
            yield batch()

    return long_rows(ordered).mapInArrow(run, f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, signature string, gaps long")


SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def solved(signs: DataFrame) -> DataFrame:
    """Each different signature once, with its counts and the cheapest edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("signature", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
        for b in batches:
            rows = [(s, *solve(s)) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return signs.select("signature").distinct().mapInArrow(run, SOLVED)


def audits(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): faults and cheapest edits of every conversation.

    A fault is a row's first of: blank (no character but white space), duplicate (role and text come earlier in the
    conversation), truncated (the last such character is none of .!?). gaps are turns missing between the least and the
    greatest. illegal counts neighbours whose roles' initials are none of su, ua, au. Edits keep (K, free), rerole (R, 2),
    delete (D, 3; required for blank and duplicate rows) or insert an empty turn (I, 2), until roles are nothing or an
    optional system turn and pairs of user and assistant; truncated rows that stay cost 1 more.

    A null conv_id is a conversation; a null role or text is one space; an empty role, or one with another initial, can't be kept;
    null turns come first and are no gap; ties of turn go by role and text; repeated rows are duplicates. An empty table has
    none. A conversation's signature is one value, a byte for each of its rows.
    """
    signs = materialize(signatures(conversations), "signatures")
    return signs.join(solved(signs), "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, edit): the conversations after the edits that audits() found for them.

    Inserted turns have a null turn and an empty text. A partition holds whole conversations, one after the other, in order.
    """
    none = F.lit(None)
    rows = _clean(conversations).withColumn("audit", none.cast("string"))
    lead = found.select("conv_id", none.cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    ordered = _in_order(rows.unionByName(lead).withColumn("row", F.col("audit").isNull()), "row").select("conv_id", "turn", "role", "text", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, so_far, position = "", 0, "", 0
        for b in batches:
            out: list[tuple] = []

            def turn_in(conv, turn, role, text, edit) -> None:  # noqa: ANN001
                nonlocal position, so_far
                position, so_far = position + 1, role[:1]
                out.append((conv, position, turn, role, text, edit))  # noqa: B023

            def insert(conv) -> None:  # noqa: ANN001
                nonlocal at
                while edits[at : at + 1] == "I":
                    turn_in(conv, None, NAMES[TURN[so_far]], "", "I")
                    at += 1

            for conv, turn, role, text, audit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if audit is not None:  # leads its conversation's rows
                    edits, at, so_far, position = audit, 0, "", 0
                else:
                    edit, at = edits[at], at + 1
                    if edit != "D":
                        turn_in(conv, turn, role if edit == "K" else NAMES[TURN[so_far]], text, edit)
                insert(conv)
            columns = zip(*out, strict=True) if out else [()] * 6
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "position", "turn", "role", "text", "edit"])

    return long_rows(ordered).mapInArrow(run, f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, position long, turn long, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what repaired() gives, as it gives it: of `role:text` lines, joined by line breaks.

    A hash takes its text from first to last, so a conversation is one task's, but never more than a batch of it at once.
    """
    few = turns.select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed, kind = None, None, pa.null()
        for b in batches:
            kind, ids, found = b.schema.field(0).type, [], []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if hashed is not None and conv == now:
                    hashed.update(b"\n")
                else:
                    if hashed is not None:
                        ids.append(now)
                        found.append(hashed.hexdigest())
                    now, hashed = conv, hashlib.sha256()
                hashed.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([hashed.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return few.mapInArrow(run, f"conv_id {few.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32 of `conv_id:turn`, modulo 20, names; nulls are one space.

    0 drops a row, 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = crc_mod(F.concat(space("conv_id"), F.lit(":"), space("turn")), 20)
    rows = _clean(conversations).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    once = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    return once.unionByName(once.where("kind = 3")).drop("kind")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired."""
    rows = table(spark, sf_dir, "conversations")
    hurt = damaged(rows)
    found = materialize(audits(hurt), "audits")
    told = digests(repaired(hurt, found)).select(F.col("conv_id").alias("c"), "repaired_sha256")
    out = rows.select("conv_id").distinct()
    for more in (found.withColumnRenamed("conv_id", "c"), told):
        out = out.join(more, out["conv_id"].eqNullSafe(more["c"]), "left").drop("c")
    nothing = hashlib.sha256().hexdigest()
    return out.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill({"audit": "", "repaired_sha256": nothing})


#: edits: (state before: 0 nothing, 1 system, 2 user, 3 assistant; role or null for all; required of blank and duplicate rows; edit;
#: state after; cost). paths: the same, with an inserted turn before the row's own edit or without.
SQL = r"""
with recursive
crc as (select list(list_reduce(list_concat([i::bigint], range(8)::bigint[]), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384::bigint), c >> 1)) order by i) as t from range(256) r(i)),
named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
kinds as (
  select n.*, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 20 as kind
  from named n, crc),
hurt as (
  select conv_id, turn, if(kind = 4, 'user', role) as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from kinds, range(2) c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n from hurt),
facts as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as cut from placed),
signs as (select conv_id, turn, role, text, i, n, if(role in ('') or role[1] not in ('s', 'u', 'a'), 'o', role[1]) as r, blank, again and not blank as duplicate, cut and not blank and not again as truncated from facts),
edits(src, r, must, edit, dst, cost) as (values
  (0, null, true, 'D', 0, 3), (1, null, true, 'D', 1, 3), (2, null, true, 'D', 2, 3), (3, null, true, 'D', 3, 3),
  (0, 's', false, 'K', 1, 0), (0, 'u', false, 'K', 2, 0), (1, 'u', false, 'K', 2, 0), (3, 'u', false, 'K', 2, 0), (2, 'a', false, 'K', 3, 0),
  (0, null, false, 'R', 2, 2), (1, null, false, 'R', 2, 2), (3, null, false, 'R', 2, 2), (2, null, false, 'R', 3, 2)),
paths as (
  select * from edits union all
  select s, r, must, 'I' || edit, dst, cost + 2 from edits, (values (0, 2), (1, 2), (3, 2), (2, 3)) j(s, m) where src = m),
best as (
  select conv_id, n + 1 as i, s as state, printf('%08d', c) as cost, a as audit from (select distinct conv_id, n from signs), (values (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) e(s, c, a)
  union all
  select conv_id, i, state, least[1:8], least[9:] from (
    select b.conv_id, g.i, p.src as state, min(printf('%08d', b.cost::bigint + p.cost + if(g.truncated and right(p.edit, 1) <> 'D', 1, 0)) || p.edit || b.audit) as least
    from best b join signs g on g.conv_id is not distinct from b.conv_id and g.i = b.i - 1
    join paths p on p.dst = b.state and (p.r is null or p.r = g.r) and (p.must or not (g.blank or g.duplicate)) group by all)),
edited as (select conv_id, audit, cost::bigint as cost from best where i = 1 and state = 0),
steps as (
  select conv_id, k, audit[k] as edit, count(*) filter (audit[k] <> 'I') over (partition by conv_id order by k) as i
  from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as k from edited)),
kept as (
  select s.conv_id, s.k, s.edit, g.role, g.text, count(*) filter (not (s.edit = 'K' and g.r = 's')) over (partition by s.conv_id order by s.k) as place
  from steps s left join signs g on g.conv_id is not distinct from s.conv_id and g.i = s.i and s.edit <> 'I' where s.edit <> 'D'),
texts as (
  select conv_id, string_agg(case edit when 'K' then role else if(place % 2 = 1, 'user', 'assistant') end || ':' || if(edit = 'I', '', text), chr(10) order by k) as whole from kept group by conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (i > 1 and pair not in ('su', 'ua', 'au')) as illegal from (select *, lag(r) over (partition by conv_id order by i) || r as pair from signs) group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(e.cost, 0) as cost, coalesce(e.audit, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join edited e on e.conv_id is not distinct from o.conv_id
left join texts x on x.conv_id is not distinct from o.conv_id
"""
