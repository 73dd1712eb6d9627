"""Repair of conversation structure: the cheapest edits after which roles read `(s?(ua)+)?`, by a forward Viterbi pass.

A conversation's rows are taken by turn (nulls first), then role, then text. Every row is kept (0), given the role user or
assistant (1) or deleted (2); user and assistant rows with empty text are inserted (5). Blank rows, and rows whose role and
text were seen before in the conversation, must go; a truncated row that stays costs 5 more. The states are those of the
grammar: nothing yet, a system row, an open user row, an answered one. Each carries its least (cost, audit); after every row
the layer is closed by at most two inserts.

Conversations are not gathered: rows are dealt by ranges of (conversation, turn, role, text) and sorted, so that one of any
length lies in several partitions. Each partition sums up its part of a conversation as the cheapest edits between any two
states, which are put together in order; a second pass over the same rows then carries the edits out. A task holds what its
partition has of one conversation. Only the digest of a repaired conversation is read by one task, row by row.

Defined cases: a null role or text is one space, so such a text is blank and such a role fits no state; rows with a null
conv_id are one conversation; null turns come first and do not count as gaps; equal rows of one turn are neighbours, the
first of which is the original; a conversation without rows has no edits and an empty repair; an empty table gives an empty
result; columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table

START, SYSTEM, OPEN, DONE = range(4)
#: Costs of edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Where a row leads: by its initial if it is kept, by its new role otherwise.
KEPT = {"s": {START: SYSTEM}, "u": {START: OPEN, SYSTEM: OPEN, DONE: OPEN}, "a": {OPEN: DONE}}
NEXT = {START: OPEN, SYSTEM: OPEN, DONE: OPEN, OPEN: DONE}
ROLE = {OPEN: "user", DONE: "assistant"}
LEGAL = ("su", "ua", "au")
#: Characters of roles and texts that decide where a partition begins, characters of audits that are compared again and again.
EDGE, AUDIT = 64, 512
#: Rows that a task hands over at once.
ROWS = 2000

SEGMENT = (
    "conv_id long, part int, n_turns long, min_turn long, max_turn long, blank long, duplicate long, truncated long, illegal long, "
    "first_role string, last_role string, ways array<struct<entry:int,exit:int,cost:long,audit:string>>"
)
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<part:int,entry:int,exit:int>>"
REPAIRED = "conv_id long, part int, at long, edit string, n long, turn long, role string, text string"
_SPACE = r"\x20\x09-\x0D"

Best = list[tuple[int, str] | None]


# The Viterbi pass.


def closed(best: Best) -> Best:
    """A layer with the inserts that may follow; two lead from everywhere to everywhere that inserts lead to."""
    for _ in range(2):
        found = list(best)
        for state, way in enumerate(best):
            if way:
                _offer(found, NEXT[state], way[0] + INSERT, way[1] + "I")
        best = found
    return best


def _offer(best: Best, state: int, cost: int, audit: str) -> None:
    if best[state] is None or (cost, audit) < best[state]:
        best[state] = cost, audit


def stepped(best: Best, initial: str, truncated: bool) -> Best:
    """The next layer, after a row that may stay."""
    found: Best = [None] * 4
    more = TRUNCATED if truncated else 0
    for state, way in enumerate(best):
        if way is None:
            continue
        cost, audit = way
        _offer(found, state, cost + DELETE, audit + "D")
        _offer(found, NEXT[state], cost + REROLE + more, audit + "R")
        to = KEPT.get(initial, {}).get(state)
        if to is not None:
            _offer(found, to, cost + KEEP + more, audit + "K")
    return _pruned(closed(found))


def removed(best: Best, n: int) -> Best:
    """The layer after n rows that must go; inserts come behind them, since D is before I."""
    return _pruned(closed([way and (way[0] + n * DELETE, way[1] + "D" * n) for way in best]))


def _pruned(best: Best) -> Best:
    """Without states that cannot win: from an answered user all goes on as from the start or a system row, but for a system row to delete."""
    done = best[DONE]
    if done:
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if best[state] and done[0] + more < best[state][0]:
                best[state] = None
    return best


class Track:
    """The layers of a stretch of rows from one state on; what all ways have in common is put aside, so that audits stay short."""

    def __init__(self, entry: int):
        best: Best = [None] * 4
        best[entry] = 0, ""
        self.best, self.common, self.most = closed(best), [], AUDIT

    def add(self, n: int, initial: str, blank: bool, again: bool, truncated: bool) -> None:
        if blank or again:
            self.best = removed(self.best, n)
        else:
            self.best = stepped(self.best, initial, truncated)
            if n > 1:
                self.best = removed(self.best, n - 1)
        if max(len(way[1]) for way in self.best if way) > self.most:
            shared = len(os.path.commonprefix([way[1] for way in self.best if way]))
            self.common.append(next(way[1] for way in self.best if way)[:shared])
            self.best = [way and (way[0], way[1][shared:]) for way in self.best]
            self.most = AUDIT + 2 * max(len(way[1]) for way in self.best if way)

    def ways(self, entry: int) -> list[dict]:
        common = "".join(self.common)
        return [{"entry": entry, "exit": state, "cost": way[0], "audit": common + way[1]} for state, way in enumerate(self.best) if way]


def ending(best: dict) -> int:
    """The state in which a conversation ends: nothing, or an answered user."""
    return min((s for s in (START, DONE) if s in best), key=lambda s: best[s][:2])


# Rows.


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n (how many such rows there are), after the damage that crc32 of `conv_id:turn` deals."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    marked = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("blow"))
    text = F.when(F.col("blow") == 1, "").when(F.col("blow") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("blow") == 4, "user").otherwise(F.col("role"))
    n = F.when(F.col("blow") == 3, 2).otherwise(1)
    return marked.where("blow <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), n.cast("long").alias("n"))


def ordered(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """rows (with n, how often each counts) in order, by partitions of one range each, with their faults: blank, again, truncated."""
    once = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")))
    who = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text"), 256)
    once = once.withColumn("who", who)
    seen = cut(once.groupBy("who").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"))
    told = once.join(bounded(seen), "who", "left").withColumns({
        "blank": ~F.col("text").rlike(f"[^{_SPACE}]"),
        "again": F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")),
        "truncated": ~F.col("text").rlike(rf"[.!?][{_SPACE}]*+\z"),
    })
    # short keys, since Spark gathers a sample of them; they sort as the whole ones do
    edge = F.when(F.length("role") <= EDGE, F.substring("text", 1, EDGE))
    keys = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, EDGE), edge]
    dealt = told.repartitionByRange(partitions, *keys) if partitions else told.repartitionByRange(*keys)
    return cut(dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text", "n", "blank", "again", "truncated", F.spark_partition_id().alias("part")))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for values in zip(*columns, strict=True):
            yield dict(zip(b.schema.names, values, strict=True))


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r.get("text") or "") + len(r.get("audit") or "")
        if len(some) >= ROWS or size > 1 << 24:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def segments(rows: DataFrame) -> DataFrame:
    """What each partition has of each conversation: counts, and the cheapest edits from each state it may begin in to each it may end in."""
    schema = _arrow(SEGMENT)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for k, ((conv, part), group) in enumerate(groupby(_rows(batches), key=lambda r: (r["conv_id"], r["part"]))):
                # only the first conversation of a partition may have begun before
                yield {"conv_id": conv, "part": part} | _segment(group, (START, SYSTEM, OPEN, DONE) if k == 0 else (START,))

        return _batches(each(), schema)

    light = rows.select("conv_id", "part", "turn", F.substring("role", 1, 1).alias("initial"), "n", "blank", "again", "truncated")
    return light.mapInArrow(summed, SEGMENT)


def _segment(rows: Iterable[dict], entries: tuple[int, ...]) -> dict:
    tracks = {e: Track(e) for e in entries}
    out = dict.fromkeys(("n_turns", "blank", "duplicate", "truncated", "illegal"), 0) | dict.fromkeys(("min_turn", "max_turn", "first_role", "last_role"))
    for r in rows:
        n, turn, initial = r["n"], r["turn"], r["initial"]
        if turn is not None and turn != out["max_turn"]:
            out["n_turns"] += 1
            out["max_turn"] = turn
            out["min_turn"] = turn if out["min_turn"] is None else out["min_turn"]
        if r["blank"]:
            out["blank"] += n
        elif r["again"]:
            out["duplicate"] += n
        else:
            out["truncated"] += r["truncated"]
            out["duplicate"] += n - 1
        out["illegal"] += n - 1 + (out["last_role"] is not None and out["last_role"] + initial not in LEGAL)
        out["first_role"] = initial if out["first_role"] is None else out["first_role"]
        out["last_role"] = initial
        for t in tracks.values():
            t.add(n, initial, r["blank"], r["again"], r["truncated"])
    return out | {"ways": [w for e, t in tracks.items() for w in t.ways(e)]}


def reports(found: DataFrame) -> DataFrame:
    """One row for each conversation: its counts, cost and audit, and, where it lies in several partitions, the states at their edges."""
    schema = _arrow(REPORT)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((_report(conv, group) for conv, group in groupby(_rows(batches), key=lambda r: r["conv_id"])), schema)

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(put_together, REPORT)


def _report(conv: int | None, rows: Iterable[dict]) -> dict:
    best: dict[int, tuple] = {START: (0, [], ())}  # cost, audits of the parts, states at the edges
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    turns, least, most, last = 0, None, None, None
    for r in rows:
        for k in total:
            total[k] += r[k]
        total["illegal"] += last is not None and last + r["first_role"] not in LEGAL
        last = r["last_role"]
        if r["n_turns"]:
            turns += r["n_turns"] - (most == r["min_turn"])
            least, most = r["min_turn"] if least is None else least, r["max_turn"]
        after: dict[int, tuple] = {}
        for w in r["ways"]:
            if w["entry"] in best:
                cost, audits, parts = best[w["entry"]]
                way = cost + w["cost"], [*audits, w["audit"]], (*parts, (r["part"], w["entry"], w["exit"]))
                if w["exit"] not in after or _less(way, after[w["exit"]]):
                    after[w["exit"]] = way
        best = after
    cost, audits, parts = best[ending({s: (w[0], "".join(w[1])) for s, w in best.items() if s in (START, DONE)})]
    gaps = 0 if least is None else most - least + 1 - turns
    return {"conv_id": conv, "gaps": gaps, **total, "cost": cost, "audit": "".join(audits), "parts": [dict(zip(("part", "entry", "exit"), p, strict=True)) for p in parts] if len(parts) > 1 else []}


def _less(way: tuple, other: tuple) -> bool:
    return (way[0], "".join(way[1])) < (other[0], "".join(other[1]))


def repair(rows: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The report of every conversation that has rows, and all rows after the edits.

    Of the second table, conv_id, part and at give the order; edit is K, R, D or I; n is 1 but for deleted rows, which
    stand for n alike. Without those of edit D it is the repaired conversations.
    """
    placed = ordered(rows, partitions)
    told = cut(reports(segments(placed)))
    # two conversations at most reach over an edge of a partition, so these are few
    edges = {(r["part"], r["conv_id"]): (r["entry"], r["exit"]) for r in told.select("conv_id", F.explode("parts").alias("p")).select("conv_id", "p.*").collect()}
    schema = _arrow(REPAIRED)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for (conv, part), group in groupby(_rows(batches), key=lambda r: (r["conv_id"], r["part"])):
                entry, leave = edges.get((part, conv), (START, None))
                for at, r in enumerate(_edits(list(group), entry, leave)):
                    yield {"conv_id": conv, "part": part, "at": at} | r

        return _batches(each(), schema)

    return told.drop("parts"), placed.mapInArrow(edited, REPAIRED)


def _edits(rows: list[dict], entry: int, leave: int | None) -> Iterator[dict]:
    """The rows of a conversation in one partition after the cheapest edits from one state to the other."""
    track = Track(entry)
    for r in rows:
        track.add(r["n"], r["role"][:1], r["blank"], r["again"], r["truncated"])
    ways = {w["exit"]: (w["cost"], w["audit"]) for w in track.ways(entry)}
    audit = iter(ways[ending(ways) if leave is None else leave][1])
    state, edit = entry, next(audit, None)

    def inserts() -> Iterator[dict]:
        nonlocal state, edit
        while edit == "I":
            state, edit = NEXT[state], next(audit, None)
            yield {"edit": "I", "n": 1, "turn": None, "role": ROLE[state], "text": ""}

    for r in rows:
        here = {"turn": r["turn"], "role": r["role"], "text": r["text"]}
        yield from inserts()
        alike = r["n"]
        if not (r["blank"] or r["again"]):  # the first of n alike is decided upon, the others go
            if edit == "D":
                yield {"edit": "D", "n": 1, **here}
            else:
                state = KEPT[r["role"][0]][state] if edit == "K" else NEXT[state]
                yield {"edit": edit, "n": 1, **here} | ({"role": ROLE[state]} if edit == "R" else {})
            edit, alike = next(audit, None), alike - 1
            if alike:
                yield from inserts()
        if alike:
            for _ in range(alike):
                edit = next(audit, None)
            yield {"edit": "D", "n": alike, **here}
    yield from inserts()


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of `role:text` of the rows that are left, joined by newlines; a task reads row by row."""
    lines = repaired.where("edit <> 'D'").select("conv_id", "part", "at", F.concat("role", F.lit(":"), "text").alias("text"))
    schema = _arrow("conv_id long, repaired_sha256 string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for conv, group in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                found = hashlib.sha256()
                for k, r in enumerate(group):
                    found.update(("\n" if k else "").encode() + r["text"].encode())
                yield {"conv_id": conv, "repaired_sha256": found.hexdigest()}

        return _batches(each(), schema)

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "text").mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def repaired_report(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for every conv_id of the table as it was before the damage."""
    told, rows = repair(damaged(conversations), partitions)
    every = conversations.select(F.col("conv_id").cast("long"))
    found = every.unionByName(told, allowMissingColumns=True).unionByName(digests(rows), allowMissingColumns=True)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    one = found.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"))
    return one.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_report(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLE_SQL = {
    "op11_conversation_repair": r"""with recursive crc as (
  select range::ubigint as b, list_reduce([range::ubigint] || range(8)::ubigint[], lambda c, _: if(c & 1 = 1, xor(c >> 1, 3988292384::ubigint), c >> 1)) as t from range(256)),
crcs as (select list(t order by b) as t from crc),
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
keys as (select k, xor(list_reduce([4294967295::ubigint] || list_transform(string_split(k, ''), lambda c: ascii(c)::ubigint), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255)::bigint + 1])), 4294967295::ubigint) % 20 as blow from (select distinct k from named), crcs),
hit as materialized (
  select conv_id, turn, if(blow = 4, 'user', role) as role, case blow when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(if(blow = 3, 2, 1))) as copy
  from named join keys using (k) where blow <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen, left(role, 1) as initial,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as cut from hit),
r as materialized (select *, dense_rank() over (order by conv_id nulls first) as c, blank or seen > 1 as gone, lag(initial) over (partition by conv_id order by i) as before from placed),
moves(edit, initial, a, b, cost) as (values ('D', '', 0, 0, 2), ('D', '', 1, 1, 2), ('D', '', 2, 2, 2), ('D', '', 3, 3, 2), ('R', '', 0, 2, 1), ('R', '', 1, 2, 1), ('R', '', 3, 2, 1), ('R', '', 2, 3, 1), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0)),
inserts(a, b, n) as (values (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2)),
layer as (
  select c, 0::bigint as i, s.b as state, {'cost': 5 * s.n, 'audit': repeat('I', s.n)} as best from (select distinct c from r), inserts s where s.a = 0
  union all
  select l.c, l.i + 1, s.b, min({'cost': l.best.cost + m.cost + if(r.cut and m.edit <> 'D', 5, 0) + 5 * s.n, 'audit': l.best.audit || m.edit || repeat('I', s.n)})
  from layer l join r on r.c = l.c and r.i = l.i + 1 join moves m on m.a = l.state and m.initial in ('', r.initial) and (m.edit = 'D' or not r.gone) join inserts s on s.a = m.b
  group by l.c, l.i, s.b),
ends as (select c, min(best) as best from layer where (c, i) in (select (c, max(i)) from r group by c) and state in (0, 3) group by c),
letters as (select c, unnest(string_split(best.audit, '')) as edit, generate_subscripts(string_split(best.audit, ''), 1) as pos from ends),
edits as (select *, count(*) filter (edit <> 'I') over (partition by c order by pos) as i, count(*) filter (edit <> 'D') over (partition by c order by pos) as o from letters),
lines as (
  select e.c, e.pos, e.edit, e.o, r.role, r.text, max(if(e.o = 1 and e.edit = 'K' and r.initial = 's', 1, 0)) over (partition by e.c) as system from edits e left join r on r.c = e.c and r.i = e.i where e.edit <> 'D'),
repaired as (
  select c, sha256(string_agg(if(edit = 'K', role, if((o - system) % 2 = 1, 'user', 'assistant')) || ':' || if(edit = 'I', '', text), chr(10) order by pos)) as h from lines group by c),
counts as (
  select c, any_value(conv_id) as conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (not blank and seen > 1) as duplicate,
    count(*) filter (not gone and cut) as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from r group by c)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts n on n.conv_id is not distinct from o.conv_id left join ends e on e.c = n.c left join repaired p on p.c = n.c"""
}
