from __future__ import annotations

import hashlib
import re
import zlib
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from payloom.llm import conversations as c

ROWS = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """Cost, audit and repaired text by trying every edit script. rows: role and text in order."""
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                found = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
                best = found if best is None or found[:2] < best[:2] else best
        else:
            role, text = rows[i]
            bare = text.strip(" \t\n\v\f\r")
            go(i + 1, cost + 2, audit + "D", out)
            if bare and rows[i] not in rows[:i]:
                more = 0 if bare[-1] in ".!?" else 5
                go(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", [*out, (new, text)])
        if audit[-3:] != "III":
            for new in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (new, "")])

    # the cheapest first: everything deleted
    best = (2 * len(rows), "D" * len(rows), "")
    go(0, 0, "", [])
    return best


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        blow = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if blow == 1 else re.sub("[.!?]", "", text) if blow == 2 else text
        out += [(conv, turn, "user" if blow == 4 else role, text)] * {0: 0, 3: 2}.get(blow, 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def report(rows):
    """As the operator's, from all rows of the table."""
    every = damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, r, x) for k, t, r, x in every if k == conv]
        turns = {t for t, _, _ in mine if t is not None}
        faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        for i, (_, r, x) in enumerate(mine):
            bare = x.strip(" \t\n\v\f\r")
            if not bare:
                faults["blank"] += 1
            elif (r, x) in [m[1:] for m in mine[:i]]:
                faults["duplicate"] += 1
            elif bare[-1] not in ".!?":
                faults["truncated"] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, text = cheapest([m[1:] for m in mine])
        out[conv] = {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **faults, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
    return out


def told(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


ODD = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes!"), (1, 4, "user", "And?"),
    (2, 0, "system", "Be kind."), (2, 1, "assistant", "So"), (2, 2, "user", " \t"), (2, 3, "user", "Ends here. \n"), (2, 3, "user", "Ends here. \n"),
    (3, None, None, None), (3, None, "tool", "ran."), (3, 2, "", "Nothing."), (3, 2, "assistant", "é。"),
    (None, None, "user", "No name."), (None, 7, "assistant", "None."),
    (4, 0, "assistant", "First."), (4, 1, "system", "Late."), (4, 2, "user", "One"), (4, 3, "user", "Two."), (4, 4, "user", "Two."),
    (5, 5, "user", " "),
]


@pytest.mark.parametrize("partitions", [None, 7])
def test_odd_rows_as_by_trying_all_edits(spark, partitions):
    df = spark.createDataFrame(ODD, ROWS).withColumns({"blank": F.lit("x"), "part": F.lit(9), "n": F.lit("y"), "edit": F.lit(0)})
    assert told(c.repaired_report(df, partitions)) == report(ODD)


def test_every_short_conversation_as_by_trying_all_edits(spark):
    kinds = [("system", "A."), ("user", "B."), ("assistant", "C."), ("user", "cut"), ("tool", "D.")]
    rows = [(k, t, role, f"{t} {text}") for k, picked in enumerate(product(kinds, repeat=4)) for t, (role, text) in enumerate(picked)]
    assert told(c.repaired_report(spark.createDataFrame(rows, ROWS))) == report(rows)


def test_a_conversation_over_many_partitions_as_in_one_and_as_sql(spark):
    words = ["user", "assistant", "system", "user", "assistant", "tool"]
    rows = [(9, t // 2 if t < 300 else t, words[(t * 7 + t // 5) % 6], ["Yes.", "no", "", "Well then!"][(t * t) % 4] + str(t % 90) + ".") for t in range(1500)] + [(k, 0, "user", "Hi.") for k in range(8)]
    df = spark.createDataFrame(rows, ROWS)
    split, rest = c.repair(c.damaged(df), 11)
    parts = split.where("conv_id = 9").collect()
    assert len({r["part"] for r in rest.where("conv_id = 9").select("part").distinct().collect()}) > 4 and len(parts) == 1
    want = told(c.repaired_report(df, 1))
    assert told(c.repaired_report(df, 11)) == want
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    got = con.sql(c.ORACLE_SQL["op11_conversation_repair"]).fetchall()
    assert {r[0]: list(r[1:]) for r in got} == {k: list(v.values()) for k, v in want.items()}


def test_edits_are_rows(spark):
    rows = [(1, 1, "user", "A."), (1, 2, "user", "B."), (1, 2, "user", "B."), (1, 9, "assistant", "C.")]
    plain = spark.createDataFrame(rows, ROWS).withColumn("n", F.lit(1).cast("long"))
    _, out = c.repair(plain)
    assert [(r["edit"], r["n"], r["role"], r["text"]) for r in out.orderBy("part", "at").collect()] == [("D", 1, "user", "A."), ("K", 1, "user", "B."), ("D", 1, "user", "B."), ("K", 1, "assistant", "C.")]


def test_long_audits_keep_their_common_beginning_aside():
    track, plain = c.Track(c.START), c.closed([(0, ""), None, None, None])
    for t in range(3000):
        initial, cut = "uasua"[t * t % 5], t % 7 == 0
        track.add(1, initial, False, False, cut)
        plain = c.stepped(plain, initial, cut)
    assert sum(map(len, track.common)) > 2000
    assert track.ways(0) == [{"entry": 0, "exit": s, "cost": w[0], "audit": w[1]} for s, w in enumerate(plain) if w]


def test_no_rows(spark):
    assert c.repaired_report(spark.createDataFrame([], ROWS)).collect() == []
