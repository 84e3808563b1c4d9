"""Repairs of conversations against all edits tried in turn, and against SQL for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import conversations
from tests.oracle import connect, same

TURNS = "conv_id long, turn long, role string, text string"
COLS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GOOD = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.encode().split()
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1][-1:] in (b".", b"!", b"?") else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) of the best of all edits, two insertions at most in each gap."""
    bad = faults(rows)
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(("K", "D", "user", "assistant"), repeat=len(rows)):
            cost, audit, out = 3 * sum(map(len, gaps)), "I" * len(gaps[0]), [(g, "") for g in gaps[0]]
            for (role, text), fault, edit, gap in zip(rows, bad, edits, gaps[1:]):
                if edit == "D":
                    cost += 4
                elif fault in ("blank", "duplicate"):
                    break
                else:
                    cost += (0 if edit == "K" else 3) + (3 if fault else 0)
                    out.append((role if edit == "K" else edit, text))
                audit += (edit if edit in "KD" else "R") + "I" * len(gap)
                out += [(g, "") for g in gap]
            else:
                if GOOD.match("".join(role[:1] or "-" for role, _ in out)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, out)
    return best


def model(rows):
    """The contract's numbers for one conversation's (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    kinds = faults([r[1:] for r in rows])
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest([r[1:] for r in rows])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def random_rows(rng, most):
    roles, texts = ("user", "assistant", "system", "tool", "user", "assistant", " ", ""), ("Yes.", "No, not yet", "", " \t", "Why?", "So it goes! \n", "a. ", "Yes.")
    return [(rng.choice((None, *range(7))), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, most))]


def test_every_edit_tried(spark):
    rng = random.Random(7)
    convs = {i: random_rows(rng, 3) for i in range(40)}
    df = spark.createDataFrame([(i, *r) for i, rows in convs.items() for r in rows], TURNS).repartition(3)
    found, _ = conversations.repair_conversations(df)
    got = {int(r.conv): tuple(r[c] for c in COLS) for r in found.collect()}
    assert got == {i: model(rows) for i, rows in convs.items()}


def test_query_like_its_sql(spark, sf_dir):
    same(conversations.op12_conversations(spark, sf_dir), connect(sf_dir), conversations.SQL)


def hostile():
    rng = random.Random(11)
    rows = [(i, *r) for i in range(30) for r in random_rows(rng, 9)]
    rows += [(100, t, rng.choice(("user", "assistant", "system")), rng.choice(("One.", "Two", f"Own {t}.", ""))) for t in range(300)]
    rows += [(None, t, r, x) for t, r, x in random_rows(rng, 6)] + [(200, None, None, None), (200, 3, None, "x."), (201, 1, "user", None), (300, 5, "user", "a.\r\n"), (300, 5, "user", "a.\r\n")]
    dropped = [c for c in range(1000, 1200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    return rows + [(c, 0, "user", "Gone.") for c in dropped], dropped


@pytest.mark.parametrize("turns,blocks", [(128, 64), (4, 2), (1, 3)])
def test_blocks_like_sql(spark, tmp_path, monkeypatch, turns, blocks):
    """Long conversations, nulls, ties, repeats, odd roles: the fold by blocks equals one fold over all turns."""
    monkeypatch.setattr(conversations, "TURNS", turns)
    monkeypatch.setattr(conversations, "BLOCKS", blocks)
    rows, dropped = hostile()
    spark.createDataFrame(rows, TURNS).repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    con = connect(str(tmp_path / "none"))
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = [tuple(r) for r in conversations.op12_conversations(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.sql(conversations.SQL).fetchall(), key=str)
    gone = conversations.op12_conversations(spark, str(tmp_path)).filter(F.col("conv_id").isin(dropped)).collect()
    assert len(gone) == 3 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for r in gone)


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c? d") for c in range(40) for t in range(5)] + [(None, 1, None, None), (1, None, "user", "x")]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            want += [row] * (2 if k == 3 else 1)
    got = [tuple(r) for r in conversations.damaged(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) != len(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    found, lines = conversations.repair_conversations(empty)
    assert found.count() == 0 and lines.count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "Hm."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "x" * 200000)], TURNS)
    odd = odd.withColumns({c: F.lit(c) for c in ("conv", "pos", "size", "part", "row_nr", "block", "kind", "fault", "m", "cost", "audit", "line", "initial")})
    found, lines = conversations.repair_conversations(odd)
    assert sorted((r.conv, r.cost, r.audit) for r in found.collect()) == [("1", 0, "KK"), ("2", 4, "D")]
    assert [r.line for r in lines.filter("conv = '1' AND line IS NOT NULL").orderBy("pos").collect()] == ["user:Hm.", "assistant:Yes."]
