"""Repair of the structure of conversations by a higher-order fold (operator 12)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, forget, positions, written

#: Turns of a block that are folded at once, and blocks that are put together at once.
TURNS, BLOCKS = 128, 64
#: What edits cost.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
NEVER = 1 << 40  # the cost of what can't be
SAID, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: What the roles so far are: none, a system's alone, with a user's last, with an assistant's last.
STATES = "osua"
STATE = "struct<o:struct<cost:bigint,audit:string>,s:struct<cost:bigint,audit:string>,u:struct<cost:bigint,audit:string>,a:struct<cost:bigint,audit:string>>"


def _after(x: Column, cost: Column | int, letters: str) -> Column:
    return F.struct(F.least(x["cost"] + cost, F.lit(NEVER)).alias("cost"), F.concat(x["audit"], F.lit(letters)).alias("audit"))


def _turn(st: Column, turn: Column) -> Column:
    """The four states after a turn is kept, given another role, or deleted: of each the least (cost, audit).

    Two ways to a state that cost the same never have audits of which one begins with the other: the
    letters of turns would be the same, and more insertions would cost more.  So the least one stays the
    least whatever comes after."""
    stays = F.when(turn["fault"] == 2, NEVER).otherwise(F.when(turn["fault"] == 1, UNFINISHED).otherwise(0)).cast("long")
    keep = lambda role: F.when(turn["initial"] == role, stays).otherwise(F.lit(NEVER))
    new = {x: [_after(st[x], DELETE, "D")] for x in STATES}
    new["s"].append(_after(st["o"], keep("s"), "K"))
    for before, role in (("o", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
        new[role] += [_after(st[before], keep(role), "K"), _after(st[before], stays + REROLE, "R")]
    return F.struct(*((F.least(*ways) if len(ways) > 1 else ways[0]).alias(x) for x, ways in new.items()))


def _inserted(st: Column) -> Column:
    """The states after as many insertions as help: one leads to the other of user and assistant, two to
    an assistant from before a user."""
    u = F.least(st["u"], *(_after(st[x], INSERT, "I") for x in "osa"))
    a = F.least(st["a"], _after(st["u"], INSERT, "I"), *(_after(st[x], 2 * INSERT, "II") for x in "os"))
    return F.struct(st["o"].alias("o"), st["s"].alias("s"), u.alias("u"), a.alias("a"))


def _start(at: str) -> Column:
    return F.struct(*(F.struct(F.lit(0 if x == at else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(x) for x in STATES))


def _block(turns: Column, first: Column) -> Column:
    """What a block of sorted turns makes of each state before it; of a conversation's first block, of its
    beginning alone."""
    begin = F.when(first, F.transform(F.array(_start("o")), _inserted)).otherwise(F.array(*map(_start, STATES))).cast(f"array<{STATE}>")
    return F.aggregate(turns, begin, lambda acc, t: F.transform(F.transform(acc, lambda st: _turn(st, t)), _inserted).cast(f"array<{STATE}>"))


def _joined(left: Column, right: Column) -> Column:
    """A block and the one after it as one: over each state between them."""
    way = lambda x, y: F.struct(F.least(x["cost"] + y["cost"], F.lit(NEVER)).alias("cost"), F.concat(x["audit"], y["audit"]).alias("audit"))
    one = lambda st: F.struct(*(F.least(*(way(st[m], right[i][x]) for i, m in enumerate(STATES))).alias(x) for x in STATES))
    return F.transform(left, one).cast(f"array<{STATE}>")


def _folded(rows: DataFrame, longest: int) -> DataFrame:
    """conv, cost, audit of each conversation of ``rows`` (conv, pos, initial, fault), the longest of which has
    ``longest`` turns: blocks of turns, then blocks of blocks, until one is left."""
    at = (F.col("pos") / TURNS).cast("long")
    blocks = rows.groupBy("conv", at.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "initial", "fault"))).alias("turns"))
    blocks = blocks.select("conv", "block", _block(F.col("turns"), F.col("block") == 0).alias("m"))
    left = -(-longest // TURNS)
    while left > 1:
        blocks = written(blocks, "conv-blocks")
        some = F.sort_array(F.collect_list(F.struct("block", "m")))
        together = F.aggregate(F.slice("ms", 2, BLOCKS), F.get("ms", F.lit(0))["m"], lambda acc, b: _joined(acc, b["m"]))
        blocks = blocks.groupBy("conv", (F.col("block") / BLOCKS).cast("long").alias("next")).agg(some.alias("ms")).select("conv", F.col("next").alias("block"), together.alias("m"))
        left = -(-left // BLOCKS)
    end = F.get("m", F.lit(0))
    best = F.least(end["o"], end["a"])
    return blocks.select("conv", best["cost"].alias("cost"), best["audit"].alias("audit"))


def _hashed(batches):
    """conv, sha: rows (conv, line) come sorted, so a conversation's hash is carried from one to the next."""
    conv, sha, some, begun = None, None, False, False
    for b in batches:
        out = []
        for key, line in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if not begun or key != conv:
                if begun:
                    out.append((conv, sha.hexdigest()))
                conv, sha, some, begun = key, hashlib.sha256(), False, True
            if line is not None:
                sha.update(("\n" + line if some else line).encode())
                some = True
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())], ["conv", "sha"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["conv", "sha"])


def _repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv, pos, line: the repaired turns of each row, joined by line feeds; null where none stays.  What is
    inserted goes ahead of the row it precedes; what comes last, behind all rows, has a row of its own."""
    pieces = F.concat(F.regexp_extract_all("audit", F.lit("I*[KRD]"), F.lit(0)), F.array(F.regexp_extract("audit", "I*$", 0)))
    edits = plans.select("conv", F.posexplode(pieces).alias("pos", "edit")).withColumn("pos", F.col("pos").cast("long"))
    r = edits.join(rows.select("conv", "pos", "initial", "role", "text"), ["conv", "pos"], "left").withColumn("block", (F.col("pos") / TURNS).cast("long"))
    last, inserts = F.right("edit", F.lit(1)), F.length(F.regexp_extract("edit", "^I*", 0))
    # after a system's turn users' and assistants' turns alternate, so the number of turns tells the role
    r = r.withColumns({"last": last, "inserts": inserts, "outs": (inserts + (last.isin("K", "R") & ~((last == "K") & (F.col("initial") == "s"))).cast("int")).cast("long")})
    r = written(r, "conv-edits")
    sums = r.groupBy("conv", "block").agg(F.sum("outs").alias("n"))
    behind = sums.select("conv", "block", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("outs").over(Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("within", within).join(behind, ["conv", "block"])
    named = lambda k: F.when(k % 2 == 0, "user").otherwise("assistant")
    at = F.col("ahead") + F.col("within")
    new = F.transform(F.sequence(F.lit(0).cast("long"), F.col("inserts").cast("long") - 1), lambda i: F.concat(named(at + i), F.lit(":")))
    new = F.when(F.col("inserts") > 0, new).otherwise(F.array().cast("array<string>"))
    own = F.when(F.col("last") == "K", F.concat("role", F.lit(":"), "text")).when(F.col("last") == "R", F.concat(named(at + F.col("inserts")), F.lit(":"), "text"))
    lines = F.concat(new, F.when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>")))
    return r.select("conv", "pos", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("line"))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and its cheapest repair; and the repaired turns.

    First: conv (its id as text), gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.  Second: conv, pos, line, the repaired turns as ``role:text``, in order of pos; line is
    null where a turn goes.

    A conversation's turns stand by number, those without one first; those of one number by role and text.
    A null role or text is one space; a null id is a conversation of its own.  gaps counts numbers between
    the least and the greatest that no turn has.  A turn has one fault at most: blank, else duplicate of an
    earlier one in role and text, else truncated.  Blank and duplicate turns are deleted; others are kept, given
    another role or deleted, and empty turns inserted, so that at most one system's turn is followed by
    turns of user and assistant in pairs, at the least cost; among equals the least audit in ASCII wins.  An
    empty table gives no rows.

    The fold goes over blocks of turns; blocks but a conversation's first are folded from each of the four
    states, and put together afterwards, so a conversation of any length is shared out.  The
    hash of its repaired text is the one thing that a single task must read through, line by line."""
    conv, turn, role, text = F.col(f"`{conv_col}`").cast("string"), F.col(f"`{turn_col}`").cast("long"), F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")), F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    rows = turns.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    placed = positions(rows.withColumn("conv", F.coalesce(F.concat(F.lit("="), "conv"), F.lit(""))), "conv", ["turn", "role", "text"])  # "" for null, which joins
    block = (F.col("pos") / TURNS).cast("long")
    same = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)
    placed = placed.withColumns({"block": block, "same": same})
    # duplicates within a block by a window, those of earlier blocks by each text's first place
    again = F.row_number().over(Window.partitionBy("conv", "block", "same").orderBy("pos")) > 1
    firsts = placed.groupBy("conv", "same").agg(F.min("pos").alias("first"))
    flagged = placed.withColumn("again", again).join(firsts, ["conv", "same"])
    blank, duplicate = ~F.col("text").rlike(SAID), F.col("again") | (F.col("pos") > F.col("first"))
    kind = F.when(blank, "blank").when(duplicate, "duplicate").when(~F.col("text").rlike(ENDED), "truncated").otherwise("none")
    initial = F.left("role", F.lit(1))
    before = F.lag("initial").over(Window.partitionBy("conv", "block").orderBy("pos"))
    flagged = flagged.select("conv", "turn", "role", "text", "pos", "block", kind.alias("kind"), initial.alias("initial")).withColumn("before", before)
    lasts = placed.groupBy("conv", (F.col("block") + 1).alias("block")).agg(F.max_by(initial, "pos").alias("carried"))
    flagged = flagged.join(lasts, ["conv", "block"], "left").withColumn("before", F.coalesce("before", "carried"))
    fault = F.when(F.col("kind").isin("blank", "duplicate"), 2).when(F.col("kind") == "truncated", 1).otherwise(0)
    flagged = written(flagged.select("conv", "turn", "role", "text", "pos", "kind", "initial", "before", fault.alias("fault")), "conv-flagged")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    count = lambda c: F.count_if(c)
    counts = flagged.groupBy("conv").agg(*(count(F.col("kind") == k).alias(k) for k in ("blank", "duplicate", "truncated")), count(illegal).alias("illegal"), F.max("pos").alias("last"))
    numbers = flagged.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    counts = written(counts.join(numbers, "conv", "left"), "conv-counts")
    longest = (counts.agg(F.max("last")).first()[0] or 0) + 1
    plans = written(_folded(flagged, longest), "conv-plans")
    lines = written(_repaired(flagged, plans), "conv-lines")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = lines.select("conv", "pos", "line").repartition(n, "conv").sortWithinPartitions("conv", "pos").mapInArrow(_hashed, "conv string, sha string")
    named = F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).alias("conv")
    out = plans.join(counts, "conv").join(hashes, "conv")
    out = out.select(named, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    forget(placed)
    return out, lines.select(named, "pos", "line")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text; nulls: one space) damaged by the CRC-32 of id and number: one in
    twenty is dropped, emptied, robbed of its full stops, repeated, and given to the user, each."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.withColumn("copy", copies).select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired; one of which no turn is left has zeros, an
    empty audit and the hash of an empty text.  Nulls, ties and empty tables as in :func:`repair_conversations`."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, _ = repair_conversations(damaged(turns))
    ids = turns.select("conv_id").distinct()
    joined = ids.join(found, ids.conv_id.cast("string").eqNullSafe(found.conv), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same in DuckDB's SQL, where each state of the fold carries the repaired text as well.  Turns
    (kind 0 to 2) and insertions (kind 3) alternate in the list that is folded."""
    way = lambda x, cost, letters, line: (
        f"{{'c': least(st.{x}.c + ({cost}), {NEVER}), 'a': st.{x}.a || '{letters}', 't': CASE WHEN st.{x}.t = '' THEN {line} ELSE st.{x}.t || chr(10) || {line} END}}" if line else f"{{'c': least(st.{x}.c + ({cost}), {NEVER}), 'a': st.{x}.a || '{letters}', 't': st.{x}.t}}"
    )
    stays = f"CASE r.f WHEN 2 THEN {NEVER} WHEN 1 THEN {UNFINISHED} ELSE 0 END"
    keep = lambda x, role: way(x, f"CASE WHEN r.i = '{role}' THEN {stays} ELSE {NEVER} END", "K", "r.w || ':' || r.t")
    rerole = lambda x, role: way(x, f"{REROLE} + {stays}", "R", f"'{role}:' || r.t")
    gone = lambda x: way(x, f"{DELETE}", "D", "")
    more = lambda x, *roles: way(x, f"{INSERT * len(roles)}", "I" * len(roles), " || chr(10) || ".join(f"'{r}:'" for r in roles))
    turn = {"o": [gone("o")], "s": [gone("s"), keep("o", "s")], "u": [gone("u"), *(f(x, r) for x in "osa" for f, r in ((keep, "u"), (rerole, "user")))], "a": [gone("a"), keep("u", "a"), rerole("u", "assistant")]}
    put = {"o": ["st.o"], "s": ["st.s"], "u": ["st.u", *(more(x, "user") for x in "osa")], "a": ["st.a", more("u", "assistant"), *(more(x, "user", "assistant") for x in "os")]}
    made = lambda ways: "{" + ", ".join(f"'{x}': {'least(' + ', '.join(w) + ')' if len(w) > 1 else w[0]}" for x, w in ways.items()) + "}"
    start = "{" + ", ".join(f"'{x}': {{'c': {0 if x == 'o' else NEVER}::BIGINT, 'a': '', 't': ''}}" for x in STATES) + "}"
    white = "[^\\x20\\x09-\\x0D]"
    return f"""WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, ({crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")}) % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) FROM k WHERE k <> 0)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '{white}') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN regexp_extract(text, '({white})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS kind, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM p),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate, count(*) FILTER (kind = 't') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal,
 list({{'i': i, 'w': role, 't': text, 'f': CASE kind WHEN '' THEN 0 WHEN 't' THEN 1 ELSE 2 END}} ORDER BY pos) AS rows FROM f GROUP BY conv_id),
e AS (SELECT *, list_reduce(list_prepend({{'i': '', 'w': '', 't': '', 'f': 3}}, flatten(list_transform(rows, lambda x: [x, {{'i': '', 'w': '', 't': '', 'f': 3}}]))), lambda st, r: CASE WHEN r.f = 3 THEN {made(put)} ELSE {made(turn)} END, {start}) AS st FROM g),
z AS (SELECT *, least(st.o, st.a) AS best FROM e)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id"""


SQL = _sql()
