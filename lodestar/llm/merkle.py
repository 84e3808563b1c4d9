"""A Merkle manifest of a dataset: proofs for every row, sub-roots for every source (operator 13)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, forget, positions, spread, written

FAN = 3
#: Levels of the tree in a block: 6 561 consecutive nodes.
LEVELS = 8
#: Rows that a call of the block engine gets on average; blocks are dealt to calls by hash.
CALL_ROWS = 1 << 15
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value as a leaf holds it: ``-`` for null, else its UTF-8 bytes' number, a colon and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def levels_of(size: Column) -> Column:
    """How many times ``size`` nodes become runs of FAN until one is left."""
    out = F.lit(40)
    for d in range(39, -1, -1):
        out = F.when(size <= F.lit(FAN**d), F.lit(d)).otherwise(out)
    return out


def _sides(level: int) -> str:
    run = f"PARTITION BY tree, pos // {FAN} ORDER BY pos ROWS BETWEEN"
    before, after = (f"coalesce(string_agg(h, '') OVER ({run} {frame}), '')" for frame in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
    return f"CREATE TABLE s{level} AS SELECT tree, pos, {{'l': {before}, 'r': {after}}} AS sides FROM l{level} WHERE levels > {level}"


def _engine(extra: list[str], depth: int):
    """The work on whole blocks in DuckDB: each level's nodes are ordered concatenations of their runs,
    hashed; each row gets the siblings on its way up, those to the left and those to the right, and the
    first row of a block its root."""

    def run(rows: pa.Table) -> pa.Table:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": ""})
        con.register("rows", rows)
        con.execute("CREATE TABLE l0 AS SELECT tree, pos, h, levels FROM rows")
        for j in range(depth):
            con.execute(_sides(j))
            con.execute(f"CREATE TABLE l{j + 1} AS SELECT tree, pos // {FAN} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, any_value(levels) AS levels FROM l{j} WHERE levels > {j} GROUP BY tree, pos // {FAN}")
        tops = " UNION ALL ".join(f"SELECT tree, pos AS block, h FROM l{j} WHERE levels = {j}" for j in range(depth + 1))
        joins = " ".join(f"LEFT JOIN s{j} ON s{j}.tree = r.tree AND s{j}.pos = r.pos // {FAN**j}" for j in range(depth))
        path = f"list_filter([{', '.join(f's{j}.sides' for j in range(depth))}], lambda s: s IS NOT NULL)"
        out = con.sql(
            f"SELECT r.tree, r.block, r.pos, {''.join(f'r.{c}, ' for c in extra)} {path} AS path, CASE WHEN r.pos = r.block * {FAN**depth} THEN t.h END AS root FROM rows r JOIN ({tops}) t ON t.tree = r.tree AND t.block = r.block {joins}"
        ).to_arrow_table()
        con.close()
        return out

    return run


def trees(nodes: DataFrame, extra: dict[str, str] | None = None, levels: int = LEVELS, call_rows: int = CALL_ROWS) -> tuple[DataFrame, DataFrame]:
    """The trees over ``nodes`` (tree, pos, size, h; a written table): tree, pos, ``extra`` columns
    (name: type) and path, the siblings of every node from below to its tree's root; and tree, root.

    Blocks of FAN ** ``levels`` consecutive nodes are worked through alone; their roots are the nodes of a tree
    of the same shape above, whose paths go behind those of the blocks' nodes.  A block that isn't its
    tree's only one goes all its levels up, however few nodes it has."""
    extra = extra or {}
    width = FAN**levels
    block = F.floor(F.col("pos") / F.lit(width)).cast("long")
    calls = max(1, nodes.count() // call_rows)
    dealt = nodes.withColumns({"block": block, "levels": F.least(levels_of(F.col("size")), F.lit(levels))}).withColumn("call", F.pmod(F.xxhash64("tree", "block"), F.lit(calls)))
    schema = ", ".join(["tree long", "block long", "pos long", *(f"{c} {t}" for c, t in extra.items()), "path array<struct<l: string, r: string>>", "root string"])
    tier = written(dealt.select("call", "tree", "block", "pos", "h", "levels", *(c for c in extra if c != "h")).groupBy("call").applyInArrow(_engine(list(extra), levels), schema), "merkle-tier")
    tops = nodes.filter("pos = 0").select("tree", F.ceil(F.col("size") / F.lit(width)).cast("long").alias("size")).join(tier.filter("root IS NOT NULL").select("tree", F.col("block").alias("pos"), F.col("root").alias("h")), "tree")
    tops = written(tops, "merkle-tops")
    done = tops.filter("size = 1").select("tree", F.col("h").alias("root"))
    more = tops.filter("size > 1")
    if more.isEmpty():
        return tier.drop("block", "root"), done
    above, roots = trees(written(more, "merkle-above"), None, levels, call_rows)
    above = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("outer"))
    joined = tier.drop("root").join(above, ["tree", "block"], "left")
    path = F.concat("path", F.coalesce("outer", F.array().cast("array<struct<l: string, r: string>>")))
    return joined.withColumn("path", path).drop("block", "outer"), done.unionByName(roots)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a node and its siblings."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(docs: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, levels: int = LEVELS, call_rows: int = CALL_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows' proofs and the sources' manifest.

    Rows: doc_id, source, leaf, again (the leaf with the text replaced by ``changed``, a column over docs),
    subroot, root, path (siblings to the left and right, from the leaf to the root over all sources).
    Sources: source, rows, subroot, root, path.

    fields: the columns for id, source, language, length and text, by name; other columns play no part.  A
    leaf is a hash of all five, so nulls, empty and very long texts differ from each other.  Within a
    source rows stand by id, those without one first, and rows with one id by their leaf; rows that are
    alike have leaves of their own, next to each other.  A null source is one like others and the first.
    An empty table gives no rows and no sources."""
    doc_id, source, lang, n_chars, text = (F.col(f"`{c}`") for c in fields)
    rest = (source, lang, n_chars)
    own, again = leaf(doc_id, *rest, text), leaf(doc_id, *rest, text if changed is None else changed)
    rows = spread(docs).select(doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), own.alias("h"), F.when(again != own, again).alias("again"))
    placed = positions(rows, "source", ["doc_id", "h"])
    sources = positions(placed.filter("pos = 0").select(F.lit(0).alias("every"), "source", F.col("size").alias("rows")), "every", ["source"])
    number = sources.select(F.col("source").alias("s"), F.col("pos").alias("tree"))
    nodes = placed.join(number, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    nodes = written(nodes, "merkle-nodes")
    paths, subroots = trees(nodes, {"doc_id": "long", "h": "string", "again": "string"}, levels, call_rows)
    subroots = written(subroots.withColumnRenamed("root", "subroot"), "merkle-subroots")
    upper = sources.join(subroots, sources.pos == subroots.tree).select(F.lit(0).cast("long").alias("tree"), "pos", "size", F.col("subroot").alias("h"), "source", "rows")
    above, top = trees(written(upper, "merkle-sources"), {"h": "string", "source": "string", "rows": "long"}, levels, call_rows)
    top = top.first()
    table = written(above.select(F.col("pos").alias("tree"), "source", "rows", F.col("h").alias("subroot"), F.lit(top.root if top else None).cast("string").alias("root"), F.col("path").alias("outer")), "merkle-manifest")
    out = paths.join(table.select("tree", "source", "subroot", "root", "outer"), "tree")
    out = out.select("doc_id", "source", F.col("h").alias("leaf"), F.coalesce("again", "h").alias("again"), "subroot", "root", F.concat("path", "outer").alias("path"))
    forget(placed, sources)
    return out, table.select("source", "rows", "subroot", "root", F.col("outer").alias("path"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every row of documents, checked with a leaf whose text has lost its line feeds where two
    divides the CRC-32 of the id; a row without an id isn't tampered with.  Nulls, ties, repeated rows
    and empty tables as in :func:`manifest`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    rows, _ = manifest(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    proven = rows.withColumns({"proof_sha256": F.sha2(siblings(F.col("path")), 256), "folded_root": folded(F.col("again"), F.col("path"))})
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 14) -> str:
    """The same level by level in SQL, for sources of up to 3 ** ``levels`` rows; nodes stand in runs of
    three until one is left.  A row's way up: the siblings at each level, found by its place."""
    value = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    made = lambda text: f"sha256({value('doc_id')} || {value('source')} || {value('lang')} || {value('n_chars')} || {value(text)})"
    cut = f"CASE WHEN ({crc32_sql('CAST(doc_id AS VARCHAR)')}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    out = [f"d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (SELECT doc_id, source, {made('text')} AS leaf, {made(cut)} AS again FROM documents))"]

    def tree(name: str, first: str) -> list[str]:
        """name_j: nodes of level j with the texts of their left and right siblings; l, r are empty where the tree has ended."""
        ctes = [f"{name}0 AS MATERIALIZED ({first})"]
        run = "PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN"
        for j in range(levels):
            ctes.append(f"{name}s{j} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{j})")
            ctes.append(f"{name}{j + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}s{j} GROUP BY tree, pos // 3)")
        return ctes

    def climb(name: str, start: str, before: str) -> list[str]:
        """Carries tree, pos, again and proof from ``start`` to the root."""
        ctes, last = [], start
        for j in range(levels):
            ctes.append(f"{before}{j} AS MATERIALIZED (SELECT c.* REPLACE (c.pos // 3 AS pos, CASE WHEN s.n = 1 THEN c.again ELSE sha256(s.l || c.again || s.r) END AS again, c.proof || s.l || s.r AS proof) FROM {last} c JOIN {name}s{j} s ON s.tree IS NOT DISTINCT FROM c.tree AND s.pos = c.pos)")
            last = f"{before}{j}"
        return ctes

    out += tree("a", "SELECT source AS tree, pos, leaf AS h FROM d")
    out += ["ups AS MATERIALIZED (SELECT doc_id, source, leaf, source AS tree, pos, again, '' AS proof FROM d)", *climb("a", "ups", "up")]
    out += tree("b", f"SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, h FROM a{levels}")
    out.append(f"names AS MATERIALIZED (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS nr FROM a{levels})")
    out.append(f"tops AS MATERIALIZED (SELECT u.doc_id, u.leaf, n.subroot, 0 AS tree, n.nr AS pos, u.again, u.proof FROM up{levels - 1} u JOIN names n ON n.source IS NOT DISTINCT FROM u.source)")
    out += climb("b", "tops", "top")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, again AS folded_root, again = h AS verified FROM top{levels - 1} t, b{levels} r"


SQL = _sql()
