"""MinHash near-duplicates by an inverted join over signature coordinates (operator 11)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, dealt_texts, forget, mix, small_enough, written
from .graph import components
from .near import crowd_pairs, open_lists, open_pairs, shingles, star_pairs, verified

SHINGLE = 2
#: A pair at similarity 0.8 has 51.2 of 64 coordinates in common on average, and fewer than 32 with a
#: probability of 3e-8.
COORDINATES, MATCHES = 64, 32
SEED = 20240917


def signature(s: np.ndarray, coordinates: int = COORDINATES, seed: int = SEED) -> np.ndarray:
    """One number for each coordinate, made of it and of the least of the hashes ``s`` in its order, so
    that equal numbers are equal coordinates with equal values."""
    rng = np.random.default_rng(seed)
    flips, odds = rng.integers(0, 1 << 64, (2, coordinates), dtype=np.uint64)
    with np.errstate(over="ignore"):
        low = np.array([((s ^ f) * (o | np.uint64(1))).min() for f, o in zip(flips, odds)], np.uint64)
        return mix(low + np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signed(shingle: int, coordinates: int):
    """doc_id, t1, t2, n, node (128 bits of a hash of the set; null for texts without words), keys."""

    def run(batches):
        for b in (c for b in batches for c in chunks(b)):
            h, n = shingles(b.column(1).to_pylist(), shingle)
            sets = [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]
            keys = [signature(s, coordinates).view(np.int64) if len(s) else None for s in sets]
            node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "n", "node", "keys"]
            )

    return run


def _sets(shingle: int):
    def run(batches):
        for b in (c for b in batches for c in chunks(b)):
            h, n = shingles(b.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(x).tobytes() for x in np.split(h, np.cumsum(n)[:-1])], pa.binary())], ["node", "s"])

    return run


def matching(pairs: DataFrame, nodes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Of ``pairs`` (a, b) those with at least ``matches`` coordinates in common.  The long lists, which
    the prefixes leave out, are skipped rather than merged: what they would add to a pair's count is
    read off its two signatures."""
    x, y = (nodes.select(F.col("node").alias(n), F.col("keys").alias(f"{n}_keys")) for n in "ab")
    return pairs.join(x, "a").join(y, "b").filter(F.size(F.array_intersect("a_keys", "b_keys")) >= matches).select("a", "b")


def prefix_postings(nodes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """k, node, score, size: each node (written table: node, keys, size) under the rarest of its coordinate-value
    pairs, as many as it takes for two nodes with ``matches`` in common to share one: all but
    ``matches`` - 1, by rising frequency and value, the same order for all.

    Pairs that only one node has come first in that order and lead nowhere, so they use up a prefix
    without being moved.  score, how often a node's pairs occur in all, tells who stands in the middle
    of its like."""
    postings = nodes.select("node", "size", F.explode("keys").alias("k"))
    often = postings.groupBy("k").agg(F.count("*").alias("often")).filter("often > 1")
    shared = postings.join(often, "k").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "k"))).alias("ks"), F.sum("often").alias("score"), F.first("size").alias("size"))
    return shared.filter(F.size("ks") >= matches).select("node", "score", "size", F.explode(F.slice("ks", F.lit(1), F.size("ks") - (matches - 1))).alias("x")).select("x.k", "node", "score", "size")


def near_links(nodes: DataFrame, texts, shingle: int = SHINGLE, matches: int = MATCHES) -> DataFrame:
    """Links (a, b) that connect exactly what pairs at 0.8 or more connect, chances of the signatures
    apart; a written table.

    nodes: a written table node (long), size, keys.  texts(wanted) gives node, text of a written table of
    nodes.  In each list of postings the members first meet the one with the highest score; what this
    leaves unconnected within a list meets pair by pair if the list is short, and by its rarest
    shingles, exactly, if it isn't.  A pair is compared by signature first and then on whole sets."""
    members = written(prefix_postings(nodes, matches), "mh-members")
    pairs = written(matching(star_pairs(members), nodes, matches), "mh-stars")
    lists = written(members.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "mh-lists")
    members = written(members.join(lists, "k"), "mh-shared")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "mh-wanted")
    sets = written(texts(wanted).mapInArrow(_sets(shingle), "node long, s binary"), "mh-sets")
    first = written(verified(pairs, sets), "mh-links")
    roots = written(components(first), "mh-roots")
    open_ = written(open_lists(members, roots), "mh-open")
    pairs = written(matching(open_pairs(open_), nodes, matches), "mh-pairs")
    crowd = open_.filter("crowd").select("node", "root").distinct()
    more = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("node")).distinct().join(wanted, "node", "left_anti"), "mh-wanted")
    sets = sets.unionByName(written(texts(more).mapInArrow(_sets(shingle), "node long, s binary"), "mh-sets"))
    rest = matching(crowd_pairs(sets, crowd), nodes, matches)
    links = written(first.unionByName(verified(pairs.unionByName(rest).distinct(), sets)), "mh-all-links")
    forget(members, lists, wanted, first, roots, open_, more, pairs)
    return links


def minhash_groups(docs: DataFrame, shingle: int = SHINGLE, coordinates: int = COORDINATES, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: component_id is the smallest doc_id that is
    reached over pairs of texts with at least 0.8 of their distinct word shingles in common (A-Z
    lower-cased; fewer words than a shingle: the whole sequence is one).

    Texts without words, null ones too, have no shingles and no links: each is its own component.  Rows
    with a null id are linked like others; their component is null only if no row of it has an id, and
    they are kept only then.  Repeated rows are returned as often as they come; an empty table gives no
    rows.  Texts with equal sets are one node, so copies cost nothing, and within a component no pair
    is made twice."""
    src = dealt_texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    each = written(src.mapInArrow(_signed(shingle, coordinates), "doc_id long, t1 long, t2 long, n long, node binary, keys array<long>"), "mh-rows")
    named = each.filter("n > 0").groupBy(F.col("node").alias("digest")).agg(F.first(F.struct("t1", "t2", "n", "keys")).alias("x"), F.min("doc_id").alias("least"))
    nodes = written(named.select(F.monotonically_increasing_id().alias("node"), "digest", "x.t1", "x.t2", F.col("x.n").alias("size"), "x.keys", "least"), "mh-nodes")

    def texts(wanted: DataFrame) -> DataFrame:
        of = nodes.select("node", "t1", "t2").join(wanted, "node", "left_semi")
        of = F.broadcast(of) if small_enough(wanted, 1_000_000) else of
        return src.join(of, ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))

    stars = written(components(near_links(nodes, texts, shingle, matches)), "mh-roots")
    rooted = written(nodes.join(stars, nodes.node == stars.u, "left").select("digest", "least", F.coalesce("m", "node").alias("root")), "mh-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(rooted.join(least, "root").select(F.col("digest").alias("node"), "component_id"), "mh-of")
    forget(nodes, stars, rooted)
    out = each.select("doc_id", "n", "node").join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; nulls, ties, repeated rows and empty tables as in :func:`minhash_groups`."""
    return minhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair that shares a shingle, so for small tables: its rows grow with the square of a shingle's texts.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS own FROM w),
e AS MATERIALIZED (SELECT doc_id, len(own) AS n, unnest(own) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS an, any_value(b.n) AS bn FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= 80 * (an + bn - shared)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(own) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.doc_id = s.doc_id
"""
