"""SimHash near-duplicates by a binary-trie self-join (operator 7); with them, in the pipeline's stage, near copies
by verified Jaccard similarity of five-word shingles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, dealt_texts, forget, keep_rows, mix, release, small_enough, written
from .graph import components
from .near import crowd_pairs, open_lists, open_pairs, shingles, star_pairs, verified

SHINGLE = 3
SEED = 42
STEP = 4  # bits from one level of the distributed trie to the next
WORDS = 5  # of a shingle of the pipeline's stage
BANDS, ROWS = 20, 4  # a pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**20 = 0.99997


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the XXH64 values (seed 42) of the text's
    word shingles, repeats counted.  No words: zero.  Fewer words than a shingle: all of them."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    h64 = xxhash.xxh64_intdigest
    values = [h64(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):  # bounds the unpacked bits of a very long text
        part = np.array(values[at : at + 65536], dtype=">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(values)).view(">u8")[0])


def _fingerprints(batches):
    for b in (c for b in batches for c in chunks(b)):
        f = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return dealt_texts(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def trie_pairs(a: np.ndarray, b: np.ndarray | None, bits: int, chunk: int = 200_000):
    """Pairs (i, j) of positions with a[i], b[j] at most ``bits`` bits apart, in chunks of arrays.
    a, b: sorted distinct uint64; without b pairs i < j within a.

    A node of the binary trie over a sorted array is a range of it.  Pairs of nodes of one depth
    are split together bit by bit, each pair carrying how many bits its paths differ in so far,
    and are dropped once that exceeds the budget."""
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    todo = [(0, np.array([[0], [len(a)], [0], [len(b)], [0]], dtype=np.int64))]
    while todo:
        depth, pairs = todo.pop()
        if pairs.shape[1] > chunk:
            half = pairs.shape[1] // 2
            todo += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        alo, ahi, blo, bhi, off = pairs
        small = ((ahi - alo) * (bhi - blo) <= 16) | (depth == 64)
        if small.any():
            lo_a, lo_b, nb = alo[small], blo[small], (bhi - blo)[small]
            n = (ahi - alo)[small] * nb
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i, j = lo_a[which] + k // nb[which], lo_b[which] + k % nb[which]
            close = np.bitwise_count(a[i] ^ b[j]) <= bits
            if own:
                close &= i < j
            if close.any():
                yield i[close], j[close]
            alo, ahi, blo, bhi, off = (x[~small] for x in pairs)
        if not len(alo):
            continue
        shift = np.uint64(63 - depth)
        amid = np.clip(np.searchsorted(a, (a[alo] >> shift | np.uint64(1)) << shift), alo, ahi)
        bmid = np.clip(np.searchsorted(b, (b[blo] >> shift | np.uint64(1)) << shift), blo, bhi)
        same = (alo == blo) & (ahi == bhi) if own else np.zeros(len(alo), bool)
        kids = [(alo, amid, blo, bmid, off), (amid, ahi, bmid, bhi, off), (alo, amid, bmid, bhi, off + 1), tuple(x[~same] for x in (amid, ahi, blo, bmid, off + 1))]
        kids = np.concatenate([np.array(k) for k in kids], axis=1)
        kids = kids[:, (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= bits)]
        if kids.shape[1]:
            todo.append((depth + 1, kids))


def forest(n: int, pairs) -> np.ndarray:
    """Smallest connected index of each of n vertices; ``pairs`` yields arrays (i, j)."""
    at = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = at[i], at[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(at, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = at[at]
                if (up == at).all():
                    break
                at = up
    return at


def _meet(bits: int):
    """Within a block of a leaf: a spanning forest of its own fingerprints and of those that visit it; its own
    ones meet each other in the first block alone."""

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        a, b = np.sort(fp[home]), np.sort(fp[~home])
        n = len(a)
        every = np.concatenate([a, b])
        between = ((i, j + n) for i, j in trie_pairs(a, b, bits))
        own = trie_pairs(a, None, bits) if table.column("block")[0].as_py() == 0 else ()
        root = forest(len(every), (x for part in (own, between) for x in part))
        moved = root != np.arange(len(every))
        return pa.table({"a": pa.array(every[moved].view(np.int64), pa.int64()), "b": pa.array(every[root[moved]].view(np.int64), pa.int64())})

    return run


def _below(nodes: DataFrame, depth: int, bits: int) -> DataFrame:
    """The children, STEP bits further down at ``depth``, that the fingerprints of ``nodes`` (fp, prefix,
    off) go to: their own, and as visitors those to its right that differ from their path in at most
    ``bits`` bits.  Two leaves meet once, the left one's fingerprints visiting the right one."""
    kid = nodes.withColumn("kid", F.explode(F.sequence(F.lit(0), F.lit((1 << STEP) - 1)).cast("array<bigint>")))
    own = F.shiftrightunsigned("fp", 64 - depth)
    prefix = F.shiftleft("prefix", STEP).bitwiseOR(F.col("kid"))
    # compared as unsigned numbers; a prefix of all 64 bits may have the upper one set
    order = (lambda c: c.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))) if depth == 64 else (lambda c: c)
    off = F.col("off") + F.bit_count(own.bitwiseAND(F.lit((1 << STEP) - 1)).bitwiseXOR(F.col("kid")))
    return kid.select("fp", prefix.alias("prefix"), off.alias("off"), own.alias("own")).filter((F.col("off") <= bits) & (order(F.col("prefix")) >= order(F.col("own")))).drop("own")


def trie_leaves(fps: DataFrame, bits: int = 2, cap: int = 2_000) -> DataFrame:
    """depth, prefix, home, fp: the leaves of a trie over the distinct fingerprints of the written table
    ``fps``, with the fingerprints that lie in each (home) and those that visit it.

    A node with more than ``cap`` fingerprints of its own is split further.  The depth to begin with
    follows from their number; from there on level by level, only what lies under heavy nodes going
    on.  Nodes are rows of tables throughout; a level's heavy nodes are broadcast to its rows if there
    are few, else joined by a shuffle."""
    total = fps.count()
    depth, nodes = 0, fps.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("off"))
    done = []
    while True:
        if total > cap and depth < 64:
            ahead = 1 if depth else max(1, int(np.log2(total / cap)) // STEP)
            for _ in range(min(ahead, 64 // STEP)):
                depth += STEP
                nodes = _below(nodes, depth, bits)
            nodes = written(nodes, f"trie-{depth}")
        home = F.col("off") == 0
        size = written(nodes.filter(home).groupBy("prefix").agg(F.count("*").alias("n")), "trie-sizes")
        placed = nodes.join(F.broadcast(size) if small_enough(size, 1_000_000) else size, "prefix")
        leaf = F.lit(True) if total <= cap or depth == 64 else F.col("n") <= cap
        done.append(placed.filter(leaf).select(F.lit(depth).alias("depth"), "prefix", home.alias("home"), "fp"))
        if size.filter(~leaf).isEmpty():
            return reduce(DataFrame.unionByName, done)
        nodes = placed.filter(~leaf).select("fp", "prefix", "off")


def leaf_blocks(leaves: DataFrame, cap: int) -> DataFrame:
    """depth, prefix, block, home, fp: ``leaves`` with the visitors of each dealt to blocks of ``cap`` on
    average, and its own fingerprints, ``cap`` at most, put into all of its blocks.  However many
    visit a leaf, a block has little more than twice ``cap`` rows."""
    of = ["depth", "prefix"]
    visitors = leaves.filter("NOT home").groupBy(*of).agg(F.ceil(F.count("*") / F.lit(float(cap))).cast("int").alias("blocks"))
    r = leaves.join(visitors, of, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = F.array(F.pmod(F.xxhash64("fp", F.lit(5)), F.col("blocks")).cast("int"))
    return r.select(*of, F.explode(F.when(F.col("home"), every).otherwise(one)).alias("block"), "home", "fp")


def near_edges(fps: DataFrame, bits: int = 2, cap: int = 2_000) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints linked at ``bits`` or fewer bits: of each
    block of a leaf a spanning forest, so their number is linear however dense a cluster is.

    fps: a written table of distinct fingerprints ``fp``.  A fingerprint visits more leaves the deeper
    the trie is: with d bits of depth 1 + d + d(d - 1) / 2 at two bits of budget, half of them, and of
    those the leaves that have fingerprints."""
    blocks = leaf_blocks(trie_leaves(fps, bits, cap), cap)
    return blocks.groupBy("depth", "prefix", "block").applyInArrow(_meet(bits), "a long, b long")


def simhash_groups(docs: DataFrame, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row: component_id is the smallest doc_id that is reached
    over fingerprints at most ``bits`` bits apart.

    A null text has no words; texts without words have fingerprint zero and are linked like any
    other.  Rows with a null id get a component like others, which is null only if no row of it
    has an id; repeated rows are returned as often as they come; an empty table gives no rows.
    Documents meet by distinct fingerprint, so copies cost nothing, and links are kept as spanning
    forests, never as all pairs."""
    each = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    edges = written(near_edges(fps, bits), "near")
    stars = written(components(edges), "stars")
    named = written(fps.join(stars, fps.fp == stars.u, "left").select("fp", "least", F.coalesce("m", "fp").alias("root")), "named")
    roots = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    of = written(named.join(roots, "root").select("fp", "component_id"), "of-fps")
    forget(fps, edges, stars, named, roots)
    return each.join(of, "fp").select("doc_id", "fp", "component_id")


def band_keys(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """texts x BANDS: a hash of ROWS minima of differently seeded orders of each text's shingles.
    Texts without words share all of theirs."""
    rng = np.random.default_rng(20240611)
    full = np.flatnonzero(n)
    at = (np.cumsum(n) - n)[full]
    out = np.zeros((len(n), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(n), band, np.uint64)
        for flip, odd in rng.integers(0, 1 << 64, (ROWS, 2), dtype=np.uint64):
            with np.errstate(over="ignore"):
                low = np.zeros(len(n), np.uint64)
                if len(full):
                    low[full] = np.minimum.reduceat((h ^ flip) * (odd | np.uint64(1)), at)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = key
    return out


def _banded(fingerprinted: bool):
    """doc_id, node, fp (null unless wanted), keys."""

    def run(batches):
        for b in (c for b in batches for c in chunks(b)):
            texts = b.column(1).to_pylist()
            keys = band_keys(*shingles(texts, WORDS)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            fps = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)) if fingerprinted else pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fps, lists], ["doc_id", "node", "fp", "keys"])

    return run


def _sets(batches):
    for b in (c for b in batches for c in chunks(b)):
        h, n = shingles(b.column(1).to_pylist(), WORDS)
        sets = [np.unique(x).tobytes() for x in np.split(h, np.cumsum(n)[:-1])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "s"])


def fingerprint_links(nodes: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that connect exactly the nodes (written table: node, fp) that operator 7 connects: each
    node with the least of its component of fingerprints; a written table."""
    fps = written(nodes.select("fp").distinct(), "near-fps")
    edges = written(near_edges(fps, bits), "near-fp-edges")
    stars = written(components(edges), "near-fp-stars")
    rooted = written(nodes.join(stars, nodes.fp == stars.u, "left").select("node", F.coalesce("m", "fp").alias("root")), "near-fp-roots")
    least = rooted.groupBy("root").agg(F.min("node").alias("a"))
    links = written(rooted.join(least, "root").filter("node <> a").select("a", F.col("node").alias("b")), "near-fp-links")
    forget(fps, edges, stars, rooted)
    return links


def _near(docs: DataFrame, id_col: str, text_col: str, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, node for every row (a 64-bit hash names a text), and node, root: the components.

    ``bits``: first the texts whose fingerprints the binary trie links are linked; the similarity of sets then links
    what that has left in different components.  Candidates share one of BANDS keys of minima; each link is verified on the whole sets.  Texts meet
    once however many copies they have.  First each text of a bucket meets the bucket's centre, the text
    that has most others in its buckets; what this leaves in different components meets pair by pair in
    short buckets, and by its rarest shingles in long ones (:mod:`.near`)."""
    src = dealt_texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("node"))
    each = written(src.mapInArrow(_banded(bits is not None), "doc_id long, node long, fp long, keys array<long>"), "banded")
    nodes = written(each.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-nodes")
    linked = [] if bits is None else [fingerprint_links(nodes, bits)]
    release(docs.sparkSession)
    placed = nodes.select("node", F.explode("keys").alias("k"))
    shared = placed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    placed = written(placed.join(shared, "k"), "near-placed")
    members = written(placed.join(placed.groupBy("node").agg(F.sum("n").alias("score")), "node").select("k", "node", "score", F.lit(0).alias("size")), "near-members")  # sizes aren't known here
    wanted = written(members.select("node").distinct(), "near-wanted")
    texts = src.join(F.broadcast(wanted) if small_enough(wanted, 1_000_000) else wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(_sets, "node long, s binary"), "near-sets")
    pairs = star_pairs(members)
    for known in linked:  # a star's pairs need no check
        pairs = pairs.join(known, ["a", "b"], "left_anti")
    first = written(reduce(DataFrame.unionByName, [verified(pairs, sets), *linked]), "near-links")
    roots = written(components(first), "near-roots")
    release(docs.sparkSession)
    open_ = written(open_lists(members, roots), "near-open")
    crowd = open_.filter("crowd").select("node", "root").distinct()
    rest = open_pairs(open_).unionByName(crowd_pairs(sets, crowd)).distinct()
    links = written(first.unionByName(verified(rest, sets)), "near-links")
    release(docs.sparkSession)
    stars = written(components(links), "near-stars")
    of = written(nodes.join(stars, nodes.node == stars.u, "left").select("node", F.coalesce("m", "node").alias("root")), "near-of")
    forget(nodes, placed, members, wanted, sets, first, roots, open_, links, stars, *linked)
    return each.select("doc_id", "node"), of


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id for every row: component_id is the smallest doc_id that is reached over
    pairs of texts with at least 0.8 of their five-word shingles in common (Jaccard, sets, A-Z
    lower-cased).  Nulls, empty texts, repeated rows and empty tables as in :func:`simhash_groups`."""
    each, of = _near(docs, id_col, text_col)
    rooted = written(each.join(of, "node").select("doc_id", "root"), "near-rows")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """Of each component the row with the smallest doc_id, with all its columns.  Texts are linked by fingerprints
    at most ``bits`` bits apart (:func:`simhash_groups`) and by 0.8 of their shingles in common (:func:`near_groups`).

    Rows are told apart by id and text: a row without an id stays only if its component has none with
    one, and then one such row stays; of rows that share the smallest id the one whose text's hash is
    least stays, and of rows that are alike a single one.  Texts without words form one component.  An
    empty table gives no rows."""
    each, of = _near(docs, id_col, text_col, bits)
    rows = each.groupBy("doc_id", "node").agg(F.count("*").alias("n")).join(of, "node")
    rows = written(rows.select("doc_id", F.col("node").alias("th"), "root", "n"), "near-rows")
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("s"))
    verdict = rows.join(stays, "root").select("doc_id", "th", "n", (F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("th") == F.col("s.th"))).alias("keep"))
    verdict = written(verdict, "near-verdict")
    forget(rows, of)
    return keep_rows(docs, verdict, id_col, text_col, once=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, with its fingerprint in hexadecimal; nulls, ties, repeated rows and empty
    tables as in :func:`simhash_groups`."""
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
