"""Finding given passages in documents: by an index of keys, one equi-join for passages of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import shards as S

#: Characters of the keys of short items: the largest of these that an item is long enough for.
GRAMS = (16, 8, 4, 2, 1)
#: Bytes of keys that may be broadcast.
BROADCAST_BYTES = 64 << 20


def _words(text) -> Column:
    return F.split(text, "[ \n]")


def _pairs(words) -> Column:
    """Neighbouring words, joined by a space."""
    return F.when(F.size(words) >= 2, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda x, y: F.concat(x, F.lit(" "), y))).otherwise(F.array().cast("array<string>"))


def grams(text, size: int) -> Column:
    """All runs of ``size`` characters of a text, overlapping ones too, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1))


def item_keys(items: DataFrame) -> DataFrame:
    """item_id, kind, key for items (item_id, q).  What a key names stands in every text that the item stands in.

    An item with four words or more has two neighbours within it that stand whole wherever it occurs: the
    longest such pair is its key (kind 0).  A shorter one may begin and end within words; its key is its first
    16, 8, 4, 2 or 1 characters (kind: their number)."""
    i = items.select("item_id", "q", _words("q").alias("w"))
    within = F.when(F.size("w") >= 4, F.slice("w", F.lit(2), F.size("w") - 2)).otherwise(F.array().cast("array<string>"))
    longest = F.array_max(F.transform(_pairs(within), lambda p: F.struct(F.length(p).alias("n"), p.alias("key"))))["key"]
    kind = F.lit(GRAMS[-1])
    for n in reversed(GRAMS[:-1]):
        kind = F.when(F.length("q") >= n, n).otherwise(kind)
    kind = F.when(longest.isNotNull(), 0).otherwise(kind)
    return i.select("item_id", kind.alias("kind"), longest.alias("longest"), "q").select("item_id", "kind", F.coalesce("longest", F.left("q", F.col("kind"))).alias("key"))


def candidates(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """document_id, item_id: pairs that share the item's key; docs: document_id, text.

    The documents' keys, of the kinds that items have, are joined with the items': keys and ids alone
    are broadcast, if they have at most ``broadcast_bytes``, else both sides are dealt by key."""
    keys = item_keys(items)
    sizes = {r.kind: r.bytes for r in keys.groupBy("kind").agg(F.sum(F.octet_length("key") + 16).alias("bytes")).collect()}
    if not sizes:
        return docs.select("document_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).limit(0)
    made = lambda kind: F.transform(F.array_distinct(_pairs(_words("text")) if kind == 0 else grams("text", kind)), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    of = docs.select("document_id", F.explode(F.concat(*map(made, sorted(sizes)))).alias("x")).select("document_id", "x.kind", "x.key")
    hint = F.broadcast if sum(sizes.values()) <= broadcast_bytes else (lambda df: df)
    return of.join(hint(keys), ["kind", "key"]).select("document_id", "item_id").distinct()


def find_passages(docs: DataFrame, items: DataFrame, program_hash: str, size: int = 2048, overlap: int = 512, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """document_id, item_id, quote, char_start, char_end and what an extraction has besides: every occurrence of
    every item (item_id, q, not empty), found shard by shard, in document offsets, with what the
    overlap of shards found twice removed.

    docs: document_id, text (normalised).  Only documents that share an item's key are cut to shards and searched.  Shards
    overlap by the longest item at least, so that each occurrence lies in one of them whole."""
    most = items.agg(F.max(T.u16_len(F.col("q")))).first()[0]
    overlap = max(overlap, most or 0)
    met = candidates(docs, items, broadcast_bytes).join(items.select("item_id", "q"), "item_id")
    s = S.shard_documents(docs.join(met.select("document_id").distinct(), "document_id", "left_semi"), program_hash, max(size, 2 * overlap), overlap, ids=False)
    hit = s.join(met, "document_id").filter(F.contains(F.col("text"), F.col("q")))
    hit = hit.select("document_id", "item_id", F.col("q").alias("quote"), F.col("start").alias("shard_start"), F.explode(S.occurrences(F.col("text"), F.col("q"))).alias("local_start"))
    a = F.col("shard_start") + F.col("local_start")
    found = hit.select("document_id", "item_id", "quote", a.cast("int").alias("char_start"), (a + T.u16_len(F.col("quote"))).cast("int").alias("char_end"), F.lit("passage").alias("extraction_class"), F.lit(T.OFFSET_MODE).alias("offset_mode"), F.lit("explicit").alias("grounding"), F.lit(None).cast("string").alias("attributes_json"))
    return S.dedupe(found, ["document_id", "item_id"])
