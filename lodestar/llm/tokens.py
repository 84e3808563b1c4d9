"""Token counts by an exact histogram of encoded lengths (operator 4)."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, dealt_texts, written

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the public byte-level vocabularies split a text before merging; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
QUANTILES = (0.5, 0.9, 0.99)
BLOCK = 1024  # lengths whose sums are taken together
LONG_SPACE = 4096  # white space from here on is cut out before the pattern sees it
#: White space as the pattern's ``\\s`` means it; fixed values.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ENCODERS: dict[bytes, tiktoken.Encoding] = {}


def encoder(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The tokenizer of a rank file's content; strings of special tokens are ordinary text."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def encoded_length(encode: tiktoken.Encoding, text: str | None, long: int = LONG_SPACE) -> int:
    """Tokens of the whole text under :data:`PATTERN` or one that splits white space alike.

    The pattern looks ahead from white space and runs out of stack in very long runs of it.  A run is
    one piece up to its last character, which goes with the word behind it; at the end of the text it
    is one piece whole.  No other piece holds white space before its last character's neighbour, so
    long runs are cut out, encoded as the piece they are, and the rest is encoded as it stands."""
    text, at, n = text or "", 0, 0
    for run in re.finditer(f"{_SPACE}{{{long},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(encode.encode_ordinary(text[at : run.start()])) + len(encode._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encode.encode_ordinary(text[at:] if at else text))


def token_lengths(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens for every row: the length of the whole text, encoded.

    ``ranks`` is the path of a rank file on the driver; its content, about a megabyte whatever the
    corpus, is broadcast.  A null text is empty and has no tokens; white space of any length is counted;
    repeated rows and null ids are kept; an empty table gives no rows."""
    with open(ranks, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        encode = encoder(shared.value, pattern)
        for b in batches:
            for c in chunks(b):
                n = np.fromiter((encoded_length(encode, t) for t in c.column(1).to_pylist()), np.int64, c.num_rows)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return dealt_texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """length, n_docs: how many documents have each length; combined before the shuffle, so one
    very common length costs one row for each task."""
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds docs_from and tokens_from: documents of each length or a larger one, and their tokens.

    Lengths are summed in blocks of BLOCK; only the blocks' sums, of which there are as many as the
    longest document has blocks, are summed up in one place."""
    block = F.floor(F.col("length") / BLOCK)
    h = hist.withColumn("block", block).withColumn("tokens", F.col("length") * F.col("n_docs"))
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    beyond = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("d").over(beyond), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(beyond), F.lit(0)).alias("t"))
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("own_d", F.sum("n_docs").over(within)).withColumn("own_t", F.sum("tokens").over(within))
    return h.join(sums, "block").select("length", "n_docs", (F.col("own_d") + F.col("d")).alias("docs_from"), (F.col("own_t") + F.col("t")).alias("tokens_from"))


def totals(hist: DataFrame) -> DataFrame:
    """One row: total_docs, total_tokens."""
    return hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("total_docs"), F.coalesce(F.sum(F.col("length") * F.col("n_docs")), F.lit(0)).alias("total_tokens"))


def context_limits(lengths: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """The answers for every context limit from the lengths (n_tokens) of documents.

    One row for each length that occurs, as a limit: length, n_docs, docs_from and tokens_from
    (documents at least that long), truncated_total (tokens left if each document is cut at the
    limit), docs_cut (documents longer than it), and, the same in each row, total_docs, total_tokens
    and a quantile p<percent> for each of ``quantiles``: the least length that that share of documents
    doesn't exceed.  Between two lengths that occur truncated_total grows by docs_from of the larger
    one for each token.  An empty table gives no rows; nulls among lengths are no documents."""
    hist = written(histogram(lengths.filter("n_tokens IS NOT NULL")), "token-histogram")
    sums = written(suffix_sums(hist), "token-sums")
    total = totals(hist).first()
    cut = F.col("docs_from") - F.col("n_docs")
    t = sums.withColumn("total_docs", F.lit(total.total_docs)).withColumn("total_tokens", F.lit(total.total_tokens))
    t = t.withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).withColumn("docs_cut", cut)
    least = [F.min(F.when(F.col("total_docs") - F.col("docs_cut") >= F.ceil(F.lit(q) * F.col("total_docs")), F.col("length"))) for q in quantiles]
    found = t.agg(*least).first()
    return t.select("*", *(F.lit(v).cast("long").alias(f"p{round(q * 100)}") for q, v in zip(quantiles, found)))


def truncated_total(sums: DataFrame, total: DataFrame, limit: int) -> int:
    """Tokens left if each document is cut at any ``limit``, from suffix sums and totals."""
    beyond = sums.filter(F.col("length") > limit).agg(F.max("docs_from"), F.max("tokens_from")).first()
    return (total.first().total_tokens - (beyond[1] or 0)) + limit * (beyond[0] or 0)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; null texts are empty, an empty table gives no rows."""
    return context_limits(token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
