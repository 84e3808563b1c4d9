"""Documents to overlapping shards, and spans between shards and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def check_options(size: int, overlap: int) -> None:
    if not isinstance(size, int) or size <= 0:
        raise ValueError("chunk size must be a positive integer")
    if not isinstance(overlap, int) or overlap < 0:
        raise ValueError("overlap must be a non-negative integer")
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")


def windows(length, size: int, overlap: int) -> Column:
    """array of struct(shard_index, start, end): windows of ``size`` that step by size - overlap and
    stop at the first that reaches the end; an empty text has one empty window."""
    step = size - overlap
    n = F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / F.lit(float(step))).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("shard_index"), (i * step).alias("start"), F.least(length, i * step + size).alias("end")))


def shard_id(program_hash: str | Column, document_id, size: int, overlap: int, start, end, text) -> Column:
    """SHA-256 over eight ``key=value`` lines that name all a shard depends on."""
    program = F.lit(program_hash) if isinstance(program_hash, str) else program_hash
    head = F.concat(F.lit("programHash="), program, F.lit("\ndocumentId="), document_id, F.lit(f"\nchunkSize={size}\noverlap={overlap}\noffsetMode={T.OFFSET_MODE}\nshardStart="))
    return F.sha2(F.concat(head, start.cast("string"), F.lit("\nshardEnd="), end.cast("string"), F.lit("\nshardText="), text), 256)


def shard_documents(docs: DataFrame, program_hash: str | Column, size: int, overlap: int, ids: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """document_id, shard_index, shard_id, start, end, text from document_id, text (normalised), and the
    columns to ``carry``, of which ``program_hash`` may be one.

    Offsets count UTF-16 code units.  Texts without characters beyond the basic plane, where code
    units are characters, are sliced as text; the others as UTF-16, since a window may cut a
    surrogate pair.  Both ways are built-in functions of one scan."""
    check_options(size, overlap)
    d = docs.select("document_id", *carry, F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("document_id", *carry, "text", T.u16_len(F.col("text")).alias("n_units"), T.has_astral(F.col("text")).alias("astral"))
    d = d.select("document_id", *carry, "text", "astral", F.explode(windows(F.col("n_units"), size, overlap)).alias("w"))
    a, b = F.col("w.start"), F.col("w.end")
    piece = F.when(F.col("astral"), T.u16_slice_lossy(F.col("text"), a, b)).otherwise(F.substr("text", a + 1, b - a))
    d = d.select("document_id", *carry, "w.shard_index", a.alias("start"), b.alias("end"), piece.alias("text"))
    if not ids:
        return d
    key = shard_id(program_hash, F.col("document_id"), size, overlap, F.col("start"), F.col("end"), F.col("text"))
    return d.select("document_id", *carry, "shard_index", key.alias("shard_id"), "start", "end", "text")


def resolved_bound(top, inner) -> Column:
    """struct(bound, verdict) of a bound that may be given beside a span, within it, or both: the outer one is
    taken; verdict is missing if there is none, mismatch if they differ, else ok."""
    bound = F.coalesce(top, inner)
    return F.struct(bound.alias("bound"), F.when(bound.isNull(), "missing").when(top != inner, "mismatch").otherwise("ok").alias("verdict"))


def span_error(start, end, shard_start, shard_end) -> Column:
    """What is wrong with a span within its shard, in order of checking; null if nothing is."""
    return (
        F.when((start < 0) | (end < 0), "a bound is negative")
        .when(start > end, "the bounds are out of order")
        .when(end > shard_end - shard_start, "the span exceeds its shard")
    )


def occurrences(text, quote) -> Column:
    """Offsets (UTF-16 units) of every occurrence of a non-empty quote in a text, overlapping ones too: the
    text is cut in front of each, and the lengths of the pieces are added up."""
    literal = F.concat(F.lit(r"\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pieces = F.split(text, F.concat(F.lit("(?="), literal, F.lit(")")))
    # at: where the piece begins; what is found is kept as text, since an array would be copied for each hit
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("found"))
    step = lambda s, p: F.struct((s["at"] + T.u16_len(p)).alias("at"), F.concat(s["found"], s["at"].cast("string"), F.lit(" ")).alias("found"))
    begins = F.aggregate(pieces, zero, step, lambda s: F.transform(F.split(F.rtrim(s["found"]), " "), lambda x: x.cast("int")))
    return F.when(F.startswith(text, quote), begins).otherwise(F.slice(begins, F.lit(2), F.greatest(F.size(begins) - 1, F.lit(0))))


def quote_error(text, quote, offset_mode, start, end, span_mode, span_start, span_end, length=None, astral=None) -> Column:
    """Code of the first rule that an extraction breaks; null if it stands.  A code column, never a
    filter, so that no rule is evaluated ahead of its turn.  ``length`` (in UTF-16 units) and
    ``astral``, columns made once for each document, spare measuring its text for each extraction."""
    length = T.u16_len(text) if length is None else length
    return (
        F.when(offset_mode != T.OFFSET_MODE, "UNSUPPORTED_OFFSET_MODE")
        .when(start.isNull() | end.isNull() | (start > end), "INVALID_OFFSETS")
        .when(~(span_mode.eqNullSafe(offset_mode) & span_start.eqNullSafe(start) & span_end.eqNullSafe(end)), "OFFSET_MISMATCH")
        .when((start < 0) | (end > length), "OFFSETS_OUT_OF_RANGE")
        .when(~T.slice_equals(text, start, end, quote, astral), "QUOTE_MISMATCH")
    )


IDENTITY = ["offset_mode", "char_start", "char_end", "extraction_class", "quote", "grounding", "attributes_json"]


def order_columns() -> list[Column]:
    """The total order of extractions: place, then class, quote, grounding, attributes."""
    words = lambda c: F.collate(F.col(c), "UNICODE")
    return [F.col("char_start"), F.col("char_end"), words("extraction_class"), words("quote"), words("grounding"), words("attributes_json")]


def dedupe(extractions: DataFrame, document: list[str]) -> DataFrame:
    """One row for each identity within a document."""
    filled = extractions.withColumn("attributes_json", F.coalesce("attributes_json", F.lit("null")))
    return filled.dropDuplicates([*document, *IDENTITY])


def ranked(extractions: DataFrame, document: list[str]) -> DataFrame:
    """Adds nth: the place of each extraction in its document's order, from 1."""
    return extractions.withColumn("nth", F.row_number().over(Window.partitionBy(*document).orderBy(*order_columns())))


def containing(shards: DataFrame, spans: DataFrame) -> DataFrame:
    """Shards with the spans of their document that lie within them."""
    s, p = shards.alias("s"), spans.alias("p")
    return s.join(p, (F.col("s.document_id") == F.col("p.document_id")) & (F.col("s.start") <= F.col("p.char_start")) & (F.col("p.char_end") <= F.col("s.end")))


def greedy_spans(spans: Column) -> Column:
    """Of sorted struct(char_start, char_end, ...) those that begin where the last kept one ended or
    later.  A fold, since what is kept decides what is."""
    kind = F.slice(spans, 1, 0)  # an empty array of the same type
    zero = F.struct(F.lit(0).alias("at"), kind.alias("out"))
    return F.aggregate(
        spans, zero, lambda s, x: F.struct(F.when(x["char_start"] >= s["at"], x["char_end"]).otherwise(s["at"]).alias("at"), F.when(x["char_start"] >= s["at"], F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out")), lambda s: s["out"]
    )
