"""Column expressions over text: UTF-16 offsets, normalisation, repair steps, hashes, labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFSET_MODE = "utf16_code_unit"
DOC_START, DOC_END = "BEGIN_UNTRUSTED_DOCUMENT", "END_UNTRUSTED_DOCUMENT"
REPLY_START, REPLY_END = "PREVIOUS_RESPONSE_TEXT_BEGIN", "PREVIOUS_RESPONSE_TEXT_END"


def u16_len(text) -> Column:
    """Length in UTF-16 code units.  Only characters beyond the basic plane take two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def has_astral(text) -> Column:
    return F.length(text) != u16_len(text)


def u16_slice_lossy(text, start, end) -> Column:
    """Slice by UTF-16 offsets; half a surrogate pair becomes U+FFFD, as an encoder would write it.
    Such a half can only be the first unit (a low one) or the last (a high one)."""
    raw = u16_bytes(text, start, end)
    half = F.lit(b"\xff\xfd")
    unit = lambda at: F.hex(F.substring(raw, at, 2))
    size = (end - start) * 2
    head = unit(F.lit(1)).between("DC00", "DFFF")
    tail = unit(F.greatest(size - 1, F.lit(1))).between("D800", "DBFF")
    middle = F.substring(raw, F.when(head, 3).otherwise(1), size - F.when(head, 2).otherwise(0) - F.when(tail, 2).otherwise(0))
    none = F.lit(b"")
    whole = F.concat(F.when(head, half).otherwise(none), middle, F.when(tail, half).otherwise(none))
    return F.when(size <= 0, F.lit("")).otherwise(F.decode(whole, "UTF-16BE"))


def u16_bytes(text, start, end) -> Column:
    """The bytes (UTF-16BE) of a slice: compares exactly, also where a pair is cut."""
    return F.substring(F.encode(text, "UTF-16BE"), start * 2 + 1, (end - start) * 2)


def slice_equals(text, start, end, quote, astral=None) -> Column:
    """Whether text[start:end] by UTF-16 offsets is the quote.  ``astral``: whether the text has
    characters beyond the basic plane, if that is known."""
    plain = F.substr(text, start + 1, end - start) == quote
    return F.when(has_astral(text) if astral is None else astral, u16_bytes(text, start, end) == F.encode(quote, "UTF-16BE")).otherwise(plain)


# ---------------------------------------------------------------- normalisation


def normalize_newlines(text) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def trim_line_ends(text) -> Column:
    """Drops tabs and spaces before a line end or the text's end."""
    return F.regexp_replace(text, r"(?<![\t ])[\t ]++(?=[\n\r\x{2028}\x{2029}]|\z)", "")


def _step(name: str, before: Column, after: Column) -> Column:
    return F.struct(F.lit(name).alias("step"), F.lit("not_reversible").alias("mapping_strategy"), (before != after).alias("lossy"), u16_len(before).alias("before_length"), u16_len(after).alias("after_length"))


def normalize_text(text, trim: bool = False) -> Column:
    """struct(text, ledger): the ledger has one entry for each step that ran."""
    text = F.col(text) if isinstance(text, str) else text
    lines = normalize_newlines(text)
    steps = [_step("normalizeNewlines", text, lines)]
    out = lines
    if trim:
        out = trim_line_ends(lines)
        steps.append(_step("trimTrailingWhitespacePerLine", lines, out))
    return F.struct(out.alias("text"), F.array(*steps).alias("ledger"))


# ---------------------------------------------------------------- repair steps that need no parser


def strip_bom(text) -> Column:
    return F.regexp_replace(text, "^\ufeff", "")


def remove_control_chars(text) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


# ---------------------------------------------------------------- hashes, ids, labels


def sha256(text) -> Column:
    return F.sha2(text, 256)


def document_id(given, text) -> Column:
    """The given id, or one made from the text's hash."""
    return F.coalesce(given, F.concat(F.lit("doc-"), F.substring(sha256(text), 1, 16)))


#: Fixed forms of ids, and words that stand for something yet to come.
PACK_ID = r"^\d{4}-\d{2}-\d{2}--[a-z0-9]+(?:-[a-z0-9]+)*--[0-9a-f]{8}$"
CASE_ID = r"^[a-z0-9]+(?:-[a-z0-9]+)*--[a-z0-9]+(?:-[a-z0-9]+)*--[0-9]+--[0-9a-f]{8}$"
PLACEHOLDER = r"(?i)\b(?:pr[-_ ]?\d+|todo|tbd|wip)\b"


def is_pack_id(x) -> Column:
    return F.regexp_like(x, F.lit(PACK_ID.replace("$", r"\z")))


def is_case_id(x) -> Column:
    return F.regexp_like(x, F.lit(CASE_ID.replace("$", r"\z")))


def has_placeholder(x) -> Column:
    return F.regexp_like(x, F.lit(PLACEHOLDER))


def format_controls(x) -> Column:
    """All Unicode format controls (category Cf) of a text."""
    return F.regexp_extract_all(x, F.lit(r"\p{Cf}"), F.lit(0))


#: Code points that have names in reports; fixed values.
NAMED_CONTROLS = (0xAD, 0x61C, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF)


def first_format_control(x) -> Column:
    """struct(char, code_point, name) of the first format control of a text; null without one."""
    x = F.col(x) if isinstance(x, str) else x
    hit = F.get(format_controls(x), F.lit(0))
    code = code_point(hit)
    names = F.create_map(*(v for c in NAMED_CONTROLS for v in (F.lit(c), F.lit(unicodedata.name(chr(c))))))
    return F.when(hit.isNotNull(), F.struct(hit.alias("char"), code.alias("code_point"), F.coalesce(F.try_element_at(names, code), F.format_string("U+%04X", code)).alias("name")))


#: Code points refused in data files, fixed values.
FORBIDDEN = r"[\x{200B}-\x{200D}\x{2028}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"


def code_point(char) -> Column:
    """The number of a text's first character."""
    return F.conv(F.hex(F.encode(F.left(char, F.lit(1)), "UTF-32")), 16, 10).cast("int")


def forbidden_rows(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, nth (from 0), char, code_point, byte_offset: a row for each refused character of each row's text.

    ``keys`` name a row.  The text is cut behind each hit, the pieces become rows of their own, and a
    hit's place is the running sum of the pieces' octets: as much work as the text is long, however many hits it
    has.  A null text has none."""
    cut = F.split(F.col(text), f"(?<={FORBIDDEN})")
    pieces = rows.select(*keys, F.posexplode(cut).alias("nth", "piece"))
    upto = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    char = F.right("piece", F.lit(1))
    ended = pieces.select(*keys, "nth", char.alias("char"), F.sum(F.octet_length("piece")).over(upto).alias("upto"))
    hits = ended.filter(F.regexp_like("char", F.lit(FORBIDDEN)))
    return hits.select(*keys, "nth", "char", code_point(F.col("char")).alias("code_point"), (F.col("upto") - F.octet_length("char")).alias("byte_offset"))


def escape_html(x) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def spaced(marker: str) -> str:
    return " ".join(marker)


def neutralise(text, markers=(DOC_START, DOC_END)) -> Column:
    """Markers inside untrusted text, spaced out so that they delimit nothing."""
    for m in markers:
        text = F.replace(text, F.lit(m), F.lit(spaced(m)))
    return text


def http_kind(status) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return F.when((status == 408) | (status == 429) | (status >= 500), "transient").otherwise("permanent")


# ---------------------------------------------------------------- retry arithmetic


def backoff_ms(attempt, base: int, most: int) -> Column:
    attempt = F.col(attempt) if isinstance(attempt, str) else attempt
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))


def jitter_ms(backoff, ratio: float, random) -> Column:
    random = F.col(random) if isinstance(random, str) else random
    return F.floor(backoff * ratio * F.least(F.lit(1.0), F.greatest(F.lit(0.0), random)) + 0.5)


def delay_ms(attempt, random, base: int, most: int, ratio: float) -> Column:
    wait = backoff_ms(attempt, base, most)
    return wait + jitter_ms(wait, ratio, random)


def should_retry(attempt, attempts: int, transient) -> Column:
    return (F.col(attempt) < attempts) & F.col(transient)


def suite_key(cls, start, end, quote) -> Column:
    return F.concat_ws("|", cls, start.cast("string"), end.cast("string"), quote)


def gold_key(cls, quote, start, end) -> Column:
    return F.concat_ws("|", cls, quote, start.cast("string"), end.cast("string"))


# ---------------------------------------------------------------- a seeded generator, in SQL


def prng_draws(seed, n: int) -> Column:
    """The first n draws (uint32 as BIGINT) of xorshift32 seeded with the FNV-1a hash of a string's UTF-16
    units, as one fold over the units and one over the draws."""
    seed = F.col(seed) if isinstance(seed, str) else seed
    mask = F.lit(0xFFFFFFFF).cast("long")
    units = F.regexp_extract_all(F.hex(F.encode(seed, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    fnv = F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * F.lit(0x01000193).cast("long") % F.lit(1 << 32).cast("long"))
    start = F.when(fnv == 0, F.lit(0x6D2B79F5).cast("long")).otherwise(fnv)

    def draw(x):
        x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(mask)
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
        return x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(mask)

    zero = F.struct(start.alias("x"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), zero, lambda s, _: F.struct(draw(s["x"]).alias("x"), F.concat(s["out"], F.array(draw(s["x"]))).alias("out")), lambda s: s["out"])
