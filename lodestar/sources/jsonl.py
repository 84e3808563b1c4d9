"""JSON Lines: bundles and evaluation datasets.  Strict checks of files are in :mod:`.lines`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from .lines import numbered_lines


def read_bundles(spark: SparkSession, path: str, schema: str = schemas.BUNDLE) -> DataFrame:
    """One row for each line that isn't blank; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def stream_bundles(spark: SparkSession, path: str, schema: str = schemas.BUNDLE) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def encode(bundles: DataFrame) -> DataFrame:
    """value: one JSON object a row; absent members are left out."""
    return bundles.select(F.to_json(F.struct("*")).alias("value"))


def write_bundles(bundles: DataFrame, path: str) -> None:
    encode(bundles).write.text(path)


def read_smoke(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SMOKE).json(path)


# ---------------------------------------------------------------- datasets with rules

#: Fixed names of a regression record's members; the record is closed.
MEMBERS = ("caseId", "category", "documentText", "instructions", "targetSchema", "providerResponseText", "expected", "sourceUrl", "sourceQuote", "packId")
KINDS = ("non_empty", "empty_by_evidence", "empty_by_failure")
QUOTE_CHARS = 280


EXPECTED = ("emptyResultKind", "minExtractions", "maxExtractions")
#: A URL: of the schemes that need a host with one, of any other as it stands.
URL = r"(?i)^\s*(?:(?:https?|wss?|ftp):[/\\]*[^/\\?#\s]|(?!(?:https?|wss?|ftp):)[a-z][a-z0-9+.-]*:)"


#: What is looked at of a record, by path; each is read once.
_TEXTS = {m: f"$.{m}" for m in MEMBERS if m not in ("targetSchema", "expected")} | {EXPECTED[0]: f"$.expected.{EXPECTED[0]}"}
_OBJECTS = {"record": "$", "targetSchema": "$.targetSchema", "expected": "$.expected"}
_NUMBERS = {m: f"$.expected.{m}" for m in EXPECTED[1:]}


def _members(lines: DataFrame) -> DataFrame:
    """line and what the rules look at: texts (null if it is none), whether a member is an object, numbers, names of members.

    Each step reads columns of the one before, which Spark doesn't merge since they are used more than once:
    a rule is small.  The parsed line comes out of a generator, so that no filter is pushed below it: it would
    hold the line's own expression as often as it looks at a member."""
    part = lambda path: F.try_variant_get("v", path, "variant")
    parsed = lines.select("line", F.explode(F.array(F.try_parse_json("value"))).alias("v"))
    parts = parsed.select("line", *(part(path).alias(f"v_{m}") for m, path in (_TEXTS | _OBJECTS | _NUMBERS).items()))
    kinds = parts.select("*", *(F.coalesce(F.schema_of_variant(f"v_{m}"), F.lit("none")).alias(f"k_{m}") for m in _TEXTS | _OBJECTS | _NUMBERS))
    kind, value = (lambda m: F.col(f"k_{m}")), (lambda m, t: F.try_variant_get(f"v_{m}", "$", t))
    names = lambda m: F.when(kind(m).startswith("OBJECT"), F.map_keys(value(m, "map<string,variant>")))
    return kinds.select(
        "line", *(F.when(kind(m) == "STRING", value(m, "string")).alias(m) for m in _TEXTS), *(kind(m).startswith("OBJECT").alias(f"is_{m}") for m in _OBJECTS),
        *(F.when(kind(m).rlike("INT|^DECIMAL|^DOUBLE|^FLOAT"), value(m, "double")).alias(m) for m in _NUMBERS), names("record").alias("own"), names("expected").alias("within"),
    )


def check_regression(lines: DataFrame) -> DataFrame:
    """line, case_id, errors for each line (line, value): every rule is a column that looks at the JSON
    type of a member before its value; errors are in a fixed order, and a line that is no JSON object
    has that error alone.  A case id is used before if a line of smaller number has it."""
    own, within = F.col("own"), F.col("within")
    has = lambda m: F.array_contains(own, m)
    missing = lambda have, m, label: F.when(~F.array_contains(have, m), f"{label} is missing")

    def strange(have, known, label):
        more = F.sort_array(F.array_except(have, F.array(*map(F.lit, known))))
        return F.when(F.size(more) > 0, F.concat(F.lit(label), F.array_join(more, ", ")))

    def filled(m):
        return F.when(has(m) & F.coalesce(F.col(m) == "", F.lit(True)), f"{m} is no text")

    def named(m, form):
        x = F.col(m)
        return [filled(m), F.when((x != "") & ~form(x), f"{m} has a wrong form"), F.when(form(x) & text.has_placeholder(x), f"{m} holds a placeholder")]

    def count(k):
        x = F.col(k)
        return F.when(F.array_contains(within, k) & ~F.coalesce((x >= 0) & (x == F.floor(x)), F.lit(False)), f"expected.{k} is no count")

    low, high = map(F.col, EXPECTED[1:])
    rules = [
        *(missing(own, m, m) for m in MEMBERS),
        strange(own, MEMBERS, "unknown members: "),
        *named("caseId", text.is_case_id),
        filled("category"),
        *(F.when(has(m) & F.col(m).isNull(), f"{m} is no string") for m in ("documentText", "instructions", "providerResponseText")),
        F.when(has("targetSchema") & ~F.col("is_targetSchema"), "targetSchema is no object"),
        F.when(has("sourceUrl") & ~F.coalesce(F.col("sourceUrl").rlike(URL), F.lit(False)), "sourceUrl is no URL"),
        filled("sourceQuote"),
        F.when(text.u16_len("sourceQuote") > QUOTE_CHARS, f"sourceQuote has more than {QUOTE_CHARS} characters"),
        *named("packId", text.is_pack_id),
        F.when(has("expected") & ~F.col("is_expected"), "expected is no object"),
        *(missing(within, k, f"expected.{k}") for k in EXPECTED),
        strange(within, EXPECTED, "unknown members of expected: "),
        F.when(F.array_contains(within, EXPECTED[0]) & ~F.coalesce(F.col(EXPECTED[0]).isin(*KINDS), F.lit(False)), "expected.emptyResultKind is unknown"),
        *map(count, EXPECTED[1:]),
        F.when((low >= 0) & (high >= 0) & (low > high), "expected bounds are out of order"),
    ]
    # no two rules say the same; functions with lambdas would leave compiled code, and are compared anew at each depth
    broken = F.array_except(F.array(*rules), F.array(F.lit(None).cast("string")))
    rows = _members(lines).select("line", F.col("caseId").alias("case_id"), F.col("is_record").alias("is_object"), broken.alias("broken"))
    first = rows.filter("case_id IS NOT NULL").groupBy("case_id").agg(F.min("line").alias("first"))
    rows = rows.join(first, "case_id", "left")
    again = F.when(F.col("line") > F.col("first"), F.array(F.lit("caseId is used before"))).otherwise(F.array().cast("array<string>"))
    errors = F.when(F.col("is_object"), F.concat("broken", again)).otherwise(F.array(F.lit("not a JSON object")))
    return rows.select("line", "case_id", errors.alias("errors"))


def read_regression(spark: SparkSession, path: str) -> DataFrame:
    """The dataset, after all its lines have been checked; raises with what is wrong."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    bad = check_regression(lines).filter(F.size("errors") > 0).orderBy("line").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"line {r.line}: {', '.join(r.errors)}" for r in bad))
    return spark.read.schema(schemas.REGRESSION).json(path)


def of_pack(records: DataFrame, pack_id: str) -> DataFrame:
    """The records (packId, ...) of one pack; raises if the name is none that a pack may have."""
    if not re.fullmatch(text.PACK_ID.replace("$", ""), pack_id):
        raise ValueError(f"{pack_id!r} is no pack id")
    return records.filter(F.col("packId") == pack_id)
