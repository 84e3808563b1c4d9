"""From a raw reply to checked extractions: envelopes, spans, quotes, and what went wrong."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

from . import frames, js, salvage
from .lazy import column_function
from .salvage import Budget

MAX_DEPTH = 3

#: Failure kinds, fixed names.
PROVIDER, PIPELINE, SHAPE, QUOTE, BUDGET, UNKNOWN = "provider_error", "json_pipeline_failure", "payload_shape_failure", "quote_invariant_failure", "budget_exhausted", "unknown_failure"
REPAIRABLE = (PIPELINE, SHAPE, QUOTE)


class Failure(Exception):
    """A reply that yields no extractions."""

    def __init__(self, kind: str, message: str, code: str | None = None, log: dict | None = None, error: dict | None = None):
        super().__init__(message)
        self.kind, self.message, self.code, self.log, self.error = kind, message, code, log, error


def _shape(message: str) -> Failure:
    return Failure(SHAPE, message, "schema_validation_failed")


def _argument_text(value) -> str | None:
    if isinstance(value, str):
        return value if js.trim(value) else None
    return js.dumps(value) if isinstance(value, (dict, list)) else None


def _texts(value) -> str:
    if isinstance(value, str):
        return value
    parts = (p if isinstance(p, str) else js.get(p, "text") for p in frames._list(value))
    return "\n".join(p for p in parts if isinstance(p, str) and p)


def nested(payload: dict) -> tuple[list[str], list[str]]:
    """Texts within a reply's envelope that may hold the payload: tool-call arguments, and plain
    texts, each in reading order."""
    calls: list[str] = []
    texts: list[str] = []

    def tool_calls(message):
        for call in frames._list(js.get(message, "tool_calls")):
            if (a := _argument_text(js.get(js.get(call, "function"), "arguments"))) is not None:
                calls.append(a)

    for choice in frames._list(js.get(payload, "choices")):
        message = js.get(choice, "message")
        tool_calls(message)
        if text := _texts(js.get(message, "content")):
            texts.append(text)
    for option in frames._list(js.get(payload, "candidates")):
        parts = frames._list(js.get(js.get(option, "content"), "parts"))
        calls += [a for p in parts if (a := _argument_text(js.get(js.get(p, "functionCall"), "args"))) is not None]
        if told := [t for p in parts if isinstance(t := js.get(p, "text"), str) and t]:
            texts.append("\n".join(told))
    message = js.get(payload, "message")
    tool_calls(message)
    if isinstance(content := js.get(message, "content"), str) and content:
        texts.append(content)
    own = js.get(payload, "arguments")
    if isinstance(own, str) and own:
        calls.append(own)
    elif isinstance(own, (dict, list)):
        calls.append(js.dumps(own))
    texts += [t for k in ("content", "text") if isinstance(t := js.get(payload, k), str) and t]
    return calls, texts


def extractions_of(payload, depth: int, budget: Budget) -> list:
    """The list of raw extractions of a parsed reply.

    A list is taken as it is; so is a list named ``extractions``.  Else nested texts are read, tool
    calls first.  One nested text may fail; a second failure ends the search, as does any failure
    that is neither of shape nor of parsing."""
    if depth > MAX_DEPTH:
        raise _shape("Provider response nesting exceeded maximum extraction envelope depth.")
    if isinstance(payload, list):
        return payload
    if isinstance(payload, dict):
        if isinstance(own := js.get(payload, "extractions"), list):
            return own
        failed = None
        calls, texts = nested(payload)
        for label, text in [(f"Tool-call payload {i}", t) for i, t in enumerate(calls, 1)] + [(f"Text payload {i}", t) for i, t in enumerate(texts, 1)]:
            try:
                return read_reply(text, label, depth, budget)[0]
            except Failure as e:
                if failed:
                    raise
                failed = e
        if failed:
            raise failed
    raise _shape("Provider response must be an array or object with `extractions` array.")


def read_reply(source: str, label: str = "Provider response", depth: int = 0, budget: Budget = Budget()) -> tuple[list, dict]:
    """Raw extractions and the log of the slice that gave them: the first slice that does.  If none
    does, the first failure of shape is raised, else the first failure of parsing."""
    decoded = frames.decode(source)
    if not decoded.ok:
        error = salvage.parse_error("stream_frame_malformed", decoded.message, source, snippet=decoded.snippet)
        log = {"extracted": salvage.extracted(source, None, ""), "repair": salvage.Repair("", budget=budget).log()}
        raise Failure(PIPELINE, decoded.message, "stream_frame_malformed", log, error)
    text = decoded.text
    failed: dict[str, Failure] = {}
    for found in salvage.candidates(text) or [None]:
        piece = found.text if found else text
        parsed = salvage.parse_with_repair(piece, budget)
        log = parsed.log | {"extracted": salvage.extracted(text, found, piece)}
        if not parsed.ok:
            code = parsed.error["failure_code"] if found else "json_payload_missing"
            failed.setdefault(PIPELINE, Failure(PIPELINE, parsed.error["message"], code, log, parsed.error | {"failure_code": code, "input_length": js.u16_len(text)}))
            continue
        try:
            return extractions_of(parsed.value, depth + 1, budget), log
        except Failure as e:
            failed.setdefault(e.kind, e)
    raise failed.get(SHAPE) or failed[PIPELINE]


# ---------------------------------------------------------------- spans and quotes


@dataclass
class Extraction:
    extraction_class: object
    quote: object
    offset_mode: object
    char_start: int
    char_end: int
    grounding: object
    attributes: object = js.MISSING

    def row(self) -> dict:
        return {
            "extraction_class": self.extraction_class if isinstance(self.extraction_class, str) else None, "quote": self.quote, "offset_mode": self.offset_mode,
            "char_start": self.char_start, "char_end": self.char_end, "grounding": self.grounding if isinstance(self.grounding, str) else js.dumps(self.grounding),
            "attributes_json": None if self.attributes is js.MISSING else js.stable_units(self.attributes),
        }


def resolve_span(raw) -> tuple[object, int, int]:
    """Offset mode, start and end of a raw extraction: its own fields before those of ``span``."""
    if raw is None:
        raise Failure(UNKNOWN, "An extraction is null.")
    top = {k: js.get(raw, k) for k in ("offsetMode", "charStart", "charEnd")}
    span = js.get(raw, "span")
    inner = {k: js.get(span, k) for k in top}
    mode = js.first_given(top["offsetMode"], inner["offsetMode"], "utf16_code_unit")
    start, end = (js.first_given(top[k], inner[k]) for k in ("charStart", "charEnd"))
    if not js.is_integer(start) or not js.is_integer(end):
        raise _shape("Each extraction must include integer charStart/charEnd offsets.")
    given = any(v is not js.MISSING for v in top.values())
    if given and span is not js.MISSING:
        if span is None:
            raise Failure(UNKNOWN, "span is null.")
        if any(inner[k] is not js.MISSING and not _same(inner[k], v) for k, v in (("offsetMode", mode), ("charStart", start), ("charEnd", end))):
            raise _shape("Extraction offset fields must match between top-level and span.")
    return mode, int(start), int(end)


def _same(a, b) -> bool:
    return type(a) is type(b) and a == b or all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)) and a == b


def to_document(start: int, end: int, shard_start: int, shard_end: int) -> tuple[int, int]:
    if start < 0 or end < 0:
        raise Failure(UNKNOWN, "a bound is negative")
    if start > end:
        raise Failure(UNKNOWN, "the bounds are out of order")
    if end > shard_end - shard_start:
        raise Failure(UNKNOWN, "the span exceeds its shard")
    return shard_start + start, shard_start + end


def check_quote(text: str, e: Extraction) -> None:
    if e.offset_mode != "utf16_code_unit":
        raise Failure(QUOTE, "offsets of another kind", "UNSUPPORTED_OFFSET_MODE")
    if e.char_start < 0 or e.char_end > js.u16_len(text):
        raise Failure(QUOTE, "the offsets leave the document", "OFFSETS_OUT_OF_RANGE")
    if js.u16_slice(text, e.char_start, e.char_end) != e.quote:
        raise Failure(QUOTE, "the document reads otherwise there", "QUOTE_MISMATCH")


def ground(raws: list, text: str, shard_start: int, shard_end: int, text_start: int = 0) -> list[Extraction]:
    """Checked extractions in document offsets.  ``text`` begins at ``text_start`` of the document,
    so that a shard's text suffices: a span never leaves its shard."""
    out = []
    for raw in raws:
        mode, start, end = resolve_span(raw)
        start, end = to_document(start, end, shard_start, shard_end)
        e = Extraction(js.get(raw, "extractionClass"), js.get(raw, "quote"), mode, start, end, js.first_given(js.get(raw, "grounding"), "explicit"), js.get(raw, "attributes"))
        check_quote(text, Extraction(None, e.quote, mode, start - text_start, end - text_start, None))
        out.append(e)
    return out


# ---------------------------------------------------------------- as columns

LOG = "struct<found:boolean,start:int,end:int,kind:string,source_length:int,candidate_length:int,applied:array<string>,changed:boolean,candidate_truncated:boolean,repair_truncated:boolean>"
REPLY = f"struct<ok:boolean,failure_kind:string,failure_code:string,message:string,n:int,raw_json:string,log:{LOG}>"


def flat_log(log: dict | None) -> dict | None:
    if log is None:
        return None
    r = log["repair"]
    return log["extracted"] | {"applied": [s["step"] for s in r["steps"] if s["applied"]], "changed": r["changed"], "candidate_truncated": r["candidate_truncated"], "repair_truncated": r["repair_truncated"]}


def reply_udf(budget: Budget = Budget()):
    """Column function: a raw reply to a REPLY struct.  Failures are values, never errors."""

    @F.pandas_udf(REPLY)
    def read(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            try:
                raws, log = read_reply(t or "", budget=budget)
                rows.append((True, None, None, None, len(raws), js.dumps(raws), flat_log(log)))
            except Failure as e:
                rows.append((False, e.kind, e.code, e.message, 0, None, flat_log(e.log)))
        return pd.DataFrame(rows, columns=["ok", "failure_kind", "failure_code", "message", "n", "raw_json", "log"])

    return read


def repair_udf(budget: Budget = Budget()):
    step = "struct<step:string,applied:boolean,before_length:int,after_length:int>"

    @F.pandas_udf(f"struct<text:string,changed:boolean,candidate_truncated:boolean,repair_truncated:boolean,steps:array<{step}>>")
    def mend(text: pd.Series) -> pd.DataFrame:
        done = [salvage.repair(t or "", budget) for t in text]
        return pd.DataFrame({"text": [r.text for r in done], "changed": [r.changed for r in done], "candidate_truncated": [r.candidate_truncated for r in done], "repair_truncated": [r.repair_truncated for r in done], "steps": [r.steps for r in done]})

    return mend


@column_function("array<struct<start:int,end:int,text:string,kind:string>>")
def json_candidates(text: pd.Series) -> pd.Series:
    return pd.Series([[vars(s) for s in salvage.candidates(t or "")] for t in text])


@column_function("string")
def json_flavor(text: pd.Series) -> pd.Series:
    return text.map(lambda t: salvage.flavor(t or ""))


@column_function("struct<ok:boolean,failure_code:string>")
def json_strict(text: pd.Series) -> pd.DataFrame:
    done = [salvage.parse_strict(t or "") for t in text]
    return pd.DataFrame({"ok": [d[0] for d in done], "failure_code": [d[2] and d[2]["failure_code"] for d in done]})


@column_function("struct<ok:boolean,used_frames:boolean,text:string,line:int,message:string>")
def decode_frames(text: pd.Series) -> pd.DataFrame:
    done = [frames.decode(t or "") for t in text]
    return pd.DataFrame({k: [getattr(d, k) for d in done] for k in ("ok", "used_frames", "text", "line", "message")})


@column_function("string")
def stable_json(text: pd.Series) -> pd.Series:
    """Canonical form of a JSON text: keys in UTF-16 order; null if it is none."""

    def one(t):
        ok, value, _ = salvage.parse_strict(t or "")
        return js.stable_units(value) if ok else None

    return text.map(one)
