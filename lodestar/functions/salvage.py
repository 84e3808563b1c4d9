"""Finding, mending and reading JSON in untrusted text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import js

#: A string literal, closed or running on to the text's end; or a bracket.
_STRING = r'"(?:[^"\\]|\\[\s\S])*+'
_TOKEN = re.compile(rf'({_STRING})("?)|[{{}}\[\]]')
_CLOSED_BY = {"{": "}", "[": "]"}


@dataclass(frozen=True)
class Slice:
    """A balanced piece of text; start and end count UTF-16 code units."""

    start: int
    end: int
    text: str
    kind: str


def _balanced_end(text: str, start: int) -> int | None:
    """Where the bracket at ``start`` is closed, or None if another one is in the way."""
    wanted = []
    for token in _TOKEN.finditer(text, start):
        what = token[0]
        if token[1]:
            if not token[2]:
                return None  # the string never ends
        elif what in _CLOSED_BY:
            wanted.append(_CLOSED_BY[what])
        elif wanted.pop() != what:
            return None
        elif not wanted:
            return token.end()
    return None


_OPENING = re.compile(r"[{\[]")


def candidates(text: str, most: float | None = None) -> list[Slice]:
    """Balanced slices from left to right, none within another.  An opening that isn't closed
    properly is passed over.  Quadratic at worst; cap the text where that matters."""
    found: list[Slice] = []
    if most is not None and not most > 0:
        return found
    ascii_only, at = text.isascii(), 0
    while (most is None or len(found) < most) and (m := _OPENING.search(text, at)):
        end = _balanced_end(text, m.start())
        at = m.start() + 1
        if end is not None:
            piece = text[m.start() : end]
            a = m.start() if ascii_only else js.u16_len(text[: m.start()])
            found.append(Slice(a, a + js.u16_len(piece), piece, "object" if m[0] == "{" else "array"))
            at = end
    return found


def first(text: str) -> Slice | None:
    return next(iter(candidates(text, 1)), None)


def _reads(text: str) -> bool:
    try:
        js.loads(text)
    except ValueError:
        return False
    return True


def flavor(text: str) -> str:
    """json, jsonl (two lines or more, each of them JSON) or unknown."""
    text = js.trim(text)
    if not text:
        return "unknown"
    if _reads(text):
        return "json"
    lines = [x for x in map(js.trim, re.split(r"\r?\n", text)) if x]
    return "jsonl" if len(lines) > 1 and all(map(_reads, lines)) else "unknown"


# ---------------------------------------------------------------- repair

_LITERAL = re.compile(rf'{_STRING}(?:"|\\?\Z)')
_ESCAPE = re.compile(r'\\(?:(["\\/bfnrt]|u(?=[0-9a-fA-F]{4}))|([\s\S])|\Z)')
_COMMA = re.compile(rf'{_STRING}(?:"|\\?\Z)|,(?=[{re.escape(js.SPACE)}]*[\]}}])')
_TRAILING = re.compile(rf",[{re.escape(js.SPACE)}]*[\]}}]")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def fix_escapes(text: str) -> str:
    """Within strings, drops the backslash of escapes that JSON lacks."""
    if "\\" not in text:
        return text
    return _LITERAL.sub(lambda s: _ESCAPE.sub(lambda e: e[0] if e[1] else e[2] or "", s[0]), text)


def drop_trailing_commas(text: str) -> str:
    if not _TRAILING.search(text):
        return text
    return _COMMA.sub(lambda m: "" if m[0] == "," else m[0], text)


def trim_outer(text: str) -> str:
    found = first(text)
    return found.text if found else js.trim(text)


#: Fixed names, in the order in which the steps run.
STEPS = (
    ("stripBOM", lambda t: t.removeprefix("\ufeff")),
    ("removeAsciiControlChars", lambda t: _CONTROL.sub("", t)),
    ("fixInvalidEscapes", fix_escapes),
    ("trimOuterJunk", trim_outer),
    ("fixTrailingCommas", drop_trailing_commas),
)


@dataclass(frozen=True)
class Budget:
    """Most characters of a candidate before repair, and of the text after it."""

    candidate: int | None = None
    repair: int | None = None

    def __post_init__(self):
        for x in (self.candidate, self.repair):
            if x is not None and (not isinstance(x, int) or isinstance(x, bool) or x <= 0):
                raise ValueError("repair budgets are positive integers")


@dataclass
class Repair:
    text: str
    steps: list[dict] = field(default_factory=list)
    changed: bool = False
    candidate_truncated: bool = False
    repair_truncated: bool = False
    budget: Budget = Budget()

    def log(self) -> dict:
        return {
            "steps": self.steps, "changed": self.changed, "max_candidate_chars": self.budget.candidate, "max_repair_chars": self.budget.repair,
            "candidate_truncated": self.candidate_truncated, "repair_truncated": self.repair_truncated,
        }


def _capped(text: str, most: int | None) -> tuple[str, bool]:
    over = most is not None and js.u16_len(text) > most
    return (js.u16_slice(text, 0, most) if over else text), over


def repair(text: str, budget: Budget = Budget()) -> Repair:
    text, cut = _capped(text, budget.candidate)
    steps = []
    for name, step in STEPS:
        after = step(text)
        steps.append({"step": name, "applied": after != text, "before_length": js.u16_len(text), "after_length": js.u16_len(after)})
        text = after
    text, cut_after = _capped(text, budget.repair)
    return Repair(text, steps, cut or cut_after or any(s["applied"] for s in steps), cut, cut_after, budget)


# ---------------------------------------------------------------- strict reading


def parse_error(code: str, message: str, text: str, position: int | None = None, line: int | None = None, snippet: str | None = None) -> dict:
    if snippet is None:
        snippet = text[:80] if position is None else text[max(0, position - 20) : position + 20]
    return {"failure_code": code, "message": message, "position": position, "line": line, "column": None, "snippet": snippet, "input_length": js.u16_len(text)}


def parse_strict(text: str) -> tuple[bool, object, dict | None]:
    """ok, value, error.  Messages and positions are our reader's own."""
    try:
        return True, js.loads(text), None
    except ValueError as e:
        at = getattr(e, "pos", None)
        return False, None, parse_error("json_parse_failed", str(e), text, at, getattr(e, "lineno", None)) | {"column": getattr(e, "colno", None)}


def extracted(source: str, found: Slice | None, candidate: str) -> dict:
    return {
        "found": found is not None, "start": found.start if found else None, "end": found.end if found else None, "kind": found.kind if found else None,
        "source_length": js.u16_len(source), "candidate_length": js.u16_len(candidate),
    }


@dataclass
class Parsed:
    ok: bool
    value: object
    error: dict | None
    log: dict


def parse_with_repair(source: str, budget: Budget = Budget()) -> Parsed:
    """Frames, then the first slice, then repair, then a strict reading."""
    from . import frames

    decoded = frames.decode(source)
    if not decoded.ok:
        error = parse_error("stream_frame_malformed", decoded.message, source, line=decoded.line, snippet=decoded.snippet)
        return Parsed(False, None, error, {"extracted": extracted(source, None, ""), "repair": repair("", budget).log()})
    found = first(decoded.text)
    candidate = found.text if found else decoded.text
    mended = repair(candidate, budget)
    ok, value, error = parse_strict(mended.text)
    return Parsed(ok, value, error, {"extracted": extracted(source, found, candidate), "repair": mended.log()})
