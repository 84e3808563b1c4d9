"""How JSON values are read and written by the tools whose replies are salvaged here."""

from __future__ import annotations

import json
import math
import re
from json.encoder import encode_basestring
from typing import Any

#: White space of that family of languages: more than ASCII, and not the C0 separators.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(text: str) -> str:
    return text.strip(SPACE)


def u16_len(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def u16_slice(text: str, start: int, end: int | None = None) -> str:
    if text.isascii():
        return text[start:end]
    return text.encode("utf-16-le", "surrogatepass")[2 * start : None if end is None else 2 * end].decode("utf-16-le", "surrogatepass")


class Missing:
    """An absent property, which is not null."""

    def __bool__(self):
        return False


MISSING = Missing()


def get(value: Any, name: str) -> Any:
    """A property of an object; absent for anything else."""
    return value.get(name, MISSING) if isinstance(value, dict) else MISSING


def first_given(*values: Any) -> Any:
    """The first value that is neither absent nor null."""
    return next((v for v in values if v is not None and v is not MISSING), MISSING)


def is_integer(value: Any) -> bool:
    return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _integer(digits: str):
    return int(digits) if len(digits) < 300 else float(digits)


_DECODER = json.JSONDecoder(parse_constant=_constant, parse_int=_integer)


def loads(text: str) -> Any:
    """Strict JSON; of repeated keys the last counts.  Raises ValueError."""
    try:
        if not isinstance(text, str) or text.startswith("\ufeff"):
            return json.loads(text, parse_constant=_constant, parse_int=_integer)
        return _DECODER.decode(text)  # made once: it costs more than a short text
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def number(x: int | float) -> str:
    if isinstance(x, int) and abs(x) < 1 << 53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exponent = ("-" if x < 0 else ""), *_shortest(abs(x))
    n = len(digits)
    if n <= exponent <= 21:
        return sign + digits + "0" * (exponent - n)
    if 0 < exponent <= 21:
        return sign + digits[:exponent] + "." + digits[exponent:]
    if -6 < exponent <= 0:
        return sign + "0." + "0" * -exponent + digits
    power = f"e{'+' if exponent > 0 else '-'}{abs(exponent - 1)}"
    return sign + digits[0] + ("." + digits[1:] if n > 1 else "") + power


def _shortest(x: float) -> tuple[str, int]:
    """Shortest digits that read back as x, and where the decimal point stands."""
    mantissa, _, power = repr(x).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(power or 0)
    if whole.strip("0") == "":
        point = int(power or 0) - (len(part) - len(part.lstrip("0")))
    return digits.rstrip("0") or "0", point


_LONE = re.compile("[\ud800-\udfff]")


def string(x: str) -> str:
    quoted = encode_basestring(x)
    return quoted if x.isascii() else _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", quoted)


_INDEX = re.compile(r"0|[1-9][0-9]{0,9}\Z")


def own_order(keys) -> list[str]:
    """Keys as such an object lists them: array indices first, by size, then as inserted."""
    keys = list(keys)
    index = [k for k in keys if "0" <= k[:1] <= "9" and _INDEX.fullmatch(k) and int(k) < (1 << 32) - 1]
    return sorted(index, key=int) + [k for k in keys if k not in set(index)] if index else keys


def dumps(value: Any, order=own_order) -> str:
    """Compact JSON; ``order`` decides how keys follow each other."""
    if value is None or value is MISSING:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, str):
        return string(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(dumps(v, order) for v in value) + "]"
    return "{" + ",".join(f"{string(k)}:{dumps(value[k], order)}" for k in order(value)) + "}"


def locale_key(key: str):
    """Orders keys alphabetically with case as the second criterion (a A b B).  One fixed order
    for canonical forms; other alphabets fall back to code points."""
    return (key.casefold(), key.swapcase())


def stable(value: Any) -> str:
    """JSON with keys in the fixed order of :func:`locale_key`."""
    return dumps(value, lambda keys: sorted(keys, key=locale_key))


def stable_units(value: Any) -> str:
    """JSON with keys in UTF-16 order."""
    return dumps(value, lambda keys: sorted(keys, key=lambda k: k.encode("utf-16-be", "surrogatepass")))
