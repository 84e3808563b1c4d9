"""Canonical bundles, signatures over them, and their verification."""

from __future__ import annotations

import base64
import hashlib
import hmac
import math
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import js

VERSION, CANONICAL, ALGORITHM = "1", "lodestar-json-c14n-v1", "HMAC-SHA-256"


def canonical(bundle: dict) -> str:
    """The bundle without its attestation, absent members left out, keys in a fixed order."""

    def clean(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if x is not js.MISSING}
        if isinstance(v, list):
            return [clean(x) for x in v]
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("non-finite numbers have no canonical form")
        if v is not None and not isinstance(v, (str, int, float, bool)):
            raise ValueError(f"no canonical form for {type(v).__name__}")
        return v

    return js.stable(clean({k: v for k, v in bundle.items() if k != "attestation"}))


def _key(jwk: dict) -> bytes:
    if jwk.get("kty") != "oct":
        raise ValueError("the key must be symmetric (kty=oct)")
    return _decoded(jwk["k"])


def _encoded(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def _decoded(text: str) -> bytes:
    return base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4), validate=True)


def attest(bundle: dict, key: dict, key_id: str | None = None, signed_at: str | None = None) -> dict:
    payload = canonical(bundle).encode("utf-8", "replace")
    bare = {k: v for k, v in bundle.items() if k != "attestation"}
    return bare | {
        "attestation": {
            "version": VERSION, "canonicalization": CANONICAL, "algorithm": ALGORITHM, "keyId": key_id, "payloadHash": hashlib.sha256(payload).hexdigest(),
            "signature": _encoded(hmac.digest(_key(key), payload, "sha256")), "signedAt": signed_at or datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z"),
        }
    }


def verify(bundle: dict, key: dict) -> dict:
    """valid, reason (the first check that fails), key_id, payload_hash."""
    a = bundle.get("attestation")
    if not a:
        return {"valid": False, "reason": "missing_attestation", "key_id": None, "payload_hash": None}
    out = {"valid": False, "reason": None, "key_id": a.get("keyId"), "payload_hash": a.get("payloadHash")}
    for member, wanted, reason in (("version", VERSION, "unsupported_attestation_version"), ("canonicalization", CANONICAL, "unsupported_canonicalization"), ("algorithm", ALGORITHM, "unsupported_algorithm")):
        if a.get(member) != wanted:
            return out | {"reason": reason}
    payload = canonical(bundle).encode("utf-8", "replace")
    out["payload_hash"] = hashlib.sha256(payload).hexdigest()
    if out["payload_hash"] != a.get("payloadHash"):
        return out | {"reason": "payload_hash_mismatch"}
    if not hmac.compare_digest(hmac.digest(_key(key), payload, "sha256"), _decoded(a["signature"])):
        return out | {"reason": "invalid_signature"}
    return out | {"valid": True}


def attest_udf(key: dict, key_id: str | None, signed_at: str):
    """Column function: a bundle as JSON to the signed bundle as JSON."""

    @F.pandas_udf("string")
    def sign(bundle: pd.Series) -> pd.Series:
        return bundle.map(lambda b: js.dumps(attest(js.loads(b), key, key_id, signed_at)))

    return sign


def verify_udf(key: dict):
    @F.pandas_udf("struct<valid:boolean,reason:string,key_id:string,payload_hash:string>")
    def check(bundle: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verify(js.loads(b), key) for b in bundle], columns=["valid", "reason", "key_id", "payload_hash"])

    return check


def hmac_sha256(key: bytes, message) -> Column:
    """HMAC-SHA-256 of a string column as base64url, from built-in functions alone."""
    message = F.col(message) if isinstance(message, str) else message
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256))
    return F.rtrim(F.translate(F.base64(digest), "+/\r\n", "-_"), F.lit("="))
