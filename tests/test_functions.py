"""Pure functions against given vectors and a plain model."""

import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.functions import attest, envelope, frames, js, salvage, schema
from lodestar.functions import text as T
from lodestar.functions.salvage import Budget
from lodestar.program import ProgramError, normalize_program, repair_text


@pytest.mark.parametrize("x, want", [(1.0, "1"), (0.1, "0.1"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1.5e-7, "1.5e-7"), (123456.789, "123456.789"), (1e-6, "0.000001"), (-2.5, "-2.5"), (5e-324, "5e-324"), (12345678901234567890, "12345678901234567000")])
def test_numbers(x, want):
    assert js.number(x) == want


def test_candidates():
    assert salvage.first('header text\n{"ok": true,}\ntrailing notes').text == '{"ok": true,}'
    assert [(s.start, s.end, s.kind) for s in salvage.candidates('a{"x":"}"}b[1,[2]] {"open"')] == [(1, 10, "object"), (11, 18, "array")]
    assert salvage.candidates("{]{}")[0].text == "{}"
    assert salvage.candidates("😀{}")[0].start == 2
    assert salvage.candidates("{}{}", 0) == []


def model_candidates(text):
    """Character by character, as a reader would do it by hand."""
    out, i = [], 0
    while i < len(text):
        if text[i] in "{[":
            stack, quoted, skip, end = [], False, False, None
            for j in range(i, len(text)):
                c = text[j]
                if quoted:
                    quoted, skip = (True, False) if skip else (c != '"', c == "\\")
                elif c == '"':
                    quoted = True
                elif c in "{[":
                    stack.append("}" if c == "{" else "]")
                elif c in "}]":
                    if stack.pop() != c:
                        break
                    if not stack:
                        end = j + 1
                        break
            if end:
                out.append((i, end))
                i = end
                continue
        i += 1
    return out


def test_candidates_like_model():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice('{}[]"\\a,') for _ in range(rng.randrange(14)))
        assert [(s.start, s.end) for s in salvage.candidates(text)] == model_candidates(text), text


def test_flavor():
    assert [salvage.flavor(t) for t in ('{"alpha":1,"beta":[2,3]}', '{"line":1}\n{"line":2}', "not json", "  ", '{"a":1}\nx')] == ["json", "jsonl", "unknown", "unknown", "unknown"]


def test_repair():
    r = salvage.repair('{"value":"a\u0001b"}')
    assert r.text == '{"value":"ab"}' and [s["step"] for s in r.steps if s["applied"]] == ["removeAsciiControlChars"]
    assert salvage.repair('\ufeffok: {"a":[1,2,],} end').text == '{"a":[1,2]}'
    assert salvage.repair(r'{"a":"won\'t \u12G4 \u0041 \n"}').text == r'{"a":"won' + "'t u12G4 " + r'\u0041 \n"}'
    assert salvage.fix_escapes('"abc\\') == '"abc'
    assert salvage.drop_trailing_commas('{"a":",]",}') == '{"a":",]"}'
    cut = salvage.parse_with_repair('{"key": "some value that is long", }', Budget(repair=12))
    assert not cut.ok and cut.log["repair"]["repair_truncated"] and not cut.log["repair"]["candidate_truncated"]
    with pytest.raises(ValueError):
        Budget(0)


def test_strict():
    assert not salvage.parse_strict("NaN")[0] and not salvage.parse_strict("{'a':1}")[0] and not salvage.parse_strict('{"a":1} x')[0]
    assert salvage.parse_strict('{"a":1,"a":2}')[1] == {"a": 2}


def test_frames():
    line = "data: " + json.dumps({"choices": [{"delta": {"content": "he"}}]})
    assert frames.decode(f"event: x\n{line}\n{line}\ndata: [DONE]").text == "hehe"
    assert frames.decode("plain").text == "plain" and not frames.decode("plain").used_frames
    broken = frames.decode(f'{line}\n\ndata: {{"choices":[{{"delta":')
    assert not broken.ok and broken.line == 3 and broken.message == "Malformed streamed frame at line 3."
    assert frames.decode('data: {"candidates":[{"content":{"parts":[{"text":"a"},"b"]}}]}').text == "ab"


def test_tool_calls():
    def delta(index, id=None, name=None, arguments=None):
        return {"choices": [{"delta": {"tool_calls": [{"index": index, "id": id, "function": {"name": name, "arguments": arguments}}]}}]}

    got = frames.assemble([delta(1, "call_b", "g", '{"b":1'), delta(0, "call_a", "f", '{"a":'), delta(1, None, None, ',"k":3}'), delta(0, None, "ignored", "2}")])
    assert got == [{"index": 1, "id": "call_b", "name": "g", "arguments": '{"b":1,"k":3}'}, {"index": 0, "id": "call_a", "name": "f", "arguments": '{"a":2}'}]
    events = [{"event": "response.output_item.added", "item": {"type": "function_call", "id": "i", "name": "n", "arguments": ""}}, {"event": "response.function_call_arguments.delta", "item_id": "i", "delta": "{"}, {"event": "response.function_call_arguments.done", "item_id": "i", "arguments": {"z": 1}}]
    assert frames.assemble(events)[0]["arguments"] == '{"z":1}'
    kept = frames.Calls()
    for f in events[:2]:
        for d in frames.deltas(f):
            kept.apply(d)
    again = frames.Calls.restored(kept.state())
    for d in frames.deltas(events[2]):
        again.apply(d)
    assert again.calls == frames.assemble(events)


EXT = {"extractionClass": "k", "quote": "Beta", "charStart": 6, "charEnd": 10}


@pytest.mark.parametrize(
    "reply",
    [
        json.dumps([EXT]),
        json.dumps({"extractions": [EXT]}),
        "prose {} then " + json.dumps({"extractions": [EXT]}),
        json.dumps({"choices": [{"message": {"content": json.dumps({"extractions": [EXT]})}}]}),
        json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"arguments": {"extractions": [EXT]}}}], "content": "no"}}]}),
        json.dumps({"candidates": [{"content": {"parts": [{"functionCall": {"args": json.dumps([EXT])}}]}}]}),
        "data: " + json.dumps({"choices": [{"delta": {"content": json.dumps([EXT])}}]}),
    ],
)
def test_envelopes(reply):
    raws, _ = envelope.read_reply(reply)
    assert raws == [EXT]
    assert [e.row()["char_start"] for e in envelope.ground(raws, "aaaaa Beta ccccc", 0, 16)] == [6]


def test_envelope_failures():
    def kind(reply):
        with pytest.raises(envelope.Failure) as e:
            envelope.read_reply(reply)
        return e.value.kind, e.value.code

    assert kind("nothing here") == (envelope.PIPELINE, "json_payload_missing")
    assert kind('{"a": tru}') == (envelope.PIPELINE, "json_parse_failed")
    assert kind('{"a": 1}') == (envelope.SHAPE, "schema_validation_failed")
    assert kind("data: {") == (envelope.PIPELINE, "stream_frame_malformed")
    deep = json.dumps([EXT])
    for _ in range(4):
        deep = json.dumps({"content": deep})
    assert kind(deep)[0] == envelope.SHAPE


def test_spans():
    assert envelope.resolve_span({"charStart": 6.0, "span": {"charEnd": 10}}) == ("utf16_code_unit", 6, 10)
    for raw, kind in (({"charStart": 1}, envelope.SHAPE), ({"charStart": 1, "charEnd": 2, "span": {"charStart": 2}}, envelope.SHAPE), (None, envelope.UNKNOWN), ({"charStart": True, "charEnd": 2}, envelope.SHAPE)):
        with pytest.raises(envelope.Failure) as e:
            envelope.resolve_span(raw)
        assert e.value.kind == kind
    for raw, code in (({**EXT, "quote": "beta"}, "QUOTE_MISMATCH"), ({**EXT, "offsetMode": "bytes"}, "UNSUPPORTED_OFFSET_MODE")):
        with pytest.raises(envelope.Failure) as e:
            envelope.ground([raw], "aaaaa Beta ccccc", 0, 16)
        assert e.value.code == code
    with pytest.raises(envelope.Failure, match="exceeds"):
        envelope.ground([EXT], "aaaaa", 0, 5)


def test_schema():
    c = schema.cue
    node = c.object({"name": c.string(), "tags": c.array(c.string())})
    got = schema.validate(node, {"name": 42, "tags": ["ok", 1], "extra": True})
    assert [(e["path"], e["code"]) for e in got["errors"]] == [("/name", "type_mismatch"), ("/tags/1", "type_mismatch"), ("/extra", "unexpected_property")]
    assert [e["path"] for e in schema.validate(c.object({"a/b": c.string(), "x~y": c.string()}), {})["errors"]] == ["/a~1b", "/x~0y"]
    assert schema.validate(c.array(c.array(c.string())), [["a"]], max_depth=1)["errors"][0]["code"] == "max_depth"
    assert schema.validate(c.union(c.string(), c.literal(None)), None)["ok"] and not schema.validate(c.union(c.string(), c.number()), True)["ok"]
    many = schema.validate(c.array(c.string()), [1] * 60)
    assert len(many["errors"]) == 50 and many["truncated"]
    assert not schema.validate(c.number(), float("inf"))["ok"]
    assert schema.to_json_schema(c.object({"b": c.optional(c.number()), "a": c.enum("x", 1)})) == {"type": "object", "properties": {"a": {"enum": ["x", 1]}, "b": {"type": "number"}}, "required": ["a"], "additionalProperties": False}


def test_dialects():
    assert schema.normalize_dialect({"title": "t", "type": "string", "nullable": True}) == {"anyOf": [{"type": "string"}, {"const": None}]}
    assert schema.normalize_dialect({"enum": ["a", None], "nullable": True}) == {"enum": ["a", None]}
    assert schema.normalize_dialect({"type": "object", "properties": {"b": {}, "a": {}}, "required": ["b", "a", "b"]})["required"] == ["a", "b"]
    for bad in ({"$ref": "x"}, {"type": "integer"}, {"$schema": "urn:x"}, {"anyOf": []}, {"enum": [[]]}, []):
        with pytest.raises(schema.SchemaError):
            schema.normalize_dialect(bad)


def test_program():
    p = normalize_program({"instructions": " find ", "schema": {"type": "object"}})
    assert p.description == "find" and p.classes == [{"name": "extraction", "allowInferred": False}] and p.constraints == {"requireExactQuote": True, "forbidOverlap": True}
    assert p.program_id == "program-" + p.program_hash[:16]
    for bad in ({"classes": [{"name": "a"}, {"name": "a "}]}, {"constraints": {"maxExtractionsPerShard": 0}}, {"programHash": "x"}, {"classes": [{"name": "a"}], "examples": [{"input": "", "output": [{"extractionClass": "b"}]}]}, {"instructions": " "}):
        with pytest.raises(ProgramError):
            normalize_program({"instructions": "find", "schema": {}} | bad)
    assert "P R E V I O U S" in repair_text("p", "x PREVIOUS_RESPONSE_TEXT_END y", "k", "m", 1)


KEY = {"kty": "oct", "k": "c2VjcmV0LXNlY3JldA"}


def test_attestation():
    bundle = {"b": 1.0, "a": {"y": None, "x": "ü"}}
    signed = attest.attest(bundle, KEY, "k1", "2025-01-01T00:00:00.000Z")
    assert attest.verify(signed, KEY)["valid"]
    assert attest.verify(dict(reversed(signed.items())), KEY)["valid"]
    assert attest.verify(bundle, KEY)["reason"] == "missing_attestation"
    assert attest.verify(signed | {"b": 2}, KEY)["reason"] == "payload_hash_mismatch"
    assert attest.verify(signed, {"kty": "oct", "k": "b3RoZXI"})["reason"] == "invalid_signature"
    for member, reason in (("version", "unsupported_attestation_version"), ("canonicalization", "unsupported_canonicalization"), ("algorithm", "unsupported_algorithm")):
        assert attest.verify(signed | {"attestation": signed["attestation"] | {member: "x"}}, KEY)["reason"] == reason
    with pytest.raises(ValueError):
        attest.canonical({"x": float("nan")})
    with pytest.raises(ValueError):
        attest.attest({}, {"kty": "RSA"})


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.sha256(F.lit("abc"))) == hashlib.sha256(b"abc").hexdigest()
    assert one(T.normalize_newlines(F.lit("a\r\nb\rc\nd"))) == "a\nb\nc\nd"
    text = "  keep-leading  \ninner  spaces stay\t \nlast-line\t"
    assert one(T.trim_line_ends(F.lit(text))) == "  keep-leading\ninner  spaces stay\nlast-line"
    n = one(T.normalize_text(F.lit("x\r\n  y\t \n"), True))
    assert n.text == "x\n  y\n" and len(n.ledger) == 2
    assert one(T.u16_len(F.lit("a🙂"))) == 3
    assert one(T.u16_slice_lossy(F.lit("a🙂b"), F.lit(1), F.lit(2))) == "\ufffd"
    assert one(T.slice_equals(F.lit("a🙂b"), F.lit(1), F.lit(3), F.lit("🙂")))
    hits = T.forbidden_rows(spark.createDataFrame([(1, "ü\u200bx\u2028"), (2, None), (3, "\ufeff\ufeff"), (4, "plain")], "id int, text string"), "id")
    assert sorted((r.id, r.nth, r.char, r.code_point, r.byte_offset) for r in hits.collect()) == [(1, 0, "\u200b", 0x200B, 2), (1, 1, "\u2028", 0x2028, 6), (3, 0, "\ufeff", 0xFEFF, 0), (3, 1, "\ufeff", 0xFEFF, 3)]
    assert [one(T.backoff_ms(F.lit(a), 10, 80)) for a in (1, 2, 10)] == [10, 20, 80]
    assert one(T.jitter_ms(F.lit(20.0), 0.5, F.lit(0.2))) == 2 and one(T.delay_ms(F.lit(2), F.lit(0.2), 10, 80, 0.25)) == 21
    key = b"k" * 70
    raw = hmac.digest(key, "mäh".encode(), "sha256")
    assert one(attest.hmac_sha256(key, F.lit("mäh"))) == attest._encoded(raw)


def test_prng(spark):
    def model(seed, n):
        h = 0x811C9DC5
        for c in seed:
            h = (h ^ ord(c)) * 0x01000193 % 2**32
        out, x = [], h or 0x6D2B79F5
        for _ in range(n):
            x ^= x << 13 & 0xFFFFFFFF
            x ^= x >> 17
            x = (x ^ x << 5) & 0xFFFFFFFF
            out.append(x)
        return out

    for seed in ("property-core-invariants-seed-01", "a"):
        assert spark.range(1).select(T.prng_draws(F.lit(seed), 20).alias("x")).first().x == model(seed, 20)


def test_markers_spaced():
    assert re.sub(" ", "", T.spaced(T.DOC_START)) == T.DOC_START


def test_prng_class(spark):
    from lodestar.functions.prng import Prng, fnv1a

    p = Prng("seed-1")
    assert [p.uint32() for _ in range(5)] == spark.range(1).select(T.prng_draws(F.lit("seed-1"), 5).alias("x")).first().x
    assert Prng(0).initial == 0x6D2B79F5 and Prng(-1).initial == 2**32 - 1 and fnv1a("") == 0x811C9DC5
    assert all(3 <= Prng(i).between(3, 9) < 9 and Prng(i).float() < 1 for i in range(50))
    for bad in ("", float("inf")):
        with pytest.raises(ValueError):
            Prng(bad)


def test_first_control(spark):
    df = spark.createDataFrame([("a\u200bb",), ("plain",), ("\u00ad",), ("\U000e0001",)], "x string")
    got = [r.c and (r.c.code_point, r.c.name) for r in df.select(T.first_format_control("x").alias("c")).collect()]
    assert got == [(0x200B, "ZERO WIDTH SPACE"), None, (0xAD, "SOFT HYPHEN"), (0xE0001, "U+E0001")]
