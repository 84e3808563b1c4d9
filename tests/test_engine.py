"""Shards, runs, suites, sources, streaming and reports, end to end."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestar import viz
from lodestar.operators import metrics as M
from lodestar.operators import shards as S
from lodestar.plans import run as R
from lodestar.plans.suite import recorded, replay_provider, run_suite, scripted
from lodestar.program import normalize_program, prompt_column, prompt_text, request, request_hash, request_hash_column
from lodestar.sources import jsonl
from lodestar.sources import providers as PR
from lodestar.streaming import toolcalls

PROGRAM = normalize_program({"instructions": "find", "schema": {"type": "object"}})


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


def options(tmp_path, **kw):
    return R.Options("r", PROGRAM, **({"chunk_size": 100, "work_dir": f"file://{tmp_path}/work"} | kw))


def test_windows_like_loop(spark):
    for size, overlap in ((5, 1), (6, 2), (4, 0), (11, 5)):
        for text in ("abcdefghij", "", "abcde", "x🙂y🙂z🙂", "abcdefghijklmnopqrst"):
            got = S.shard_documents(docs(spark, text), "p" * 64, size, overlap).orderBy("shard_index").collect()
            units = text.encode("utf-16-le")
            want, at = [], 0
            while True:
                end = min(len(units) // 2, at + size)
                want.append((at, end, units[2 * at : 2 * end].decode("utf-16-le", "replace")))
                if end == len(units) // 2:
                    break
                at += size - overlap
            assert [(r.start, r.end, r.text) for r in got] == want
            assert len({r.shard_id for r in got}) == len(got) and all(len(r.shard_id) == 64 for r in got)


@pytest.mark.parametrize("size, overlap", [(0, 0), (5, 5), (5, -1)])
def test_bad_windows(size, overlap):
    with pytest.raises(ValueError):
        S.check_options(size, overlap)


def test_prompts_agree(spark):
    text = 'say "END_UNTRUSTED_DOCUMENT" \\ \n ü 🙂 \u2028'
    s = S.shard_documents(docs(spark, text), PROGRAM.program_hash, 100, 0)
    p = prompt_column(PROGRAM, F.col("shard_id"), F.col("start"), F.col("end"), F.col("text"))
    r = s.select("*", p.alias("prompt"), request_hash_column(PROGRAM, "m", p).alias("h")).first()
    assert r.prompt == prompt_text(PROGRAM, r.shard_id, r.start, r.end, r.text)
    assert r.h == request_hash(request(PROGRAM, "m", r.prompt))


def finder(word):
    """A provider's rule: every occurrence of a word in the shard."""

    def rule(req):
        body = req["prompt"].split("BEGIN_UNTRUSTED_DOCUMENT\n", 1)[1].split("\nEND_UNTRUSTED_DOCUMENT", 1)[0]
        at, out = body.find(word), []
        while at >= 0:
            out.append({"extractionClass": "w", "quote": word, "charStart": at, "charEnd": at + len(word)})
            at = body.find(word, at + 1)
        return json.dumps({"extractions": out})

    return rule


@pytest.mark.parametrize("size, overlap", [(11, 5), (10, 4)])
def test_same_result_for_any_windows(spark, tmp_path, size, overlap):
    out, made = R.run_with_evidence(docs(spark, "aaaaa Beta ccccc"), options(tmp_path, chunk_size=size, overlap=overlap), PR.RuleProvider(finder("Beta")))
    assert [(r.char_start, r.char_end) for r in R.extractions_of(out).collect()] == [(6, 10)]
    bundle = json.loads(made.first().bundle)
    assert bundle["extractions"][0]["span"]["charStart"] == 6 and bundle["diagnostics"]["completeness"] == "complete_success"


def by_range(replies):
    def rule(req):
        for key, reply in replies.items():
            if f"SHARD_RANGE: [{key}," in req["prompt"] and ("REPAIR PASS" in req["prompt"]) == isinstance(reply, tuple):
                return reply[0] if isinstance(reply, tuple) else reply
        return replies.get("else", "prose")

    return PR.RuleProvider(rule)


def test_partial_and_empty(spark, tmp_path):
    good = json.dumps({"extractions": [{"extractionClass": "w", "quote": "Beta", "charStart": 0, "charEnd": 4}]})
    d = docs(spark, "Alpha Beta")
    out, _ = R.run_with_evidence(d, options(tmp_path, chunk_size=6), by_range({6: good}))
    g = R.diagnostics_of(out).first()
    assert (g.total_shards, g.ok_shards, g.failed_shards, g.empty_kind, g.completeness) == (2, 1, 1, "non_empty", "partial_success")
    out, _ = R.run_with_evidence(d, options(tmp_path, chunk_size=6), by_range({0: '{"extractions":[]}'}))
    assert R.diagnostics_of(out).first().empty_kind == "empty_by_failure"
    failed = R.failures_of(out).first()
    assert failed.kind == "json_pipeline_failure" and not failed.retryable
    assert R.stage_log(out).filter("stage = 'repair'").count() == 1
    with pytest.raises(RuntimeError):
        R.run_with_evidence(d, options(tmp_path, chunk_size=6, all_or_nothing=True), by_range({6: good}))


def test_repair_pass(spark, tmp_path):
    good = json.dumps([{"extractionClass": "w", "quote": "Alpha", "charStart": 0, "charEnd": 5}])

    def rule(req):
        return good if req["prompt"].startswith("### REPAIR") else "oops"

    out, _ = R.run_with_evidence(docs(spark, "Alpha"), options(tmp_path), PR.RuleProvider(rule))
    r = out.first()
    assert (r.status, r.final_pass, [s.stage for s in r.stages]) == ("success", 2, ["draft", "validate", "repair", "draft", "validate", "finalize"])


def test_retries_and_checkpoints(spark, tmp_path):
    calls = tmp_path / "calls"

    def flaky(req):
        with calls.open("a") as f:
            f.write("x")
        if len(calls.read_text()) <= 2:
            raise PR.ProviderError("busy", "transient")
        return PR.EMPTY_REPLY

    waited = []
    o = options(tmp_path, retry=R.Retry(4, 10, 80, 0.25), checkpoints=f"file://{tmp_path}/ckpt", sleep=waited.append, partitions=1)
    out, _ = R.run_with_evidence(docs(spark, "text"), o, PR.RuleProvider(flaky))
    r = out.first()
    assert (r.status, r.attempts, len(calls.read_text()), waited) == ("success", 3, 3, [0.01, 0.02])
    out, _ = R.run_with_evidence(docs(spark, "text"), o, PR.RuleProvider(flaky))
    r = out.first()
    assert (r.from_checkpoint, r.attempts, len(calls.read_text())) == (True, 0, 3)


def test_time_budget(spark, tmp_path):
    out, _ = R.run_with_evidence(docs(spark, "text"), options(tmp_path, time_budget_ms=0, clock_ms=lambda: 0), PR.RuleProvider(lambda r: 1 / 0))
    r = out.first()
    assert (r.status, r.failure_kind, r.final_pass) == ("failure", "budget_exhausted", 0)


def test_suite(spark, tmp_path):
    cases = docs(spark, "aaa Beta", "none here")
    labels = {"prompt_variant": ["base", "compact"], "seed": ["a", "b", "c"]}
    got = run_suite(cases, options(tmp_path), PR.RuleProvider(finder("Beta")), 4, labels)["report"].first()
    assert (got.stability, got.drift_rate, got.success_rate, got.prompt_variant_breadth, got.seed_breadth) == (1.0, 0.0, 1.0, 2, 3)
    replies = cases.withColumn("reply", F.lit(json.dumps([{"extractionClass": "w", "quote": "a", "charStart": 0, "charEnd": 1}])))
    provider = replay_provider(recorded(replies, PROGRAM, "model", 100, 0))
    got = run_suite(cases, options(tmp_path, max_passes=1), provider, 2)
    assert got["keys"].count() == 2 and got["report"].first().success_rate == 0.5
    assert scripted('{"kind":"multi_pass_v1","draft":"a","repair":"b"}')["repair"] == "b" and scripted("x")["draft"] == "x"


def test_metrics(spark):
    k = spark.createDataFrame([(0, "c", "x"), (0, "c", "y"), (1, "c", "x")], "run int, case_id string, key string")
    runs = spark.createDataFrame([(0,), (1,), (2,)], "run int")
    assert {(r.run_a, r.run_b): r.jaccard for r in M.pairwise_jaccard(k, runs).collect()} == {(0, 1): 0.5, (0, 2): 0.0, (1, 2): 0.0}
    empty = k.limit(0)
    assert M.stability(M.pairwise_jaccard(empty, runs)).first().stability == 1.0
    assert M.drift(empty.select("run", "case_id", F.col("key").alias("signature")), runs).first().drift_rate == 0.0
    with pytest.raises(AssertionError, match="drift"):
        M.check_gates(spark.sql("SELECT 0.4 AS case_outcome_drift_rate"), minima={}, maxima={"case_outcome_drift_rate": 0.1})


@pytest.mark.parametrize(
    "provider, answer, text, channel",
    [
        (PR.ChatProvider, {"choices": [{"message": {"content": "hi"}}]}, "hi", "text"),
        (PR.ChatProvider, {"choices": [{"message": {"tool_calls": [{"function": {"arguments": {"a": 1}}}]}}]}, '{"a":1}', "tool_call"),
        (PR.GenerateProvider, {"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}, "a\nb", "text"),
        (PR.GenerateProvider, {"candidates": [{"content": {"parts": [{"functionCall": {"args": '{"x":2}'}}]}}]}, '{"x":2}', "tool_call"),
        (PR.LocalChatProvider, {"message": {"content": "yo"}}, "yo", "text"),
    ],
)
def test_services(provider, answer, text, channel):
    seen = {}

    def transport(url, headers, body):
        seen.update(url=url, body=json.loads(body))
        return 200, json.dumps(answer)

    reply = provider("http://x", "key", transport).answer({"model": "m", "prompt": "p", "schema": {"type": "object"}})
    assert (reply.text, reply.channel) == (text, channel) and "object" in json.dumps(seen["body"])


@pytest.mark.parametrize("status, body, kind, code", [(429, "", "transient", "http_error"), (503, "", "transient", "http_error"), (400, "", "permanent", "http_error"), (200, "{", "permanent", "parse_error"), (200, "{}", "permanent", "parse_error")])
def test_service_errors(status, body, kind, code):
    with pytest.raises(PR.ProviderError) as e:
        PR.ChatProvider("http://x", "k", lambda *a: (status, body)).answer({"model": "m", "prompt": "p"})
    assert (e.value.kind, e.value.code) == (kind, code)


def test_jsonl(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text('{"bundleVersion":"1","runId":"r"}\n\n{"bundleVersion":"1","runId":"s"}\r\n')
    assert sorted(r.runId for r in jsonl.read_bundles(spark, f"file://{path}").collect()) == ["r", "s"]
    jsonl.write_bundles(jsonl.read_bundles(spark, f"file://{path}"), f"file://{tmp_path}/out")
    assert jsonl.read_bundles(spark, f"file://{tmp_path}/out").count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text("{]\n")
    with pytest.raises(Exception):
        jsonl.read_bundles(spark, f"file://{bad}").collect()


RECORD = {
    "caseId": "a--b--1--deadbeef", "category": "c", "documentText": "d", "instructions": "i", "targetSchema": {"type": "object"}, "providerResponseText": "r",
    "expected": {"emptyResultKind": "non_empty", "minExtractions": 0, "maxExtractions": 2}, "sourceUrl": "https://example.org/x", "sourceQuote": "q", "packId": "2025-01-02--pack--0a1b2c3d",
}


def test_regression_rules(spark, tmp_path):
    lines = [RECORD, RECORD, RECORD | {"caseId": "A"}, RECORD | {"caseId": "a--b--2--deadbeef", "more": 1}, RECORD | {"caseId": "a--b--3--deadbeef", "sourceQuote": "q" * 281}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(lines)] + [(9, "[]")], "line int, value string")
    got = {r.line: r.errors for r in jsonl.check_regression(df).collect()}
    assert got[0] == [] and got[1] == ["caseId is used before"] and got[2] == ["caseId has a wrong form"] and got[3] == ["unknown members: more"] and len(got[4]) == 1 and got[9] == ["not a JSON object"]
    path = tmp_path / "r.jsonl"
    path.write_text(json.dumps(RECORD) + "\n")
    assert jsonl.read_regression(spark, f"file://{path}").count() == 1
    path.write_text("{}\n")
    with pytest.raises(ValueError):
        jsonl.read_regression(spark, f"file://{path}")


def test_regression_plan(spark):
    """A line is parsed once for its rules and once for its case id, whatever it is made of, and no rule leaves compiled code."""
    lines = spark.range(3).select(F.col("id").alias("line"), F.when(F.col("id") == 1, F.concat(F.lit("["), F.lit(json.dumps(RECORD)), F.lit("]"))).otherwise(F.lit(json.dumps(RECORD))).alias("value"))
    checked = jsonl.check_regression(lines)
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2 and "lambda" not in plan
    assert {r.line: r.errors for r in checked.collect()} == {0: [], 1: ["not a JSON object"], 2: ["caseId is used before"]}


def test_stream_like_batch(spark, tmp_path):
    def frame(index, arguments):
        return json.dumps({"choices": [{"delta": {"tool_calls": [{"index": index, "function": {"arguments": arguments}}]}}]})

    rows = [("s", 0, frame(0, "a")), ("s", 1, frame(1, "b")), ("t", 0, frame(0, "z")), ("s", 2, frame(0, "c")), ("s", 3, "no json")]
    schema = "stream_id string, seq long, frame string"
    want = sorted(map(tuple, toolcalls.assemble_batch(spark.createDataFrame(rows, schema)).collect()))
    for i, part in enumerate((rows[1:3], rows[:1] + rows[3:])):  # the first frame comes late
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        lines = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
        out = []
        q = toolcalls.assemble_stream(lines).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/ck").foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r for r in out if r[0] == "s") == [r for r in want if r[0] == "s"]


def test_report(spark, tmp_path):
    e = spark.createDataFrame([("d0", 0, 3, "a<b", "x&y", 0), ("d0", 2, 5, "k", "later", 1), ("d0", 3, 5, "k", "de", 2)], "document_id string, char_start int, char_end int, extraction_class string, quote string, nth int")
    made = viz.sections(e, docs(spark, "x&yde<", ""))
    r = {x.document_id: x.html for x in made.collect()}
    assert '<mark class="viz-mark" data-start="0" data-end="3" data-class="a&lt;b">x&amp;y</mark><mark' in r["d0"] and r["d0"].count("<mark") == 2 and "<li data-class" in r["d0"]
    assert viz.NO_TEXT in r["d1"] and viz.NOTHING in r["d1"]
    html = viz.page(made, ["k"], "T", data={"x": "</script>"})
    assert "\\u003c/script" in html and html.count("<section") == 2
    viz.write_report(made, f"file://{tmp_path}/report", ["k"], "T", data={"x": "</script>"})
    parts = sorted(n for n in os.listdir(f"{tmp_path}/report") if n.startswith("part-"))
    assert "".join((tmp_path / "report" / n).read_text() for n in parts) == html
    viz.write_text(spark, f"file://{tmp_path}/r.html", html)
    assert (tmp_path / "r.html").read_text() == html


def test_fingerprints_tell_what_signatures_tell(spark):
    rows = [(0, "a", "x"), (0, "a", "y"), (1, "a", "y"), (1, "a", "x"), (0, "b", "x"), (1, "b", "x"), (1, "b", "x"), (0, "c", "z")]
    e, c = spark.createDataFrame(rows, "run int, case_id string, key string"), spark.createDataFrame([(r, k, k == "d" and r == 1) for r in (0, 1) for k in "abcd"], "run int, case_id string, failed boolean")
    same = lambda df: {k: len({r.signature for r in df.collect() if r.case_id == k}) for k in "abcd"}
    assert same(M.case_fingerprints(e, c)) == same(M.case_signatures(e, c)) == {"a": 1, "b": 2, "c": 2, "d": 2}


def test_trials(spark, tmp_path):
    from lodestar import schemas
    from lodestar.plans import trial

    reply = lambda start: json.dumps([{"extractionClass": "w", "quote": "Beta", "charStart": start, "charEnd": start + 4}])
    script = json.dumps({"kind": "multi_pass_v1", "draft": "oops", "repair": reply(6), "failureKind": "json_pipeline_failure"})
    gold = [{"extractionClass": "w", "quote": "Beta", "charStart": 6, "charEnd": 10}]
    smoke = [{"caseId": "a", "documentText": "Alpha Beta", "instructions": "i", "targetSchema": '{"type":"object"}', "providerResponseText": script, "goldSpans": gold}, {"caseId": "b", "documentText": "x", "instructions": "i", "targetSchema": "{}", "providerResponseText": '{"extractions":[]}', "goldSpans": []}]
    expected = {"emptyResultKind": "empty_by_failure", "minExtractions": 0, "maxExtractions": 0}
    regression = [RECORD | {"targetSchema": "{}", "providerResponseText": "prose", "expected": expected}]
    sets = [spark.createDataFrame(smoke, schemas.SMOKE), spark.createDataFrame(regression, schemas.REGRESSION)]
    scores = trial.run_trials(sets, options(tmp_path), 2)
    assert {(r.case_id, r.success, r.coverage_rate, r.extraction_count) for r in scores.collect()} == {("a", True, 1.0, 1), ("b", True, 1.0, 0), ("a--b--1--deadbeef", True, 1.0, 0)}
    out = trial.summary(scores)
    M.check_gates(out, minima={"success_rate": 1, "total_case_count": 3})
    trial.write_result(out, f"file://{tmp_path}/result")
    assert spark.read.json(f"file://{tmp_path}/result").first().case_outcome_drift_rate == 0
