"""Line numbers and strict JSON Lines over splits of any size."""

import json
import random

import pytest

from lodestar.sources import lines


def problems(text):
    """The rules, one line after the other."""
    out, rows = [], text.split("\n")
    if text and not text.endswith("\n"):
        out.append((len(rows), "no line feed at the end"))
    for n, line in enumerate(rows[:-1] if text.endswith("\n") else rows, 1):
        if line == "":
            out.append((n, "blank line"))
            continue
        try:
            v = json.loads(line)
        except ValueError:
            out.append((n, "no JSON"))
            continue
        if not isinstance(v, dict):
            out.append((n, "no object"))
    return sorted(out) if text else []


@pytest.mark.parametrize("split", [37, 1000, 128 << 20])
def test_splits_of_any_size(spark, tmp_path, split):
    rng = random.Random(split)
    kinds = ['{"a":1}', "", "[1]", '{"a":', " ", '{"b":"é🙂"}\r', "7", "null", '{"long":"' + "x" * 90 + '"}']
    texts = {f"{i}.jsonl": "\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 60))) + rng.choice(("", "\n")) for i in range(6)}
    texts |= {"empty.jsonl": "", "feed.jsonl": "\n", "one.jsonl": '{"a":1}', "good.jsonl": '{"a":1}\n' * 50}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        path = f"file://{tmp_path}"
        numbered = lines.numbered_lines(spark, path)
        if split == 37:
            assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 30
        got = {}
        for r in numbered.collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line] = r.value
        for name, text in texts.items():
            want = text.split("\n")[: -1 if text.endswith("\n") else None] if text else []
            assert got.get(name, {}) == dict(enumerate(want, 1)), name
        found = {}
        for r in lines.strict_violations(spark, path).collect():
            found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line, r.problem))
        assert {k: sorted(v) for k, v in found.items()} == {k: p for k, t in texts.items() if (p := problems(t))}
        counts = {r.file.rsplit("/", 1)[1]: r.n_objects for r in lines.object_count(spark, path).collect()}
        assert counts["good.jsonl"] == 50 and counts["one.jsonl"] == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
