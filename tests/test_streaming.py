"""The stream of tool calls: restart, repeats, gaps, state that ends."""

import json
import time

import pytest
from pyspark.errors import StreamingQueryException

from lodestar.streaming import toolcalls

LINES = "stream_id string, seq long, frame string"


def frame(index, arguments, **more):
    return json.dumps({"choices": [{"delta": {"tool_calls": [{"index": index, "function": {"arguments": arguments}, **more}]}}]})


def put(spark, path, *files):
    for rows in files:
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(path)


def calls(df):
    return sorted((r.stream_id, r.slot, r.call_index, r.call_id, r.arguments) for r in df.collect())


def test_restart_after_a_batch_that_was_written(spark, tmp_path):
    """A run that dies behind its sink's write does the batch again, in place of what it had written."""
    rows = [("s", i, frame(i % 2, f"<{i}>", id=f"c{i % 2}")) for i in range(12)]
    put(spark, f"file://{tmp_path}/in", rows[4:8], rows[8:] + rows[2:6], rows[:4] + rows[:1])
    want = calls(toolcalls.assemble_batch(spark.createDataFrame(rows, LINES)))
    seen = []

    def stop(number):
        seen.append(number)
        if len(seen) == 2:
            raise RuntimeError("the machine is lost")

    run = lambda after=None: toolcalls.assemble_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/work", files_per_batch=1, after_batch=after)
    with pytest.raises(StreamingQueryException):
        run(stop)
    done = run(seen.append)
    assert seen == [0, 1, 1, 2] and calls(done) == want
    assert calls(run(seen.append)) == want and seen == [0, 1, 1, 2]  # nothing new, nothing done
    put(spark, f"file://{tmp_path}/in", [("s", 12, frame(0, "<12>")), ("t", 0, frame(0, "z")), ("s", 3, frame(0, "again"))])
    more = rows + [("s", 12, frame(0, "<12>")), ("t", 0, frame(0, "z"))]
    assert calls(run()) == calls(toolcalls.assemble_batch(spark.createDataFrame(more, LINES)))


def test_only_changes_are_told(spark, tmp_path):
    put(spark, f"file://{tmp_path}/in", [("s", 0, frame(0, "a")), ("s", 1, frame(1, "b"))], [("s", 2, frame(1, "c"))])
    toolcalls.assemble_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/work", files_per_batch=1)
    told = spark.read.parquet(f"file://{tmp_path}/work/calls").collect()
    assert sum(r.slot == 0 for r in told) == 1 and len(told) <= 3


@pytest.mark.parametrize("ttl_ms,arguments", [(1, "ab"), (3_600_000, "abcd")])
def test_state_ends(spark, tmp_path, ttl_ms, arguments):
    """What is kept of a stream goes after a while: later frames of it then find no beginning."""
    path, work = f"file://{tmp_path}/in", f"file://{tmp_path}/work"
    put(spark, path, [("s", 0, frame(0, "a")), ("s", 1, frame(0, "b"))])
    toolcalls.assemble_folder(spark, path, work, ttl_ms=ttl_ms)
    time.sleep(0.2)
    put(spark, path, [("s", 2, frame(0, "c")), ("s", 3, frame(0, "d")), ("u", 0, frame(0, "x"))])
    assert calls(toolcalls.assemble_folder(spark, path, work, ttl_ms=ttl_ms)) == [("s", 0, 0, None, arguments), ("u", 0, 0, None, "x")]
