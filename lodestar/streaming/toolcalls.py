"""Streamed tool calls: one state for each stream, fed by frames as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import frames, js

CALL = "stream_id string, slot int, call_index int, call_id string, name string, arguments string"


def _rows(key: str, calls: list[dict]) -> pd.DataFrame:
    rows = [(key, i, c["index"], c["id"], c["name"], c["arguments"]) for i, c in enumerate(calls)]
    return pd.DataFrame(rows, columns=["stream_id", "slot", "call_index", "call_id", "name", "arguments"])


def _apply(calls: frames.Calls, line: str) -> None:
    try:
        frame = js.loads(line)
    except ValueError:
        return
    for d in frames.deltas(frame):
        calls.apply(d)


def assemble_batch(lines: DataFrame) -> DataFrame:
    """CALL rows of each stream from (stream_id, seq, frame): frames in order of seq.  Lines that are
    no JSON are passed over.  A stream is one reply, so a group is bounded by a reply's length."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        calls = frames.Calls()
        for line in pdf.sort_values("seq", kind="stable")["frame"]:
            _apply(calls, line)
        return _rows(pdf["stream_id"].iloc[0], calls.calls)

    return lines.select("stream_id", "seq", "frame").groupBy("stream_id").applyInPandas(one, CALL)


class Assembler(StatefulProcessor):
    """Keeps a stream's calls, the next sequence number, and frames that came ahead of it; all of it goes
    ``ttl_ms`` after the stream's last frame."""

    LAYOUT = StructType([StructField("calls", StringType()), StructField("next", LongType()), StructField("waiting", StringType())])

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("calls", self.LAYOUT, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            kept, due, waiting = self.state.get()
            calls, waiting = frames.Calls.restored(kept), {int(k): v for k, v in js.loads(waiting).items()}
        else:
            calls, due, waiting = frames.Calls(), 0, {}
        before = [dict(c) for c in calls.calls]
        for pdf in rows:
            for seq, frame in zip(pdf["seq"], pdf["frame"]):
                if seq >= due:
                    waiting.setdefault(int(seq), frame)
        while due in waiting:
            _apply(calls, waiting.pop(due))
            due += 1
        self.state.update((calls.state(), due, js.dumps({str(k): v for k, v in waiting.items()})))
        changed = [i for i, c in enumerate(calls.calls) if i >= len(before) or c != before[i]]
        out = _rows(key[0], calls.calls)
        yield out.iloc[changed]

    def close(self) -> None:
        pass


#: What this processor needs: its state store, and no batches without data, of which processing time would make ever more.
NEEDS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def assemble_stream(lines: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The same for a stream of (stream_id, seq from 0, frame): after each batch the calls that it changed,
    as far as they are known.

    Gaps in seq hold back what follows until they are filled.  A frame that repeats a number, taken or
    waiting, is ignored: the first one counts.  ``ttl_ms``: what is kept of a stream goes that long after its
    last frame, whether it was complete or not; frames that come later still find no beginning, wait
    as long for one and go with it.  Needs what NEEDS says."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return lines.groupBy("stream_id").transformWithStateInPandas(Assembler(ttl_ms), CALL, outputMode="Update", timeMode=mode)


def latest(calls: DataFrame) -> DataFrame:
    """Of update-mode output the last state of each slot (arguments only grow or are replaced, so a
    batch column ``batch`` tells)."""
    return calls.groupBy("stream_id", "slot").agg(F.max_by(F.struct("call_index", "call_id", "name", "arguments"), "batch").alias("c")).select("stream_id", "slot", "c.*")


def assemble_folder(spark: SparkSession, path: str, work: str, ttl_ms: int | None = None, files_per_batch: int = 1000, after_batch: Callable[[int], None] | None = None) -> DataFrame:
    """CALL rows from the Parquet files of (stream_id, seq, frame) in folder ``path``: those that no earlier call
    with the same ``work`` folder has read are streamed through, ``files_per_batch`` at a time.

    Offsets, state and results lie in ``work``, a folder that driver and executors share.  A run that dies is
    taken up by calling again: the batch that it was at is done again from the state before it, and its results
    replace those that it may have written.  ``after_batch`` gets the number of each batch once it is
    written."""

    def sink(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{work}/calls/batch={number}")
        if after_batch:
            after_batch(number)

    before = {k: spark.conf.get(k) for k in NEEDS}
    for k, v in NEEDS.items():
        spark.conf.set(k, v)
    try:
        lines = spark.readStream.schema("stream_id string, seq long, frame string").option("maxFilesPerTrigger", files_per_batch).parquet(path)
        out = assemble_stream(lines, ttl_ms).writeStream.outputMode("update").option("checkpointLocation", f"{work}/checkpoint")
        out.foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return latest(spark.read.schema(f"{CALL}, batch long").parquet(f"{work}/calls"))
