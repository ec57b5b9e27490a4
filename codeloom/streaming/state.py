"""Streams with state: flushes after a pause, the progress of running tools, and the last status in a log."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds between flushes while paths are left over.
LEFT_OVER = 100


def with_state_store(spark: SparkSession) -> None:
    """Sets the state store that processors with timers and maps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _ms(value: pd.Timestamp | datetime.datetime) -> int:
    return pd.Timestamp(value).value // 1_000_000


class Debounce(StatefulProcessor):
    """Pending paths of a root, flushed a few at a time once no event came for a while."""

    def __init__(self, pause: int, most: int):
        self.pause, self.most = pause, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "no long")
        self.clock = handle.getValueState("clock", "due long, last long, next long")

    def _flush(self, root: str, at: int) -> tuple[tuple, bool]:
        """The first ``most`` pending paths in order of arrival; whether others are left."""
        held = sorted((value[0], key[0]) for key, value in self.pending.iterator())
        taken = [path for _, path in held[: self.most]]
        for path in taken:
            self.pending.removeKey((path,))
        return (root, pd.Timestamp(at, unit="ms"), taken), len(held) > len(taken)

    def _due_by(self, root: str, due: int, now: int) -> tuple[list[tuple], int]:
        """All flushes up to a time, and when the next one is due (0: none)."""
        out = []
        while due and due <= now:
            row, more = self._flush(root, due)
            out.append(row)
            due = due + LEFT_OVER if more else 0
        return out, due

    def _set(self, due: int, last: int, following: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            self.handle.registerTimer(due)
        self.clock.update((due, last, following))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        root = key[0]
        due, last, following = self.clock.get() if self.clock.exists() else (0, 0, 0)
        events = pd.concat(list(rows)).sort_values(["ts", "path"], kind="stable")
        out: list[tuple] = []
        for path, ts in zip(events["path"], events["ts"], strict=True):
            last = max(last, _ms(ts))  # a late event counts as the latest so far
            flushed, due = self._due_by(root, due, last)
            out += flushed
            if not self.pending.containsKey((path,)):
                self.pending.updateValue((path,), (following,))
                following += 1
            due = last + self.pause
        self._set(due, last, following)
        if out:
            yield _flushes(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, last, following = self.clock.get()
        out, due = self._due_by(key[0], due, timerValues.getCurrentWatermarkInMs())
        self._set(due, last, following)
        if out:
            yield _flushes(out)

    def close(self) -> None:
        pass


def _flushes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"root": [r[0] for r in rows], "flushed_at": pd.Series([r[1] for r in rows], dtype="datetime64[ns]"), "paths": pd.Series([r[2] for r in rows], dtype=object)})


def debounced(events: DataFrame, pause: int = 700, most: int = 8, late: str = "0 seconds") -> DataFrame:
    """(root, flushed_at, paths) of a stream of changes (root, path, ts).

    Each change of a root restarts its pause, in milliseconds; when a pause ends, the ``most`` paths that
    have waited longest are flushed, and what is left follows in steps of 100 ms, unless a change
    comes first.  A path that waits already keeps its place.  Pauses end by the time of events: a flush comes
    out once the watermark, ``late`` behind the latest event, has passed it, so a restarted stream flushes
    what it would have.  Changes behind the watermark are dropped by Spark; others that come late
    count as just come.  State holds a root's waiting paths and nothing else.
    """
    with_state_store(events.sparkSession)
    marked = events.select("root", "path", "ts").withWatermark("ts", late)
    return marked.groupBy("root").transformWithStateInPandas(Debounce(pause, most), "root string, flushed_at timestamp, paths array<string>", "Append", "EventTime")


class Progress(StatefulProcessor):
    """The open starts of a tool, which its next end flips all at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = [r[0] for r in self.open.get()] if self.open.exists() else []
        out = []
        for seq, event in zip(events["seq"], events["event"], strict=True):
            if event == "tool_start":
                held.append(int(seq))
            elif event in ("tool_done", "tool_error"):
                closed = [s for s in held if s < seq]  # an end that comes late flips what began before it
                out += [(s, event.removeprefix("tool_"), int(seq)) for s in closed]
                held = [s for s in held if s > seq]
        out += [(s, "running", None) for s in held if s in set(events["seq"])]
        if held:
            self.open.put([(s,) for s in held])
        else:
            self.open.clear()
        if out:
            yield pd.DataFrame({"tool": key[0], "seq": [r[0] for r in out], "status": [r[1] for r in out], "end": pd.array([r[2] for r in out], "Int64")})

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame) -> DataFrame:
    """(tool, seq, status, end) of a stream of (seq, event, tool): a row when a start comes in and is still
    open, and one when an end flips it, so the last row of a start is its state.

    Batches may come in any order of tools; within one, events go by seq.  An end that comes after later
    starts flips only those before it; a start that comes after the end that follows it waits for the
    next one.  A repeated start is two starts, a repeated end flips nothing.  State holds open starts alone.
    """
    with_state_store(events.sparkSession)
    kind = events.schema["tool"].dataType.simpleString()
    return events.groupBy("tool").transformWithStateInPandas(Progress(), f"tool {kind}, seq long, status string, end long", "Update", "None")


#: What is read of a log line.
LOG_LINE = "ts timestamp, service string, function string, status string, seq long"


def log_events(lines: DataFrame) -> DataFrame:
    """(node, status, ts, seq) of JSON lines (value); lines that are no JSON, or name neither service nor
    function, or have no time, are left out."""
    read = F.from_json("value", LOG_LINE, {"mode": "PERMISSIVE"})
    rows = lines.select(read.alias("e")).select("e.*").filter("ts is not null and (service is not null or function is not null)")
    return rows.select(F.concat_ws(".", "service", "function").alias("node"), "status", "ts", F.coalesce("seq", F.lit(0)).alias("seq"))


def log_status(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(node, status, ts): a stream of log lines to each node's last status by time, in update mode.

    Repeated lines within ``late`` of each other are dropped first; their keys go as the watermark passes,
    and what stays is one row for each node, however long the log.  Lines may come in any order: the
    last row of a node equals what the batch operator finds over all lines.
    """
    events = log_events(lines).withWatermark("ts", late).dropDuplicatesWithinWatermark(["node", "ts", "seq", "status"])
    return events.groupBy("node").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"))


def keep_latest(rows: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes a stream in update mode to a folder, a version for each batch, and starts it.  A batch that is
    done again overwrites its version; read_latest takes the last row of each key."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/v={number}")

    return rows.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def read_latest(spark: SparkSession, table: str, by: list[str]) -> DataFrame:
    """The rows of the last version that has their key."""
    held = spark.read.parquet(table)
    rest = [c for c in held.columns if c not in (*by, "v")]
    last = held.groupBy(*by).agg(F.max_by(F.struct(*rest), "v").alias("row"))
    return last.select(*by, "row.*")
