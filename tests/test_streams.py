import datetime
import json
import os
import random

import pytest
from codeloom.operators import diagrams
from codeloom.streaming import state, tracker
from pyspark.sql import functions as F

START = datetime.datetime(2024, 1, 1)


class Feed:
    """A folder of JSON files that a stream reads, a file for each batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder / "in", schema, 0
        self.folder.mkdir()
        self.out, self.check = str(folder / "out"), str(folder / "check")

    def add(self, rows):
        self.n += 1
        file = self.folder / f"{self.n:04}.json"
        file.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
        os.utime(file, (1_700_000_000 + self.n, 1_700_000_000 + self.n))  # files are read by their time

    def stream(self):
        reader = self.spark.readStream.option("maxFilesPerTrigger", 1)
        return reader.schema(self.schema).json(str(self.folder)) if self.schema else reader.text(str(self.folder))

    def run(self, operator):
        """Runs to the end of what is there, from the checkpoint of the run before."""
        state.keep_latest(operator(self.stream()), self.out, self.check, trigger={"availableNow": True}).awaitTermination(120)


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, tmp_path, schema)


def at(ms):
    return (START + datetime.timedelta(milliseconds=ms)).isoformat(timespec="milliseconds")


def plain_flushes(events, pause=700, most=8):
    """One pending list and one timer, walked through time."""
    out, pending, due = [], [], None
    for t, path in [*events, (10**9, None)]:
        while due is not None and due <= t:
            taken, pending = pending[:most], pending[most:]
            out.append((due, taken))
            due = due + 100 if pending else None
        if path is not None:
            pending += [path] if path not in pending else []
            due = t + pause
    return out


def test_flushes_come_after_a_pause_and_survive_a_restart(spark, feed):
    rng, t, events = random.Random(1), 0, []
    for _ in range(60):
        t += rng.choice((0, 20, 50, 300, 650, 750, 2000))
        events.append((t, f"f{rng.randrange(14)}"))
    events += [(t + 5000, f"g{i:02}") for i in range(20)] + [(t + 5750, "late")]  # more than one flush takes, and one in between
    events.sort()
    source = feed("root string, path string, ts timestamp")
    for part in (events[:25], events[25:50], events[50:]):
        source.add([{"root": "r", "path": p, "ts": at(ms)} for ms, p in part])
        source.run(state.debounced)
    source.add([{"root": "other", "path": "x", "ts": at(10**7)}])  # moves the watermark
    source.run(state.debounced)
    source.add([{"root": "other", "path": "x", "ts": at(2 * 10**7)}])
    source.run(state.debounced)
    got = spark.read.parquet(source.out).filter("root = 'r'").orderBy("flushed_at").collect()
    assert [((r.flushed_at - START) // datetime.timedelta(milliseconds=1), r.paths) for r in got] == plain_flushes(events)


def test_progress_of_tools_over_batches(spark, feed):
    rng = random.Random(2)
    rows = [{"seq": i, "event": rng.choice(["tool_start", "tool_start", "tool_done", "tool_error", "note"]), "tool": rng.choice("ab")} for i in range(90)]
    source = feed("seq long, event string, tool string")
    for n in range(0, 90, 30):
        source.add(rng.sample(rows[n : n + 30], 30))
        source.run(state.progress_stream)
    want = tracker.progress(spark.createDataFrame([(r["seq"], r["event"], r["tool"]) for r in rows], "seq long, event string, tool string"))
    got = state.read_latest(spark, source.out, ["tool", "seq"]).select("seq", "tool", "status")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_late_and_repeated_events_of_tools(spark, feed):
    source = feed("seq long, event string, tool string")
    for batch in ([(1, "tool_start"), (5, "tool_start")], [(3, "tool_done"), (3, "tool_done")], [(2, "tool_start")], [(9, "tool_error")]):
        source.add([{"seq": s, "event": e, "tool": "a"} for s, e in batch])
    source.run(state.progress_stream)
    assert {(r.seq, r.status, r.end) for r in state.read_latest(spark, source.out, ["tool", "seq"]).collect()} == {(1, "done", 3), (5, "error", 9), (2, "error", 9)}


def test_log_lines_in_any_order_give_the_batch_operators_table(spark, feed):
    rng = random.Random(3)
    lines = [json.dumps({"ts": at(rng.randrange(400_000)), "service": rng.choice(["s", "t", None]), "function": rng.choice("fgh"), "status": rng.choice(["ok", "slow", "down"]), "seq": i}) for i in range(120)]
    lines += lines[:15] + ["no json", "{}", json.dumps({"ts": at(1), "status": "ok"}), json.dumps({"service": "s", "status": "ok"}), ""]
    rng.shuffle(lines)
    source = feed(None)
    for n in range(0, len(lines), 45):
        source.add(lines[n : n + 45])
        source.run(state.log_status)
    got = state.read_latest(spark, source.out, ["node"])
    want = diagrams.latest_status(state.log_events(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert sorted(tuple(r) for r in got.select("node", "status", "ts").collect()) == sorted(tuple(r) for r in want.select("node", "status", "ts").collect())
    assert want.count() == 9 and want.filter(F.col("node").contains("null")).count() == 0
