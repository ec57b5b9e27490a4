"""A streaming sink that hands events to subscribers, each with a bounded buffer."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Events that may wait for a subscriber; what comes beyond is dropped.
BUFFER = 64
#: Seconds without an event after which a heartbeat goes out.
HEARTBEAT = 30


def frame(event: str, data: str) -> str:
    """An event as server-sent text; data is JSON."""
    return f"event: {event}\ndata: {data}\n\n"


class Mailboxes:
    """Subscribers in a folder: a file of frames for each batch, and how many frames were read.

    The folder is a path or URI that pyarrow can open and that all drivers share.
    """

    def __init__(self, path: str):
        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.rstrip("/"))

    def _read(self, name: str, default: str = "") -> str:
        if self.files.get_file_info(name).type == fs.FileType.NotFound:
            return default
        with self.files.open_input_stream(name) as f:
            return f.read().decode()

    def _write(self, name: str, text: str) -> None:
        """Replaces a file in one step."""
        with self.files.open_output_stream(f"{name}.aside") as f:
            f.write(text.encode())
        self.files.move(f"{name}.aside", name)

    def subscribe(self, name: str) -> None:
        self.files.create_dir(f"{self.path}/{name}", recursive=True)

    def unsubscribe(self, name: str) -> None:
        self.files.delete_dir(f"{self.path}/{name}")

    def subscribers(self) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == fs.FileType.Directory)

    def _batches(self, name: str) -> list[tuple[int, dict]]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.path}/{name}"))
        numbers = sorted(int(x.base_name[6:-5]) for x in found if x.base_name.startswith("batch-") and x.base_name.endswith(".json"))
        return [(n, json.loads(self._read(f"{self.path}/{name}/batch-{n}.json"))) for n in numbers]

    def deliver(self, batch: int, events: list[tuple[str, str]], now: float, beyond: int = 0) -> None:
        """Puts a batch's events into each buffer as far as there is room; a batch that is done again changes
        nothing, so each event is delivered once.  ``beyond`` counts more events, behind more of these
        than any buffer takes."""
        for name in self.subscribers():
            held = self._batches(name)
            if any(n >= batch for n, _ in held):
                continue
            waiting = sum(len(b["frames"]) for _, b in held) - int(self._read(f"{self.path}/{name}/read", "0"))
            room = max(0, BUFFER - waiting)
            frames = [frame(*e) for e in events[:room]]
            last = max((b["at"] for _, b in held), default=None)
            if not events and last is not None and now - last < HEARTBEAT:
                continue
            if not events and room:
                frames = [frame("heartbeat", json.dumps({"t": int(now)}))] if last is not None else []
            self._write(f"{self.path}/{name}/batch-{batch}.json", json.dumps({"at": now, "frames": frames, "dropped": max(0, len(events) - room) + beyond}))

    def take(self, name: str) -> list[str]:
        """The frames that a subscriber has not read yet; they leave its buffer."""
        every = [f for _, b in self._batches(name) for f in b["frames"]]
        seen = int(self._read(f"{self.path}/{name}/read", "0"))
        self._write(f"{self.path}/{name}/read", str(len(every)))
        return every[seen:]

    def dropped(self, name: str) -> int:
        return sum(b["dropped"] for _, b in self._batches(name))


@dataclass
class First(WriterCommitMessage):
    """A task's first events in order, and how many it had."""

    events: list
    n: int


class EventWriter(DataSourceStreamWriter):
    """Tasks send on the first events that any buffer could take, so what meets on the driver is bounded
    by the tasks; the commit puts them in order and delivers them."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> First:
        held, n = [], 0
        for row in iterator:
            n += 1
            held.append((row["seq"], row["event"], row["data"]))
            if len(held) >= 4 * BUFFER:
                held = sorted(held)[:BUFFER]
        return First(sorted(held)[:BUFFER], n)

    def commit(self, messages: list[First | None], batchId: int) -> None:  # noqa: N803
        told = [m for m in messages if m is not None]
        events = [(event, data) for _, event, data in sorted(e for m in told for e in m.events)]
        Mailboxes(self.path).deliver(batchId, events, time.time(), sum(m.n for m in told) - len(events))

    def abort(self, messages: list[First | None], batchId: int) -> None:  # noqa: N803
        """Nothing was delivered."""


class EventStream(DataSource):
    """The sink "event_stream" for rows (event, data, seq): ``spark.dataSource.register(EventStream)``, then
    ``writeStream.format("event_stream").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "event_stream"

    def streamWriter(self, schema: StructType, overwrite: bool) -> EventWriter:  # noqa: N802
        missing = {"event", "data", "seq"} - set(schema.names)
        if missing:
            raise ValueError(f"event_stream needs the columns event, data and seq; there is no {', '.join(sorted(missing))}")
        return EventWriter(self.options["path"])
