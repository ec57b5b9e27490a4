import json

from codeloom.streaming.events import BUFFER, HEARTBEAT, EventStream, Mailboxes, frame


def test_round_trip_with_a_restart(spark, tmp_path):
    spark.dataSource.register(EventStream)
    source, boxes = tmp_path / "in", Mailboxes(str(tmp_path / "out"))
    source.mkdir()

    def run(rows, name):
        (source / name).write_text("\n".join(json.dumps({"event": e, "data": json.dumps({"n": n}), "seq": n}) for e, n in rows) + "\n")
        stream = spark.readStream.schema("event string, data string, seq long").json(str(source)).repartition(3)
        stream.writeStream.format("event_stream").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(60)

    boxes.subscribe("slow")
    boxes.subscribe("quick")
    run([("scan", n) for n in range(40)], "a.json")
    want = [frame("scan", json.dumps({"n": n})) for n in range(40)]
    assert boxes.take("quick") == want
    boxes.subscribe("late")
    run([("done", n) for n in range(40, 90)], "b.json")
    more = [frame("done", json.dumps({"n": n})) for n in range(40, 90)]
    assert boxes.take("quick") == more and boxes.take("late") == more
    assert boxes.take("slow") == want + more[: BUFFER - 40] and boxes.dropped("slow") == 90 - BUFFER
    assert boxes.take("slow") == [] and boxes.dropped("quick") == 0
    run([("big", n) for n in range(100, 400)], "c.json")
    assert boxes.take("quick") == [frame("big", json.dumps({"n": n})) for n in range(100, 100 + BUFFER)] and boxes.dropped("quick") == 300 - BUFFER
    boxes.unsubscribe("late")
    assert boxes.subscribers() == ["quick", "slow"]


def test_a_batch_is_delivered_once_and_heartbeats_fill_the_silence(tmp_path):
    boxes = Mailboxes(str(tmp_path))
    boxes.subscribe("a")
    for _ in range(2):
        boxes.deliver(0, [("x", "{}")], 100.0)
    assert boxes.take("a") == [frame("x", "{}")]
    boxes.deliver(1, [], 100.0 + HEARTBEAT - 1)
    assert boxes.take("a") == []
    boxes.deliver(2, [], 100.0 + HEARTBEAT)
    assert boxes.take("a") == [frame("heartbeat", json.dumps({"t": 130}))]
    assert Mailboxes(str(tmp_path / "none")).subscribers() == []
