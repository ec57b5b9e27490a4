import json
import threading

import pytest
from codeloom.operators.restore import RestorePoints
from codeloom.operators.workspace import Workspace
from codeloom.sources.versions import VersionedTable
from pyspark.sql import functions as F

SCHEMA = "id long, name string"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "table"), SCHEMA, ["id"], kept=3)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(table, version=None):
    return sorted(((r.id, r.name) for r in table.read(version).collect()), key=str)


def test_merge_delete_and_retention(spark, table):
    assert held(table) == []
    table.merge(rows(spark, (1, "a"), (2, "b"), (None, "n")))
    table.merge(rows(spark, (2, "B"), (3, "c"), (None, "N")))
    assert held(table) == [(1, "a"), (2, "B"), (3, "c"), (None, "N")]
    assert held(table, 1) == [(1, "a"), (2, "b"), (None, "n")]
    table.delete(rows(spark, (1, ""), (9, "")))
    table.merge(rows(spark, (4, "d")))
    assert held(table) == [(2, "B"), (3, "c"), (4, "d"), (None, "N")]
    assert table.versions() == [2, 3, 4]


def test_two_writers_lose_nothing(spark, table):
    table.merge(rows(spark, (0, "start")))
    failed = []

    def work(first):
        try:
            for i in range(3):
                table.merge(rows(spark, (first + i, f"w{first}")))
        except Exception as error:  # shown by the assertion
            failed.append(error)

    writers = [threading.Thread(target=work, args=(n,)) for n in (10, 20)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    assert [i for i, _ in held(table)] == [0, 10, 11, 12, 20, 21, 22]


def test_the_second_to_publish_starts_again(spark, table):
    assert table.publish(rows(spark, (1, "mine")), 0)
    assert not table.publish(rows(spark, (1, "other")), 0)
    assert held(table) == [(1, "mine")] and table.versions() == [1]


def test_half_written_versions_are_not_read(spark, table, tmp_path):
    table.merge(rows(spark, (1, "a")))
    rows(spark, (2, "torn")).write.parquet(str(tmp_path / "table" / "_aside-x"))
    (tmp_path / "table" / "v-2").mkdir()  # without its mark
    assert held(table) == [(1, "a")]


def test_workspace(spark, tmp_path):
    space = Workspace(spark, str(tmp_path))
    now = F.lit("2024-01-01").cast("timestamp")
    for r in ("r1", "r2"):
        space.add_repo(r, f"https://host/{r}", now)
    for d, r in (("d1", "r1"), ("d2", "r2"), ("d3", "r2")):
        space.save_diagram(d, r, d.upper(), "{}", now)
    space.repo_ready("r1", 7, now)
    space.rename_diagram("d1", "new", now)
    assert space.active() == {"repo": "r2", "diagram": "d3"}
    assert {r.id: (r.ready, r.symbol_count) for r in space.repos.read().collect()} == {"r1": (True, 7), "r2": (False, None)}
    space.remove_repos(spark.createDataFrame([("r2",)], "id string"))
    assert {r.id: r.name for r in space.diagrams.read().collect()} == {"d1": "new"}
    assert space.active() == {"repo": None, "diagram": None}
    space.activate("diagram", "d1")
    space.remove_diagrams(spark.createDataFrame([("none",)], "id string"))
    assert space.active()["diagram"] == "d1"


def test_restore_points_of_writers_at_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    points = RestorePoints(spark, str(tmp_path), most=12)
    writers = [threading.Thread(target=lambda n=n: [points.create(["a.txt", "none"], f"w{n}-{i}") for i in range(5)]) for n in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    found = points.points().collect()
    assert {r.message for r in found} == {f"w{n}-{i}" for n in range(2) for i in range(5)} and all(r.files == ["a.txt"] for r in found)
    manifest = tmp_path / points.folder / "manifest.json"
    manifest.write_text(manifest.read_text() + "torn {\n" + json.dumps({"no": "point"}) + "\n")
    for i in range(4):
        points.create([], f"last{i}")
    assert points.points().count() == 12 and manifest.read_text().count("torn") == 0
    (tmp_path / "a.txt").write_text("two")
    assert points.restore(found[-1].id) == ["a.txt"] and (tmp_path / "a.txt").read_text() == "one"
