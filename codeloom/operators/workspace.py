"""Tables of a workspace: trees (id, ready, symbol_count, scanned_at, ...) and saved diagrams (id, repo_id, edited_at, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.versions import VersionedTable

REPOS = "id string, url string, ready boolean, symbol_count int, added_at timestamp, scanned_at timestamp"
DIAGRAMS = "id string, repo_id string, name string, content string, added_at timestamp, edited_at timestamp"
ACTIVE = "kind string, id string"


def changed(table: DataFrame, id_: str, **values: object) -> DataFrame:
    """The table with new values in the row of an id; an unknown id changes nothing."""
    mine = F.col("id").eqNullSafe(F.lit(id_))
    new = {c: F.when(mine, v if isinstance(v, Column) else F.lit(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    return table.withColumns(new)


def marked_ready(repos: DataFrame, id_: str, now: Column, symbol_count: int | None = None) -> DataFrame:
    return changed(repos, id_, ready=True, symbol_count=symbol_count, scanned_at=now)


def renamed(diagrams: DataFrame, id_: str, name: str, now: Column) -> DataFrame:
    return changed(diagrams, id_, name=name, edited_at=now)


def touched(diagrams: DataFrame, id_: str, now: Column) -> DataFrame:
    return changed(diagrams, id_, edited_at=now)


def without_repos(repos: DataFrame, diagrams: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees and diagrams without those of the trees ``gone`` (id); a diagram of an unknown tree stays."""
    return repos.join(gone.select("id"), "id", "left_anti"), diagrams.join(gone.select(F.col("id").alias("repo_id")), "repo_id", "left_anti").select(*diagrams.columns)


class Workspace:
    """The tables of a workspace in a folder, and which tree and diagram are active.

    Each change publishes a new version of a table; see VersionedTable.  Removing trees takes their
    diagrams first, so that a diagram never outlives its tree, and resets what was active of them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.repos = VersionedTable(spark, f"{path}/repos", REPOS, ["id"])
        self.diagrams = VersionedTable(spark, f"{path}/diagrams", DIAGRAMS, ["id"])
        self.pointers = VersionedTable(spark, f"{path}/active", ACTIVE, ["kind"])

    def _row(self, schema: str, **values: object) -> DataFrame:
        fields = self.spark.createDataFrame([], schema).schema.fields
        cells = [(v if isinstance(v, Column) else F.lit(v)) if (v := values.get(f.name)) is not None else F.lit(None) for f in fields]
        return self.spark.range(1).select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cells, fields, strict=True)])

    def add_repo(self, id_: str, url: str, now: Column | None = None) -> None:
        """A tree that is not ready yet; it becomes the active one."""
        self.repos.merge(self._row(REPOS, id=id_, url=url, ready=False, added_at=F.current_timestamp() if now is None else now))
        self.activate("repo", id_)

    def repo_ready(self, id_: str, symbol_count: int, now: Column | None = None) -> None:
        self.repos.change(lambda t: marked_ready(t, id_, F.current_timestamp() if now is None else now, symbol_count))

    def save_diagram(self, id_: str, repo_id: str, name: str, content: str, now: Column | None = None) -> None:
        at = F.current_timestamp() if now is None else now
        self.diagrams.merge(self._row(DIAGRAMS, id=id_, repo_id=repo_id, name=name, content=content, added_at=at, edited_at=at))
        self.activate("diagram", id_)

    def rename_diagram(self, id_: str, name: str, now: Column | None = None) -> None:
        self.diagrams.change(lambda t: renamed(t, id_, name, F.current_timestamp() if now is None else now))

    def touch_diagram(self, id_: str, now: Column | None = None) -> None:
        self.diagrams.change(lambda t: touched(t, id_, F.current_timestamp() if now is None else now))

    def activate(self, kind: str, id_: str | None) -> None:
        self.pointers.merge(self._row(ACTIVE, kind=kind, id=id_))

    def active(self) -> dict[str, str | None]:
        return {r.kind: r.id for r in self.pointers.read().collect()}  # two rows

    def _reset(self, kind: str, left: DataFrame) -> None:
        here = self.active().get(kind)
        if here is not None and left.filter(F.col("id") == here).isEmpty():
            self.activate(kind, None)

    def remove_diagrams(self, gone: DataFrame) -> None:
        self.diagrams.delete(gone.select("id"))
        self._reset("diagram", self.diagrams.read())

    def remove_repos(self, gone: DataFrame) -> None:
        """Trees ``gone`` (id) with their diagrams."""
        self.diagrams.change(lambda t: without_repos(self.repos.read(), t, gone)[1])
        self.repos.delete(gone.select("id"))
        self._reset("diagram", self.diagrams.read())
        self._reset("repo", self.repos.read())
