"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap row: what bitmap_construct_agg packs into 4096 bytes.
BLOCK_BITS = 32768


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where neither the session nor the context names one and all runs on this machine, as in
    tests, a temporary folder is made and set; on a cluster, where executors would each write to
    their own disk, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            base = tempfile.mkdtemp(prefix="codeloom-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables written inside each released() that is open, the innermost last.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def released() -> Iterator[None]:
    """At its end the tables that materialize wrote inside are removed, except those that outlive it.
    What is computed from them has to be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for table in _OPEN.pop():
            discard(table)


def materialize(df: DataFrame, name: str, outlives: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, so a lost executor
    costs a re-read and not a recomputation.  With ``by`` it has a folder for each value of those."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    if _OPEN and not outlives:
        _OPEN[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Removes a table made by materialize, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str, text_col: str) -> Column:
    """64 bits that stand for a row's id and text: joins on it survive null and repeated ids.
    Rows that agree in both are one document, returned as often as it occurs."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def named(column: str, name: str) -> Column:
    """The column under a name.  Without a needless alias, since plans that differ in one alone do
    not share their shuffles."""
    return F.col(column) if column == name else F.col(column).alias(name)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns clash with none of them."""
    return F.struct(*columns_of(df.columns))


def tie_break(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: rows that agree in it are alike."""
    return F.xxhash64(*[F.col(quoted(f.name)) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names: an operator's own output columns replace them."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as an expression, dots and backticks in it included."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(names: list[str]) -> list[Column]:
    return [F.col(quoted(c)) for c in names]


def sample_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows with different hashes in column h.

    Rows are thinned by their hash first, to about one and a half times as many different ones, so
    that what tasks send on does not grow with their number; the number of different hashes is an
    estimate (HyperLogLog, 2 %).  Rows of one hash are one, so that a text with many copies counts
    once; which copy's other columns it gets is the least of them.
    """
    different = rows.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if different > 1.5 * most:
        rows = rows.filter(F.col("h") < int(1.5 * most / different * 2**64) - 2**63)
    others = [c for c in rows.columns if c != "h"]
    return rows.groupBy("h").agg(F.min(F.struct(*others)).alias("__row")).orderBy("h").limit(most).select("h", "__row.*")


class RepeatFilter:
    """A blocked Bloom filter of the values that occur in two rows or more of a column.

    The first pass counts 64-bit hashes of the values, combined in each task before the shuffle; only
    repeated ones enter the filter, with ``bits_each`` bits for each, so its size goes with the
    repeats and not with the rows.  The second pass, ``mark``, looks rows up.  A repeated value is
    never missed.  Where the filter would take more than ``max_bits`` (64 MiB by default) it isn't
    broadcast: rows are then looked up in the written table of repeated hashes by a join, which
    shuffles the rows given to ``mark`` but changes no result.

    ``counts`` is that table: (hash, n) of the repeated hashes.  With ``hashed`` the column is a 64-bit
    hash already.
    """

    def __init__(self, df: DataFrame, hash_col: str, hashes: int = 2, bits_each: int = 16, max_bits: int = 1 << 29, hashed: bool = False):
        self.hashes = hashes
        self.hashed = hashed
        counted = df.select(self.value(hash_col).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        self.counts = materialize(counted.filter("n > 1"), "repeated-hashes")
        repeated = self.counts.count()
        self.broadcast = repeated * bits_each <= max_bits
        self.blocks = max(1, math.ceil(repeated * bits_each / BLOCK_BITS))

    def value(self, hash_col: str) -> Column:
        return F.col(hash_col) if self.hashed else F.xxhash64(F.lit(11), hash_col)

    def _place(self, value: Column) -> tuple[Column, list[Column]]:
        """A hash's block, and its bits in the block."""
        return F.pmod(value, F.lit(self.blocks)), [F.pmod(F.xxhash64(F.lit(seed), value), F.lit(BLOCK_BITS)) for seed in range(22, 22 + self.hashes)]

    def _bitmaps(self) -> DataFrame:
        block, bits = self._place(F.col("hash"))
        slots = self.counts.select(block.alias("__block"), F.explode(F.array(*bits)).alias("__slot"))
        return slots.groupBy("__block").agg(F.bitmap_construct_agg(F.col("__slot")).alias("__bits"))

    def mark(self, df: DataFrame, hash_col: str, flag: str) -> DataFrame:
        """df with boolean ``flag``: false only where no other row has the value."""
        if not self.broadcast:
            value = fresh(df.columns, "__value")[0]
            known = self.counts.select(F.col("hash").alias(value), F.lit(True).alias(flag))
            joined = df.withColumn(value, self.value(hash_col)).join(known, value, "left")
            return joined.withColumn(flag, F.coalesce(flag, F.lit(False))).drop(value)
        block, bits = self._place(self.value(hash_col))
        names = fresh(df.columns, "__block", "__bits", *[f"__bit{i}" for i in range(len(bits))])
        at = dict(zip(names[2:], bits, strict=True))
        bitmaps = self._bitmaps().withColumnsRenamed({"__block": names[0], "__bits": names[1]})
        held = df.withColumns({names[0]: block} | at).join(F.broadcast(bitmaps), names[0], "left")
        hit = F.col(names[1]).isNotNull()
        for name in at:
            byte = F.expr(f"conv(hex(substring({names[1]}, cast({name} div 8 as int) + 1, 1)), 16, 10)").cast("int")
            hit = hit & (byte.bitwiseAND(F.expr(f"shiftleft(1, cast({name} % 8 as int))")) != 0)
        return held.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(*names)

    def only(self, df: DataFrame, hash_col: str, count: str) -> DataFrame:
        """The rows whose value (a hash already) is repeated, with how often it occurs: what the filter
        passes is joined with the counts."""
        flag = fresh(df.columns, "__maybe")[0]
        rows = self.mark(df, hash_col, flag).filter(flag).drop(flag) if self.broadcast else df
        return rows.join(self.counts.select(F.col("hash").alias(hash_col), F.col("n").alias(count)), hash_col)
