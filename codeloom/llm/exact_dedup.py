"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import RepeatFilter, materialize, quoted, tie_break, whole_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_hash(text_col: str = "text") -> Column:
    """SHA-256 (lowercase hex) of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), 256)


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id
    stays.  Ids and hashes go to a narrow written table.  The Bloom filter's two passes run over it;
    only rows with a possibly repeated hash are shuffled, the rest pass straight through.  Counts are
    combined before the shuffle, so a group that holds a third of all rows is a few rows per task.

    Null text counts as empty.  A null id is less than any other.  Of rows that repeat both id and
    text, one is kept.  An empty table gives an empty result.  Other columns are not read.
    """
    hashes = materialize(docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_sha256")), "exact-hashes")
    marked = RepeatFilter(hashes, "text_sha256").mark(hashes, "text_sha256", "__maybe")
    rows = marked.filter("__maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("__rows"))
    # written, so that the join has plain shuffles on both sides, of which Spark can split a hot group
    groups = materialize(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("__rows").alias("group_size")), "exact-groups")
    shuffled = (
        rows.join(groups, "text_sha256")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"), "text_sha256")
    )
    alone = marked.filter("not __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(shuffled)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that find_copies does not keep, columns unchanged.

    Rows that the filter clears keep their place; only possibly repeated ones are shuffled, and of
    those the text moves once.  Of rows that repeat the kept id, in texts equal but for case too, the
    one with the largest hash of all columns stays.  Null text counts as empty, a null id is less than
    any other, an empty table stays empty, and no column name clashes with those used here.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text_hash(quoted(text_col)).alias("group"), tie_break(docs).alias("tie"), whole_row(docs).alias("row"))
    narrow = materialize(rows.select("id", "group", "tie"), "exact-hashes")
    bloom = RepeatFilter(narrow, "group")
    stay = bloom.mark(narrow, "group", "maybe").filter("maybe").groupBy(F.col("group").alias("of")).agg(F.max(F.struct("id", "tie")).alias("best"))
    marked = bloom.mark(rows, "group", "maybe")
    kept = marked.filter("maybe").join(stay, (F.col("group") == F.col("of")) & F.col("id").eqNullSafe(F.col("best.id")) & (F.col("tie") == F.col("best.tie")))
    return marked.filter("not maybe").select("row.*").unionByName(kept.dropDuplicates(["group"]).select("row.*"))
