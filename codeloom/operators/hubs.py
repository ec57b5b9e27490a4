"""Hubs: markdown files that link features to source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T


def hubs_of(files: DataFrame) -> DataFrame:
    """(hub, title, content) of markdown files with a link, in order of path; the title is the first
    heading, else the file's name."""
    found = files.filter(F.lower("relative_path").endswith(".md") & F.col("content").rlike(r"\[\[[^\]]+\]\]"))
    heading = F.nullif(T.trimmed(F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    name = F.regexp_replace(F.element_at(F.split("relative_path", "/"), -1), r"\.md$", "")
    return found.select(F.col("relative_path").alias("hub"), F.coalesce(heading, name).alias("title"), "content").orderBy("hub")


def hub_links(hubs: DataFrame) -> DataFrame:
    """(hub, ordinal, target, description), the first of equal targets."""
    each = hubs.select("hub", F.posexplode(T.wiki_links(F.col("content"))).alias("ordinal", "link")).select("hub", "ordinal", "link.target", "link.description")
    return each.withColumn("n", F.row_number().over(Window.partitionBy("hub", "target").orderBy("ordinal"))).filter("n = 1").drop("n")


def cross_links(hubs: DataFrame) -> DataFrame:
    """(hub_name, source_file) of links from hub to hub."""
    return hubs.select(F.explode(T.cross_links(F.col("content"))).alias("hub_name"), F.col("hub").alias("source_file"))


def resolved(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links with whether their target is a file."""
    there = files.select(F.col("relative_path").alias("target"), F.lit(True).alias("found"))
    return links.join(there, "target", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def orphans(files: DataFrame, hubs: DataFrame) -> DataFrame:
    """Files that no hub links to, hubs and other markdown left out."""
    linked = hub_links(hubs).select(F.col("target").alias("relative_path")).union(hubs.select(F.col("hub").alias("relative_path"))).distinct()
    return files.filter(~F.lower("relative_path").endswith(".md")).select("relative_path").join(linked, "relative_path", "left_anti").orderBy("relative_path")


def find_hub(hubs: DataFrame, name: str) -> DataFrame:
    """The hub of a name: its file's exactly, else the first path that contains it."""
    low, wanted = F.lower("hub"), name.lower()
    exact = (low == f"{wanted}.md") | low.endswith(f"/{wanted}.md")
    return hubs.filter(exact | F.contains(low, F.lit(wanted))).orderBy(~exact, "hub").limit(1)
