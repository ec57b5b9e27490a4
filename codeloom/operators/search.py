"""Ranked retrieval over documents, identifiers and call sites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions import vectors as V
from codeloom.operators import providers
from codeloom.sources.scratch import written


def query_vector(values: list[float]) -> Column:
    """A query's vector as a literal: it is one row, however large the corpus."""
    return F.array(*[F.lit(float(x)) for x in values])


def nearest(vectors: DataFrame, query: Column, k: int) -> DataFrame:
    """The k rows (id, v) of greatest cosine, the least id among equals."""
    return vectors.select("id", F.round(V.cosine(V.doubles(F.col("v")), query), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


#: Decimals to which scores are ranked: sums in another order agree so far.
EXACT = 12


def hybrid_search(
    docs: DataFrame,
    query: str,
    vector: Column,
    k: int = 20,
    least: float = 0.1,
    least_semantic: float = 0.0,
    least_keyword: float = 0.0,
    semantic_weight: float = 0.72,
    keyword_weight: float = 0.28,
    require_semantic: bool = False,
    require_keyword: bool = False,
    ranked: bool = False,
) -> DataFrame:
    """Documents (id, text, symbols, v) ranked by weighted cosine and keywords, in percent.

    Ranks go by the scores before they are rounded, then by keywords and cosine, then by id; with
    ``ranked`` they are a column."""
    scored = docs.select("id", V.cosine(V.doubles(F.col("v")), vector).alias("sem"), T.keyword_score(query, F.col("text"), F.col("symbols")).alias("key"))
    both = T.combined_score(F.col("sem"), F.col("key"), semantic_weight, keyword_weight)
    held = scored.withColumn("both", both).filter((F.greatest("sem", F.lit(0.0)) >= least_semantic) & (F.col("key") >= least_keyword) & (F.col("both") >= least))
    if require_semantic:
        held = held.filter("sem > 0")
    if require_keyword:
        held = held.filter("key > 0")
    order = [*[F.desc(F.round(F.col(c), EXACT)) for c in ("both", "key", "sem")], "id"]
    best = held.orderBy(*order).limit(k)
    shown = ["id", T.percent(F.col("both")).alias("score"), T.percent(F.greatest("sem", F.lit(0.0))).alias("semantic_score"), T.percent(F.col("key")).alias("keyword_score")]
    return best.select(*shown, *([F.row_number().over(Window.orderBy(*order)).alias("rank")] if ranked else []))  # k rows


def search_documents(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, header, entries, symbols, content, text, embedded) of the files (relative_path, content) that are
    searched: code, and files of known text extensions; others are left out.

    Code is its header, symbols and signatures; text its first lines and first 4000 characters.
    ``entries`` has (name, line, end_line) of the symbols in order; keywords are looked for in ``text``,
    ``embedded`` is what gets a vector.
    """
    found = symbols.groupBy(F.col("file").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "line", "end_line", "signature"))).alias("entries"))
    path, content = F.col("relative_path"), F.col("content")
    kept = files.filter(T.is_supported(path) | T.is_text(path)).select(path.alias("id"), T.is_supported(path).alias("code"), content)
    first = F.substring(content, 1, 4000)
    held = kept.join(found, "id", "left").select("id", F.when(F.col("code"), T.code_header(content)).otherwise(T.plain_header(first)).alias("header"), "entries", "code", first.alias("first"))
    listed = lambda name: F.coalesce(F.array_join(F.transform("entries", lambda e: e[name]), " "), F.lit(""))
    read = held.withColumns({"symbols": listed("name"), "content": F.when(F.col("code"), listed("signature")).otherwise(F.col("first"))})
    text = {"text": F.concat_ws(" ", "id", "header", "symbols", "content"), "embedded": F.concat_ws(" ", "header", "symbols", "content")}
    return read.withColumns(text).select("id", "header", "entries", "symbols", "content", *text)


def matched_symbols(query: str, entries: Column) -> Column:
    """The entries (name, line, end_line) whose name has a term of the query, in order."""
    terms = F.array(*[F.lit(t) for t in T.query_terms(query)]).cast("array<string>")
    return F.filter(entries, lambda e: F.arrays_overlap(T.file_terms(e["name"]), terms))


def identifier_search(symbols: DataFrame, query: str, vector: Column, kinds: list[str] | None = None, k: int = 20, semantic_weight: float = 0.78, keyword_weight: float = 0.22) -> DataFrame:
    """Identifiers (id, kind, name, text, v) ranked by cosine and terms covered, before rounding; the
    least id among equals: (id, name, rank, score, semantic_score, keyword_score)."""
    wanted = [x.strip().lower() for x in kinds or [] if x.strip()]
    rows = symbols.filter(F.lower("kind").isin(*wanted)) if wanted else symbols
    key = T.coverage(T.identifier_terms(F.lit(query)), T.identifier_terms(F.col("text")))
    scored = rows.select("id", "name", F.greatest(V.cosine(V.doubles(F.col("v")), vector), F.lit(0.0)).alias("sem"), key.alias("key"))
    both = scored.withColumn("both", T.combined_score(F.col("sem"), F.col("key"), semantic_weight, keyword_weight))
    order = [F.desc(F.round("both", EXACT)), "id"]
    best = both.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    return best.select("id", "name", "rank", T.percent(F.col("both")).alias("score"), T.percent(F.col("sem")).alias("semantic_score"), T.percent(F.col("key")).alias("keyword_score"))


def rank_call_sites(sites: DataFrame, vector: Column, limit: int = 10, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """The second phase of call_sites: of preselected sites (name, file, line, key, v) the first
    ``limit`` of each name by 0.82 of cosine and 0.18 of keywords; without a vector cosine is 0.  The first
    of ``by`` takes the place of name, the rest is carried along."""
    semantic = F.coalesce(F.greatest(V.cosine(V.doubles(F.col("v")), vector), F.lit(0.0)), F.lit(0.0))
    score = F.least(F.lit(1.0), semantic * 0.82 + F.col("key") * 0.18)
    order = Window.partitionBy(by[0]).orderBy(F.desc(F.round("score", EXACT)), F.desc(F.round("key", EXACT)), "file", "line")
    ranked = sites.withColumns({"semantic": semantic, "score": score}).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, limit))
    return ranked.select(*by, "rank", "file", "line", T.percent(F.col("score")).alias("score"), T.percent(F.col("semantic")).alias("semantic_score"), T.percent(F.col("key")).alias("keyword_score"))


def call_sites(lines: DataFrame, names: DataFrame, limit: int = 10, query: str = "") -> DataFrame:
    """Call sites of each name, the first phase: the first ``limit`` by keywords; ``total`` counts all.
    Where rank_call_sites follows, ``limit`` is max(30, 4 times what is wanted).  Lines meet names by the names called on them, not by patterns."""
    called = lines.select("file", "line", "text", F.explode(F.array_distinct(T.calls_of(F.col("text")))).alias("name"))
    sites = called.join(names, "name").filter(~F.col("text").rlike(r"(?:function|class|enum|interface|struct|type|trait|fn|def|func)\s"))
    key = T.coverage(T.identifier_terms(F.lit(query)), T.identifier_terms(F.concat_ws(" ", "file", "text")))
    # the rank alone is filtered, so that each task keeps no more of a name than can be wanted
    order = Window.partitionBy("name").orderBy(F.desc("key"), "file", "line")
    ranked = sites.withColumn("key", key).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    totals = sites.groupBy("name").agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(totals, "name").select("name", "rank", "file", "line", T.percent(F.col("key")).alias("keyword_score"), "total")


#: An ASCII word's edge, on either side.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def identifier_calls(lines: DataFrame, symbols: DataFrame, query: str, vector: Column, limit: int = 10, provider: Callable = providers.hashed_vectors) -> DataFrame:
    """Where symbols (id, name, kind, file, line) are used in lines (file, line, text), ranked in two
    phases: (id, rank, file, line, context, score, semantic_score, keyword_score, total).

    A function or method is used where a parenthesis follows its name, anything else where its name
    stands as a word; lines that define it are left out.  Lines meet names by a word of the name and
    are then held against its pattern, so one pass serves all symbols; a name without any letter,
    digit or _ has no word and no site.  The first max(30, 4 * limit) of a symbol by keywords are
    embedded, ``limit`` of them stay, and ``total`` counts all.

    Symbols of one name have the same sites but for their own lines, so sites are found and ranked once
    for each name; a symbol then takes them from its name's list, which has one more than it can need.
    """
    limit = max(1, limit)
    most = max(30, 4 * limit)
    called = F.col("kind").isin("function", "method").alias("called")
    quoted = F.concat(F.lit("\\Q"), "name", F.lit("\\E"))
    pattern = F.concat(F.lit(EDGE), quoted, F.when(F.col("called"), r"\s*\(").otherwise(EDGE))
    word = F.regexp_extract("name", "[A-Za-z0-9_]+", 0)
    wanted = symbols.select("name", called).distinct().select("name", "called", pattern.alias("pattern"), quoted.alias("quoted"), word.alias("word")).filter("word <> ''")
    worded = lines.select("file", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("word"))
    found = worded.join(wanted, "word").filter(F.rlike("text", F.col("pattern")) & ~T.defines(F.col("text"), F.col("quoted")))
    context = F.substring(T.trimmed(F.col("text")), 1, 220)
    sites = written(found.select("name", "called", "file", F.col("line").cast("long").alias("line"), context.alias("context")), "call-sites")
    key = T.coverage(T.identifier_terms(F.lit(query)), T.identifier_terms(F.concat_ws(" ", "file", "context")))
    order = Window.partitionBy("name", "called").orderBy(F.desc("key"), "file", "line")
    chosen = sites.withColumn("key", key).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most + 1)
    places = chosen.select("file", "line", "context").distinct().select(F.struct("file", "line").alias("place"), F.concat_ws(" ", "file", "context").alias("text"))
    vectors = providers.embed_rows(places.select(F.to_json("place").alias("key"), "text"), provider=provider).withColumnRenamed("key", "place")
    held = chosen.withColumn("place", F.to_json(F.struct("file", "line"))).join(vectors, "place").withColumn("of", F.struct("name", "called"))
    ranked = rank_call_sites(held, vector, most + 1, ("of", "context", "at"))
    site = F.struct("rank", "at", "file", "line", "context", "score", "semantic_score", "keyword_score")
    lists = ranked.groupBy("of").agg(F.sort_array(F.collect_list(site)).alias("sites"))  # most + 1 at most
    totals = sites.groupBy(F.struct("name", "called").alias("of")).agg(F.count(F.lit(1)).alias("all"))
    users = symbols.select("id", F.struct("name", called).alias("of"), F.col("file").alias("own_file"), F.col("line").cast("long").alias("own_line"))
    # how often a symbol's own line is a site of its name
    own = users.join(sites.select(F.struct("name", "called").alias("of"), F.col("file").alias("own_file"), F.col("line").alias("own_line")), ["of", "own_file", "own_line"]).groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    is_own = lambda s: (s["file"] == F.col("own_file")) & (s["line"] == F.col("own_line"))
    met = users.join(lists, "of").join(totals, "of").join(own, "id", "left").withColumn("total", F.col("all") - F.coalesce("own", F.lit(0)))
    others = met.withColumn("others", F.filter("sites", lambda s: ~F.coalesce(is_own(s), F.lit(False))))
    spare = F.size(F.filter("sites", lambda s: F.coalesce(is_own(s), F.lit(False)) & (s["at"] <= most)))
    best = others.select("id", "total", F.posexplode(F.slice(F.filter("others", lambda s: s["at"] <= most + spare), 1, limit)).alias("n", "s"))
    shown = [F.col(f"s.{c}").alias(c) for c in ("file", "line", "score", "semantic_score", "keyword_score")]
    return best.select("id", F.col("s.context").alias("context"), (F.col("n") + 1).alias("rank"), *shown, "total")


def cached_vectors(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents (key, hash) with the cached vector of that key and hash; ``hit`` tells which are there."""
    held = cache.select("key", "hash", "v", F.lit(True).alias("there"))
    return docs.join(held, ["key", "hash"], "left").withColumn("hit", F.coalesce("there", F.lit(False))).drop("there")


def classify_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change) of two tables (key, hash): insert, delete, update or skip."""
    joined = old.withColumnsRenamed({"hash": "old"}).join(new.withColumnsRenamed({"hash": "new"}), "key", "full")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("skip")
    return joined.select("key", change.alias("change"))


def apply_changes(cache: DataFrame, fresh: DataFrame, deleted: DataFrame) -> DataFrame:
    """The cache without deleted and replaced keys, and the fresh rows."""
    gone = deleted.select("key").union(fresh.select("key")).distinct()
    return cache.join(gone, "key", "left_anti").unionByName(fresh)
