"""Source divergence audit: which terms, and which other sources, a source of a language departs from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._common import materialize, quoted
from codeloom.llm._terms import NO_LETTERS, count_terms


def share(count: str, size: str) -> str:
    """1 + floor(10^9 (count + 1) / size) in 64-bit integers, by three digits to base 1000: exact for
    sizes up to 9 * 10^15."""
    first = f"(({count}) + 1) * 1000"
    second = f"({first}) % ({size}) * 1000"
    third = f"({second}) % ({size}) * 1000"
    return f"(1 + ({first}) div ({size}) * 1000000 + ({second}) div ({size}) * 1000 + ({third}) div ({size}))"


def departure(p: str, q: str) -> str:
    """floor((p - q)^2 / q)."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def term_vectors(docs: DataFrame, groups: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, vector) of the terms in at least ``least_docs`` documents of the language: a sparse
    array of (at, n), by the place of a source among its language's, of the sources that have it.

    Rows are combined by (lang, source, term) in each task before they are shuffled, so neither a hot
    source nor a frequent term is more than a row of a task.
    """
    counted = count_terms(docs, "text", NO_LETTERS).select("lang", "source", F.inline_outer("terms")).filter("term is not null")
    sums = counted.groupBy("lang", "source", "term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))
    placed = sums.join(groups, ["lang", "source"])
    wide = placed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("vector"))
    return wide.filter(F.col("docs") >= least_docs).select("lang", "term", "vector")


def _pair_values(vectors: DataFrame, levels: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, s, t, value): the departures of s from t summed over all terms.

    Most terms are in few sources, so sums start from f(0, 0) for every term, add the difference that
    a count of one source alone makes, from ``levels`` (how many terms have that count there), and
    then, for terms that both sources have, what those two differences miss.  Integers, so exact; the
    work goes with the pairs of sources that share a term, not with all pairs for each term.
    """
    none = langs.select("lang", "terms", F.expr(f"transform(sizes, size -> {share('0', 'size')})").alias("none"))
    every = none.select("lang", "terms", "none", F.posexplode("none").alias("s", "p0"))
    every = every.select("lang", "terms", "s", "p0", F.posexplode("none").alias("t", "q0")).filter("s <> t")
    start = every.select("lang", "s", "t", F.expr(f"terms * {departure('p0', 'q0')}").alias("value"))

    held = levels.join(langs.select("lang", "sizes"), "lang").join(none.select("lang", "none"), "lang")
    shared = held.select("lang", "at", "with", "none", F.expr(share("n", "sizes[at]")).alias("p"), F.expr("none[at]").alias("p0"))
    other = shared.select("lang", "at", "with", "p", "p0", F.posexplode("none").alias("to", "q0")).filter("at <> to")
    here, there = (f"`with` * ({departure(a, b)} - {departure(c, d)})" for a, b, c, d in (("p", "q0", "p0", "q0"), ("q0", "p", "q0", "p0")))
    alone = other.select("lang", F.expr(f"inline(array(named_struct('s', at, 't', to, 'value', {here}), named_struct('s', to, 't', at, 'value', {there})))"))

    known = vectors.join(langs.select("lang", "sizes"), "lang")
    shares = known.select("lang", F.expr(f"transform(vector, e -> named_struct('at', e.at, 'p', {share('e.n', 'sizes[e.at]')}, 'p0', {share('0', 'sizes[e.at]')}))").alias("v"))
    both = lambda a, b: f"{departure(f'{a}.p', f'{b}.p')} - {departure(f'{a}.p', f'{b}.p0')} - {departure(f'{a}.p0', f'{b}.p')} + {departure(f'{a}.p0', f'{b}.p0')}"
    pair = f"named_struct('s', a.at, 't', b.at, 'st', {both('a', 'b')}, 'ts', {both('b', 'a')})"
    emitted = shares.filter("size(v) > 1").select("lang", F.expr(f"inline_outer(flatten(transform(v, (a, i) -> transform(slice(v, i + 2, size(v)), b -> {pair}))))"))
    summed = emitted.groupBy("lang", "s", "t").agg(F.sum("st").alias("st"), F.sum("ts").alias("ts"))
    together = summed.select("lang", F.expr("inline(array(named_struct('s', s, 't', t, 'value', st), named_struct('s', t, 't', s, 'value', ts)))"))
    return start.unionByName(alone).unionByName(together).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def source_divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) that occurs.

    Terms are runs of letters and of signs beyond ASCII, A-Z lower-cased; a language keeps those in at
    least ``least_docs`` of its rows.  A group gives each kept term the share p = 1 + floor(10^9 (n + 1)
    / (N + V)) of its N occurrences of V terms.  Part ``pair`` has each other source of the language
    with the departures floor((p - q)^2 / q) from its shares, summed over all kept terms; part ``term``
    the first ``most_terms`` terms of the group whose share is above that in the whole language.

    Each term's counts are pivoted into a sparse array by source, from which higher-order functions
    emit the contributions of pairs of sources; they are summed in each task before a shuffle.  What is
    joined by language is one row for each, as wide as it has sources, like the result for a group.

    Null language, source and text count as empty.  A group without terms has N = 0; without any kept
    term its departures are 0.  Repeated rows are documents of their own.  An empty table gives an
    empty result.  Other columns are not read, whatever their names.
    """
    blank = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), F.col(quoted(text_col)).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(rows.select("lang", "source").distinct().withColumn("at", place), "divergence-groups")
    vectors = materialize(term_vectors(rows, groups, least_docs), "divergence-vectors")
    levels = materialize(vectors.select("lang", F.inline("vector")).groupBy("lang", "at", "n").agg(F.count(F.lit(1)).alias("with")), "divergence-levels")

    sizes = levels.groupBy("lang", "at").agg(F.sum(F.col("n") * F.col("with")).alias("size"))
    kept = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    known = groups.join(sizes, ["lang", "at"], "left").join(kept, "lang", "left").na.fill(0, ["size", "terms"])
    listed = known.groupBy("lang", "terms").agg(F.sort_array(F.collect_list(F.struct("at", "source", "size"))).alias("of"), F.sum("size").alias("size"))
    langs = materialize(listed.select("lang", "terms", (F.col("size") + F.col("terms")).alias("size"), F.col("of.source").alias("sources"), F.expr("transform(of, g -> greatest(g.size + terms, 1))").alias("sizes")), "divergence-langs")

    values = _pair_values(vectors, levels, langs)
    pairs = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("at").alias("to")), "lang").filter("at <> to")
    valued = pairs.join(values.withColumnsRenamed({"s": "at", "t": "to"}), ["lang", "at", "to"], "left")
    pair = valued.select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    pair = pair.withColumn("rank", _ranked(pair)).withColumn("part", F.lit("pair"))

    known = vectors.join(langs.select("lang", "size", "sizes", "sources"), "lang")
    total = "aggregate(vector, 0L, (a, e) -> a + e.n)"
    entries = known.select("lang", "term", "sizes", "sources", F.expr(share(total, "size")).alias("q"), F.inline("vector"))
    above = entries.select("lang", F.expr("sources[at]").alias("source"), F.col("term").alias("item"), "q", F.expr(share("n", "sizes[at]")).alias("p")).filter("p > q")
    term = above.select("lang", "source", "item", F.expr(departure("p", "q")).alias("value"))
    term = term.withColumn("rank", _ranked(term)).filter(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")
