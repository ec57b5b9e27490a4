"""Queries over the driver's tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions import vectors as V
from codeloom.operators import chains, clustering, code, diagrams, graph, hubs, messages, search, spectral, tree, usage_index
from codeloom.operators.store import GraphStore
from codeloom.operators.symbols import extract_symbols
from codeloom.operators.usage_index import UsageIndex
from codeloom.sources.scratch import scratch_path
from codeloom.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name, and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def one_file(self, name: str) -> bool:
        """Whether a table is a file and not a folder of files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()

    @property
    def code_lines(self) -> DataFrame:
        """Source-like lines made of part's rows, the same in SQL below."""
        first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
        capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))
        camel, pascal = F.concat(first, capital(second)), capital(first)
        forms = [F.concat(F.lit("// "), "p_type", F.lit(" part")), F.concat(F.lit("export function "), camel, F.lit("() {")), F.concat(F.lit("  return "), camel, F.lit("(x);")),
                 F.concat(F.lit("  db.query("), camel, F.lit(");")), F.concat(F.lit("class "), pascal, F.lit(" {")), F.lit("}"), F.concat(F.lit("  if (ok) { "), camel, F.lit("(); }")), F.lit("}")]
        text = F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))
        line = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
        return self.part.select(F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(".ts")).alias("file"), line.cast("long").alias("line"), text.alias("text"))

    @property
    def code_files(self) -> DataFrame:
        """code_lines put together to files (file, content)."""
        content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
        return self.code_lines.groupBy("file").agg(content.alias("content"))

    @property
    def code_symbols(self) -> DataFrame:
        """The symbols that are extracted from code_files."""
        return extract_symbols(self.code_files, "file", "content").withColumn("line", F.col("line").cast("long"))

    @property
    def cyclic(self) -> DataFrame:
        """Two edges from each supplier, with cycles."""
        s = self.supplier
        n = s.count()
        return s.select(F.col("s_suppkey").alias("src"), F.explode(F.array((F.col("s_suppkey") * 3 + 1) % n, (F.col("s_suppkey") * 5 + 2) % n)).alias("dst"))

    @property
    def tree(self) -> DataFrame:
        """Regions, nations and customers as (path, parent, name, depth)."""
        r, n, c = self.region, self.nation, self.customer
        regions = r.select(F.col("r_name").alias("path"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(0).alias("depth"))
        nations = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("r_name").alias("parent"), F.col("n_name").alias("name"), F.lit(1).alias("depth"), "n_nationkey")
        customers = c.join(F.broadcast(nations), c.c_nationkey == nations.n_nationkey).select(F.concat_ws("/", "path", "c_name").alias("path"), F.col("path").alias("parent"), F.col("c_name").alias("name"), F.lit(2).alias("depth"))
        return regions.unionByName(nations.drop("n_nationkey")).unionByName(customers)

    @property
    def many_lines(self) -> DataFrame:
        """code_lines as files of several languages, by the last digit of the brand."""
        digit = F.substring("file", -4, 1)
        end = F.when(digit == "1", ".py").when(digit == "2", ".rb").when(digit == "3", ".lua").when(digit == "4", ".txt").when(digit == "5", ".PY").otherwise(".ts")
        hashed = F.col("text").startswith("//") & digit.isin("1", "2")
        mark = F.when(F.col("line") % 7 == 0, "#!").otherwise("#")
        text = F.when(F.col("line") == 1, F.concat(F.when(digit.isin("1", "2"), "#").when(digit == "3", "--").otherwise("//"), F.lit(" what it is")))
        text = text.when(F.col("line") == 2, F.concat(F.when(digit.isin("1", "2"), "#").when(digit == "3", "--").otherwise("//"), F.when(F.substring("file", -5, 1) == "1", " feature: x").otherwise(" more")))
        text = text.when(hashed, F.concat(mark, F.substring("text", 3, 1000))).otherwise(F.col("text"))
        return self.code_lines.select(F.concat(F.expr("substr(file, 1, length(file) - 3)"), end).alias("file"), "line", text.alias("text"))

    def vector_of(self, at: int) -> list[float]:
        return [float(x) for x in self.embeddings.filter(F.col("vec_id") == at).first().embedding]

    @property
    def links(self) -> DataFrame:
        """Pages with their anchors written as [[target|description]]."""
        text = F.regexp_replace("html", '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "[[$1|$2]]")
        return self.pages.select("page_id", "url", text.alias("text"), F.regexp_replace("html", '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "@linked-to [[$1]]").alias("crossed"))


CODE_LINES = """code_lines AS (
    SELECT 'src/' || lower(replace(p_brand, '#', '')) || '.ts' AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line,
           CASE p_partkey % 8 WHEN 0 THEN '// ' || p_type || ' part' WHEN 1 THEN 'export function ' || camel || '() {' WHEN 2 THEN '  return ' || camel || '(x);'
                WHEN 3 THEN '  db.query(' || camel || ');' WHEN 4 THEN 'class ' || pascal || ' {' WHEN 6 THEN '  if (ok) { ' || camel || '(); }' ELSE '}' END AS text
    FROM (SELECT *, split_part(p_name, ' ', 1) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS camel,
                 upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) AS pascal FROM part))"""
MANY_LINES = f"""{CODE_LINES}, many_lines AS (
    SELECT substr(file, 1, length(file) - 3) || CASE d WHEN '1' THEN '.py' WHEN '2' THEN '.rb' WHEN '3' THEN '.lua' WHEN '4' THEN '.txt' WHEN '5' THEN '.PY' ELSE '.ts' END AS file, line,
           CASE WHEN line = 1 THEN mark || ' what it is' WHEN line = 2 THEN mark || CASE WHEN substr(file, -5, 1) = '1' THEN ' feature: x' ELSE ' more' END
                WHEN mark = '#' AND starts_with(text, '//') THEN CASE WHEN line % 7 = 0 THEN '#!' ELSE '#' END || substr(text, 3) ELSE text END AS text
    FROM (SELECT *, substr(file, -4, 1) AS d, CASE WHEN substr(file, -4, 1) IN ('1', '2') THEN '#' WHEN substr(file, -4, 1) = '3' THEN '--' ELSE '//' END AS mark FROM code_lines)),
    comment_lines AS (SELECT file, line, substr(trim(text), 1, 80) AS comment FROM many_lines WHERE line > 2 AND regexp_matches(lower(file), '[.](ts|py|rb|lua)$') AND
        CASE WHEN regexp_matches(file, '[.](py|rb)$') THEN starts_with(trim(text), '#') AND NOT starts_with(trim(text), '#!') AND NOT starts_with(trim(text), '#include') ELSE starts_with(trim(text), '//') END)"""
CYCLIC = """edges AS (SELECT s_suppkey AS src, unnest([(s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier), (s_suppkey * 5 + 2) % (SELECT count(*) FROM supplier)]) AS dst FROM supplier)"""
TREE = """tree AS (
    SELECT r_name AS path, NULL::VARCHAR AS parent, r_name AS name, 0 AS depth FROM region
    UNION ALL SELECT r_name || '/' || n_name, r_name, n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, r_name || '/' || n_name, c_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SPLIT = "regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"


def file_terms(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({SPLIT.format(x)}), '[\\s_-]+'), lambda t: length(t) > 1)"


def identifier_terms(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({SPLIT.format(x)}), '[^a-z0-9_]+'), lambda t: length(t) > 1)"


def covered(terms: str, words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"(len(list_intersect([{listed}], {terms})) / {len(words)}::DOUBLE)"


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("lines_explode", "SELECT doc_id::VARCHAR AS file, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM documents")
def _(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("key", F.col("doc_id").cast("string"))
    return code.explode_lines(docs, "key", "text").withColumn("line", F.col("line").cast("long"))


TRIMMED = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query("plain_header", f"SELECT doc_id, array_to_string(list_transform(({TRIMMED})[1:2], lambda x: substr(x, 1, 120)), ' | ') AS header FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.plain_header(F.col("text")).alias("header"))


@query(
    "code_header",
    f"""WITH {CODE_LINES}, files AS (SELECT file, string_agg(text, chr(10) ORDER BY line) AS text FROM code_lines GROUP BY file)
    SELECT file, array_to_string(list_filter(list_transform((string_split(text, chr(10)))[1:10], lambda x: trim(regexp_replace(x, '^//\\s?|^#\\s?|^--\\s?|^\\*\\s?|^/\\*\\*?\\s?|\\*/$', '', 'g'))),
        lambda x: x <> '' AND NOT starts_with(x, '!') AND NOT starts_with(x, 'use ') AND NOT starts_with(x, 'import '))[1:2], ' | ') AS header FROM files""",
)
def _(t: Tables) -> DataFrame:
    files = t.code_lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return files.select("file", T.code_header(F.col("text")).alias("header"))


@query("tokenize_camel", f"WITH {CODE_LINES} SELECT file, line, array_to_string({file_terms('text')}, ',') AS terms FROM code_lines")
def _(t: Tables) -> DataFrame:
    return t.code_lines.select("file", "line", F.array_join(T.file_terms(F.col("text")), ",").alias("terms"))


@query("tokenize_terms", f"WITH {CODE_LINES} SELECT file, line, array_to_string({identifier_terms('text')}, ',') AS terms FROM code_lines")
def _(t: Tables) -> DataFrame:
    return t.code_lines.select("file", "line", F.array_join(T.identifier_terms(F.col("text")), ",").alias("terms"))


@query("term_coverage", f"SELECT doc_id, {covered(file_terms('text'), ['the', 'and', 'of', 'in', 'der'])} AS coverage FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.coverage(T.file_terms(F.lit("the and_of in der")), T.file_terms(F.col("text"))).alias("coverage"))


KEYWORD = f"""least(greatest(0.65::DOUBLE * {covered(file_terms('{text}'), ['the', 'of'])} + 0.2::DOUBLE * {covered(file_terms('{symbols}'), ['the', 'of'])}
    + CASE WHEN contains(lower({{text}}), 'the of') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE)"""


@query("keyword_score", f"SELECT doc_id, round({KEYWORD.format(text='text', symbols='source')}, 6) AS score FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(T.keyword_score("the of", F.col("text"), F.col("source")), 6).alias("score"))


QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)"
COMBINED = "least(greatest(({0} * greatest(sem, 0.0::DOUBLE) + {1} * key) / ({0} + {1}), 0.0::DOUBLE), 1.0::DOUBLE)"


@query(
    "combined_score",
    f"""SELECT doc_id, floor(round({COMBINED.format('0.72::DOUBLE', '0.28::DOUBLE')}, 9) * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS score
    FROM (SELECT doc_id, list_cosine_similarity(embedding::DOUBLE[], {QUERY_VECTOR}) AS sem, {KEYWORD.format(text='text', symbols='source')} AS key FROM documents JOIN embeddings ON doc_id = vec_id)""",
)
def _(t: Tables) -> DataFrame:
    d = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"))
    vector = search.query_vector(t.vector_of(3))
    both = T.combined_score(V.cosine(V.doubles(F.col("embedding")), vector), T.keyword_score("the of", F.col("text"), F.col("source")))
    return d.select("doc_id", T.percent(F.round(both, 9)).alias("score"))


@query("cosine_topk", f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {QUERY_VECTOR}), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 25")
def _(t: Tables) -> DataFrame:
    return search.nearest(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), search.query_vector(t.vector_of(3)), 25)


def _tenths(x: str) -> str:
    return f"floor({x} * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"


@query(
    "hybrid_search",
    f"""WITH scored AS (SELECT doc_id AS id, list_cosine_similarity(embedding::DOUBLE[], {QUERY_VECTOR}) AS sem, {KEYWORD.format(text='text', symbols='source')} AS key
        FROM documents JOIN embeddings ON doc_id = vec_id), held AS (SELECT *, {COMBINED.format('0.72::DOUBLE', '0.28::DOUBLE')} AS total FROM scored)
    SELECT id, {_tenths('total')} AS score, {_tenths('greatest(sem, 0.0::DOUBLE)')} AS semantic_score, {_tenths('key')} AS keyword_score
    FROM held WHERE total >= 0.1 ORDER BY round(total, 12) DESC, round(key, 12) DESC, round(sem, 12) DESC, id LIMIT 20""",
)
def _(t: Tables) -> DataFrame:
    docs = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("symbols"), F.col("embedding").alias("v"))
    return search.hybrid_search(docs, "the of", search.query_vector(t.vector_of(3)))


@query(
    "identifier_search",
    f"""WITH scored AS (SELECT p_partkey AS id, p_name AS name, list_cosine_similarity(embedding::DOUBLE[], {QUERY_VECTOR}) AS sem, {covered(identifier_terms("p_name || ' ' || p_type || ' ' || p_brand"), ['red', 'widget', 'brand'])} AS key
        FROM part JOIN embeddings ON p_partkey = vec_id WHERE lower(p_type) IN (SELECT min(lower(p_type)) FROM part UNION SELECT max(lower(p_type)) FROM part))
    SELECT id, name, {_tenths(COMBINED.format('0.78::DOUBLE', '0.22::DOUBLE'))} AS score FROM scored ORDER BY round({COMBINED.format('0.78::DOUBLE', '0.22::DOUBLE')}, 12) DESC, id LIMIT 20""",
)
def _(t: Tables) -> DataFrame:
    ends = t.part.agg(F.min("p_type"), F.max("p_type")).first()
    rows = t.part.join(t.embeddings, F.col("p_partkey") == F.col("vec_id")).select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), F.col("embedding").alias("v")
    )
    return search.identifier_search(rows, "red widget Brand", search.query_vector(t.vector_of(3)), [f" {ends[0].upper()} ", ends[1]]).select("id", "name", "score")


CALLED = r"""list_filter(list_concat(regexp_extract_all(text, '\b([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(', 1), regexp_extract_all(text, '<([A-Z][a-zA-Z0-9_$]*)', 1)), lambda n: NOT list_contains([SKIP], n))""".replace(
    "SKIP", ", ".join(f"'{w}'" for w in T.SKIPPED_CALLS)
)
DEFINED = r"""defined AS (SELECT file, line, regexp_extract(text, '^(?:export )?(function|class) (\w+)', 1) AS kind, regexp_extract(text, '^(?:export )?(function|class) (\w+)', 2) AS name
    FROM code_lines WHERE regexp_matches(text, '^(?:export )?(function|class) (\w+)'))"""


@query(
    "callsite_two_phase",
    f"""WITH {CODE_LINES}, {DEFINED}, called AS (SELECT DISTINCT file, line, text, unnest({CALLED}) AS name FROM code_lines),
    sites AS (SELECT *, {covered(identifier_terms("file || ' ' || text"), ['db', 'return'])} AS key FROM called
        WHERE name IN (SELECT name FROM defined WHERE kind = 'function') AND NOT regexp_matches(text, '(?:function|class|enum|interface|struct|type|trait|fn|def|func)\\s')),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY key DESC, file, line) AS rank, count(*) OVER (PARTITION BY name) AS total FROM sites)
    SELECT name, rank, file, line, {_tenths('key')} AS keyword_score, total FROM ranked WHERE rank <= 10""",
)
def _(t: Tables) -> DataFrame:
    names = t.code_symbols.filter("kind = 'function'").select("name").distinct()
    return search.call_sites(t.code_lines, names, 10, "db return").withColumn("rank", F.col("rank").cast("long"))


@query(
    "identifier_calls",
    f"""WITH {CODE_LINES}, {DEFINED}, ids AS (SELECT file || ':' || name || ':' || line AS id, name, kind, file AS own_file, line AS own_line FROM defined),
    sites AS (SELECT id, file, line, substr(trim(text), 1, 220) AS context FROM code_lines JOIN ids
        ON regexp_matches(text, '\\b' || name || CASE WHEN kind = 'function' THEN '\\s*\\(' ELSE '\\b' END)
        WHERE NOT (file = own_file AND line = own_line) AND NOT regexp_matches(text, '(?:function|class|enum|interface|struct|type|trait|fn|def|func)\\s+' || name)
        AND NOT regexp_matches(text, '(?:const|let|var|pub|export)\\s+(?:async\\s+)?(?:function\\s+)?' || name)),
    keyed AS (SELECT *, {covered(identifier_terms("file || ' ' || context"), ['db', 'return'])} AS key, count(*) OVER (PARTITION BY id) AS total FROM sites)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY key DESC, file, line) AS rank, file, line, context, {_tenths('0.18::DOUBLE * key')} AS score, 0.0::DOUBLE AS semantic_score, {_tenths('key')} AS keyword_score, total
    FROM keyed QUALIFY rank <= 5""",
)
def _(t: Tables) -> DataFrame:
    defined = t.code_symbols.select(F.concat_ws(":", "file", "name", F.col("line").cast("string")).alias("id"), "name", "kind", "file", "line")
    found = search.identifier_calls(t.code_lines, defined, "db return", search.query_vector([1.0]), 5, lambda texts: [[0.0]] * len(texts))
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    "blast_radius",
    r"""SELECT file, count(*) AS usages, min(line) AS first_line, max(line) AS last_line
    FROM (SELECT doc_id::VARCHAR AS file, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)
    WHERE regexp_matches(text, '\bthing\b') GROUP BY file""",
)
def _(t: Tables) -> DataFrame:
    lines = code.lines_with(t.documents.withColumn("key", F.col("doc_id").cast("string")), "key", "text", ["thing"])
    return code.blast_radius(lines.withColumn("line", F.col("line").cast("long")), "thing")


@query(
    "blast_radius_code",
    f"""WITH {CODE_LINES} SELECT file, count(*) AS usages, min(line) AS first_line, max(line) AS last_line FROM code_lines
    WHERE regexp_matches(text, '\\bredWidget\\b') AND NOT (file = 'src/brand1.ts' AND regexp_matches(text, '(?:function|class)\\s+redWidget')) GROUP BY file""",
)
def _(t: Tables) -> DataFrame:
    return code.blast_radius(t.code_lines, "redWidget", "src/brand1.ts")


@query(
    "blast_radius_summary",
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), words AS (SELECT unnest(['the', 'thing', 'der', 'que', 'Apache']) AS word)
    SELECT word, count(*) AS usages, count(DISTINCT doc_id) AS files, count(*) <= 1 AS low_usage FROM lines, words WHERE regexp_matches(text, '\b' || word || '\b') GROUP BY word""",
)
def _(t: Tables) -> DataFrame:
    words = ["the", "thing", "der", "que", "Apache"]
    return code.blast_summary(code.lines_with(t.documents.withColumn("key", F.col("doc_id").cast("string")), "key", "text", words), words)


WORD_USAGES = """used AS (SELECT file, line, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS word FROM {lines})
    SELECT word, count(*) AS usages, count(DISTINCT file) AS files, count(*) <= 1 AS low_usage FROM used GROUP BY word"""


def _usage_index(t: Tables) -> UsageIndex:
    index = UsageIndex(t.spark, scratch_path(t.spark, "usage-index"), buckets=16)
    index.update(t.code_lines)
    return index


@query("usage_index", f"WITH {CODE_LINES}, {WORD_USAGES.format(lines='code_lines')}")
def _(t: Tables) -> DataFrame:
    words = t.code_lines.select(F.explode(usage_index.words_of(F.col("text"))).alias("name")).distinct()
    return _usage_index(t).summary(words)


@query(
    "usage_index_symbols",
    f"""WITH {CODE_LINES}, names AS (SELECT DISTINCT regexp_extract(text, '(?:function|class) (\\w+)', 1) AS name FROM code_lines WHERE regexp_matches(text, '(?:function|class) \\w+') UNION SELECT 'db.query' UNION SELECT 'if (ok)')
    SELECT name, file, line FROM code_lines JOIN names ON regexp_matches(' ' || text || ' ', '[^A-Za-z0-9_]' || regexp_escape(name) || CASE WHEN ends_with(name, ')') THEN '' ELSE '[^A-Za-z0-9_]' END)
    WHERE name <> 'if (ok)' OR NOT regexp_matches(text, 'if \\(ok\\)\\w')""",
)
def _(t: Tables) -> DataFrame:
    lines = t.code_lines
    defined = t.code_symbols.select("name")
    more = t.spark.createDataFrame([("db.query",), ("if (ok)",)], "name string")
    return _usage_index(t).usages(defined.union(more), lines)


@query(
    "usage_index_update",
    f"""WITH {CODE_LINES}, changed AS (SELECT file, line, CASE WHEN starts_with(file, 'src/brand1') THEN upper(text) ELSE text END AS text FROM code_lines
        WHERE NOT starts_with(file, 'src/brand2') AND NOT (starts_with(file, 'src/brand1') AND line % 3 = 0)), {WORD_USAGES.format(lines='changed')}""",
)
def _(t: Tables) -> DataFrame:
    index, lines = _usage_index(t), t.code_lines
    changed = lines.filter("startswith(file, 'src/brand1') AND line % 3 <> 0").withColumn("text", F.upper("text"))
    index.update(changed, lines.filter("startswith(file, 'src/brand2')").select("file"))
    return index.summary(index.postings().select(F.col("word").alias("name")))


@query(
    "definition_lines",
    f"""WITH {CODE_LINES} SELECT file, line, regexp_matches(text, '(?:function|class|enum|interface|struct|type|trait|fn|def|func)\\s+red') OR regexp_matches(text, '(?:const|let|var|pub|export)\\s+(?:async\\s+)?(?:function\\s+)?red') AS is_definition FROM code_lines""",
)
def _(t: Tables) -> DataFrame:
    return t.code_lines.select("file", "line", T.is_definition(F.col("text"), "red").alias("is_definition"))


LINKS = """links AS (SELECT page_id, url, regexp_replace(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', '[[\\1|\\2]]', 'g') AS text FROM pages),
    raw AS (SELECT page_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)) AS x, unnest(range(len(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)))) AS ordinal FROM links)"""


@query(
    "link_extract",
    f"""WITH {LINKS} SELECT page_id, trim(split_part(x, '|', 1)) AS target, trim(substr(x, instr(x, '|') + 1)) AS description, ordinal
    FROM raw QUALIFY row_number() OVER (PARTITION BY page_id, trim(split_part(x, '|', 1)) ORDER BY ordinal) = 1""",
)
def _(t: Tables) -> DataFrame:
    found = hubs.hub_links(t.links.select(F.col("page_id").alias("hub"), F.col("text").alias("content")))
    return found.select(F.col("hub").alias("page_id"), "target", "description", F.col("ordinal").cast("long"))


@query(
    "cross_links",
    """SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>[^<]*</a>', 1)) AS target FROM pages) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return t.links.select("page_id", F.explode(T.cross_links(F.col("crossed"))).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("orphan_docs", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def _(t: Tables) -> DataFrame:
    links = t.labels.select("doc_id").union(t.embeddings.select("vec_id")).distinct().select(F.concat(F.lit("about-"), "doc_id", F.lit(".md")).alias("hub"), F.concat(F.lit("[["), "doc_id", F.lit("]]")).alias("content"))
    docs = t.documents.select("doc_id", "source", F.col("doc_id").cast("string").alias("relative_path"))
    return docs.join(hubs.orphans(docs, links), "relative_path", "left_semi").select("doc_id", "source")


@query("link_resolve", "SELECT quality, toxic, count(*) FILTER (WHERE e.vec_id IS NOT NULL) AS resolved, count(*) FILTER (WHERE e.vec_id IS NULL) AS missing FROM labels l LEFT JOIN embeddings e ON l.doc_id = e.vec_id GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    targets = t.embeddings.select(F.col("vec_id").alias("doc_id")).distinct()
    found = hubs.resolved(t.labels.withColumnRenamed("doc_id", "target"), targets.withColumnRenamed("doc_id", "relative_path"))
    return found.groupBy("quality", "toxic").agg(F.count_if("found").alias("resolved"), F.count_if(~F.col("found")).alias("missing"))


@query(
    "hub_match",
    """SELECT p_type, p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bl')
    QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY lower(p_name) NOT IN ('blue', 'blue widget'), p_name, p_partkey) = 1""",
)
def _(t: Tables) -> DataFrame:
    name = F.lower("p_name")
    order = Window.partitionBy("p_type").orderBy(~name.isin("blue", "blue widget"), "p_name", "p_partkey")
    return t.part.filter(F.contains(name, F.lit("bl"))).withColumn("n", F.row_number().over(order)).filter("n = 1").select("p_type", "p_partkey", "p_name")


@query(
    "pick_best",
    """WITH cand AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal < 0 THEN 'test/' ELSE '' END || 'n' || s_nationkey || '/' || s_name AS path FROM supplier)
    SELECT n_nationkey, s_suppkey, path FROM nation JOIN cand ON s_nationkey = n_nationkey OR s_nationkey = n_nationkey + 1
    QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY contains(path, 'test') OR contains(path, 'spec') OR contains(path, '.demo.'), NOT starts_with(path, 'n' || n_nationkey), s_suppkey) = 1""",
)
def _(t: Tables) -> DataFrame:
    path = F.concat(F.when(F.col("s_acctbal") < 0, "test/").otherwise(""), F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name")
    near = t.supplier.withColumn("path", path).withColumn("of", F.explode(F.array("s_nationkey", F.col("s_nationkey") - 1)))
    found = near.join(t.nation, F.col("of") == F.col("n_nationkey"))
    return code.best_definition(found, ["n_nationkey"], F.col("path"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "s_suppkey").select("n_nationkey", "s_suppkey", "path")


@query("call_extract", f"WITH {CODE_LINES}, found AS (SELECT file, line, {CALLED} AS names FROM code_lines) SELECT file, line, min(o) AS ordinal, callee FROM (SELECT file, line, unnest(names) AS callee, unnest(range(len(names))) AS o FROM found) GROUP BY file, line, callee")
def _(t: Tables) -> DataFrame:
    return code.calls(t.code_lines)


DB_LINE = f"regexp_matches(text, '\\bdb\\s*[.(]|\\b(?:{'|'.join(T.DB_WORDS)})\\b|\\.(?:{'|'.join(T.DB_METHODS)})\\s*\\(')"


@query("db_calls", f"WITH {CODE_LINES} SELECT file, line, {DB_LINE} AS is_db FROM code_lines")
def _(t: Tables) -> DataFrame:
    return t.code_lines.select("file", "line", T.is_db_line(F.col("text")).alias("is_db"))


CHAINS = f"""{CODE_LINES}, {DEFINED}, keyed AS (SELECT *, file || ':' || line AS key FROM defined),
    body AS (SELECT k.key, k.name, k.file, c.line AS nr, c.text FROM keyed k JOIN code_lines c ON c.file = k.file AND c.line BETWEEN k.line AND k.line + 5),
    db AS (SELECT key, bool_or({DB_LINE}) OR regexp_matches(name, '{T.DB_NAMES}') AS is_db FROM body GROUP BY key, name),
    said AS (SELECT key, name, file, nr, unnest({CALLED}) AS callee, unnest(range(len({CALLED}))) AS o FROM body),
    firsts AS (SELECT key, name, file, callee, row_number() OVER (PARTITION BY key ORDER BY min(nr * 1000 + o)) - 1 AS ordinal FROM said GROUP BY key, name, file, callee),
    best AS (SELECT c.file, c.callee, k.key AS dst FROM (SELECT DISTINCT file, callee FROM firsts WHERE callee <> name) c JOIN keyed k ON c.callee = k.name
        QUALIFY row_number() OVER (PARTITION BY c.file, c.callee ORDER BY contains(k.file, 'test') OR contains(k.file, 'spec') OR contains(k.file, '.demo.'), NOT starts_with(k.file, regexp_replace(c.file, '/[^/]*$', '')), k.file, k.line) = 1),
    hops AS (SELECT f.key AS src, f.ordinal, f.callee, b.dst FROM firsts f LEFT JOIN best b USING (file, callee) WHERE f.callee <> f.name),
    chain AS (SELECT key AS root, []::BIGINT[] AS path, [key] AS keys, name, key, false AS is_external, false AS is_cycle, 0 AS depth FROM keyed WHERE kind = 'function'
        UNION ALL SELECT root, list_append(path, ordinal), list_append(keys, dst), callee, dst, dst IS NULL, coalesce(list_contains(keys, dst), false), depth + 1 FROM chain JOIN hops ON key = src WHERE NOT is_cycle AND depth < 3),
    marked AS (SELECT c.root, array_to_string(c.path, '>') AS path, c.depth, c.name, coalesce(k.file, '') AS file, coalesce(k.line, 0) AS line, c.is_external, c.is_cycle,
        CASE WHEN c.is_external THEN regexp_matches(c.name, '{T.DB_NAMES}') ELSE db.is_db AND NOT c.is_cycle END AS is_db_hit,
        c.is_external OR c.is_cycle OR c.depth = 3 OR c.key NOT IN (SELECT src FROM hops) AS is_leaf FROM chain c LEFT JOIN keyed k ON c.key = k.key LEFT JOIN db ON db.key = c.key)"""


def _chains(t: Tables) -> DataFrame:
    """Chains from each function of code_lines, whose bodies are taken to be six lines."""
    symbols = code.definitions(t.code_lines).select("file", "name", "kind", "line", (F.col("line") + 5).alias("end_line"), F.lit("").alias("signature"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    held = chains.bodies(symbols, t.code_lines.groupBy(F.col("file").alias("relative_path")).agg(content.alias("content")))
    return chains.call_chains(held, held.filter("kind = 'function'"), 3)


@query("call_chains", f"WITH RECURSIVE {CHAINS} SELECT * FROM marked")
def _(t: Tables) -> DataFrame:
    held = _chains(t).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))
    return held.select("root", "path", "depth", "name", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0).cast("long")).alias("line"), "is_external", "is_cycle", "is_db_hit", "is_leaf")


@query(
    "chain_stats",
    f"""WITH RECURSIVE {CHAINS} SELECT root, count(*) AS total, count(*) FILTER (WHERE NOT is_leaf) AS internal, count(*) FILTER (WHERE is_leaf) AS leaves,
    count(*) FILTER (WHERE is_db_hit) AS db_hits, count(*) FILTER (WHERE is_cycle) AS cycles FROM marked GROUP BY root""",
)
def _(t: Tables) -> DataFrame:
    return chains.chain_stats(_chains(t))


@query(
    "chain_flatten",
    f"""WITH RECURSIVE {CHAINS} SELECT root, coalesce(key, 'ext:' || name) AS node, array_to_string(arg_min(path, path), '>') AS first_path, arg_min(depth, path) AS depth, count(*) AS times FROM chain GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return chains.flatten_chain(_chains(t)).withColumn("first_path", F.array_join(F.col("first_path").cast("array<string>"), ">"))


PATHS = f"""{CYCLIC}, paths AS (
    SELECT [0::BIGINT] AS path, 0 AS depth, 0::BIGINT AS node, false AS is_cycle
    UNION ALL SELECT list_append(p.path, e.dst), p.depth + 1, e.dst, list_contains(p.path, e.dst) FROM paths p JOIN edges e ON p.node = e.src AND e.src <> e.dst WHERE NOT p.is_cycle AND p.depth < 6),
    marked AS (SELECT *, is_cycle OR depth = 6 OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = node AND e.src <> e.dst) AS is_leaf FROM paths)"""


@query("call_paths", f"WITH RECURSIVE {PATHS} SELECT array_to_string(path, '>') AS path, depth, node, is_cycle, is_leaf FROM marked")
def _(t: Tables) -> DataFrame:
    return graph.call_paths(t.cyclic, 0).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("call_stats", f"WITH RECURSIVE {PATHS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_leaf) AS internal, count(*) FILTER (WHERE is_leaf) AS leaves, count(*) FILTER (WHERE is_cycle) AS cycles, max(depth) AS max_depth FROM marked")
def _(t: Tables) -> DataFrame:
    return graph.path_stats(graph.call_paths(t.cyclic, 0))


DAG = "edges AS (SELECT r_regionkey + 1 AS src, n_nationkey + 101 AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT n_nationkey + 101, r_regionkey + 201 FROM nation JOIN region ON n_regionkey <= r_regionkey UNION SELECT 0, r_regionkey + 1 FROM region)"


@query(
    "call_flatten_dag",
    f"""WITH RECURSIVE {DAG}, paths AS (SELECT [0::BIGINT] AS path, 0 AS depth, 0::BIGINT AS node UNION ALL SELECT list_append(path, dst::BIGINT), depth + 1, dst::BIGINT FROM paths JOIN edges ON node = src WHERE depth < 6)
    SELECT node, depth FROM paths QUALIFY row_number() OVER (PARTITION BY node ORDER BY path) = 1""",
)
def _(t: Tables) -> DataFrame:
    r, n = t.region, t.nation
    same, below = n.n_regionkey == r.r_regionkey, n.n_regionkey <= r.r_regionkey
    first = r.join(n, same).select((F.col("r_regionkey") + 1).alias("src"), (F.col("n_nationkey") + 101).alias("dst"))
    second = n.join(F.broadcast(r), below).select((F.col("n_nationkey") + 101).alias("src"), (F.col("r_regionkey") + 201).alias("dst"))
    edges = first.union(second).union(r.select(F.lit(0), F.col("r_regionkey") + 1)).select(F.col("src").cast("long"), F.col("dst").cast("long"))
    return graph.flatten_paths(graph.call_paths(edges, 0))[0]


@query("tree_nodes", f"WITH {TREE} SELECT path, coalesce(parent, '.') AS parent, repeat('  ', depth) || name AS line, depth FROM tree")
def _(t: Tables) -> DataFrame:
    return t.tree.select("path", F.coalesce("parent", F.lit(".")).alias("parent"), F.concat(F.repeat(F.lit("  "), F.col("depth")), "name").alias("line"), "depth")


@query(
    "tree_level",
    f"""WITH {TREE}, sizes AS (SELECT sum(length(name) + 2 * depth + 1) AS l2, sum(CASE WHEN depth < 2 THEN length(name) + 2 * depth + 1 END) AS l1, sum(CASE WHEN depth < 1 THEN length(name) + 1 END) AS l0 FROM tree)
    SELECT CASE WHEN ceil(l2 / 4.0) <= 300 THEN 2 WHEN ceil(l1 / 4.0) <= 300 THEN 1 ELSE 0 END AS level, ceil(l2 / 4.0)::BIGINT AS tokens_2, ceil(l1 / 4.0)::BIGINT AS tokens_1, ceil(l0 / 4.0)::BIGINT AS tokens_0 FROM sizes""",
)
def _(t: Tables) -> DataFrame:
    size = F.length("name") + 2 * F.col("depth") + 1
    sizes = t.tree.agg(*[F.sum(F.when(F.col("depth") <= level, size)).alias(f"l{level}") for level in range(3)])
    tokens = [T.token_estimate(F.col(f"l{level}")).alias(f"tokens_{level}") for level in range(3)]
    held = sizes.select(*tokens)
    return held.withColumn("level", F.when(F.col("tokens_2") <= 300, 2).when(F.col("tokens_1") <= 300, 1).otherwise(0))


@query(
    "indent_parent",
    f"""WITH {CODE_LINES}, held AS (SELECT file, line, length(regexp_extract(text, '^( *)', 1)) AS indent FROM code_lines WHERE trim(text) <> '')
    SELECT file, line, indent::INT AS indent, coalesce((SELECT max(p.line) FROM held p WHERE p.file = h.file AND p.line < h.line AND p.indent < h.indent), 0) AS parent_line FROM held h""",
)
def _(t: Tables) -> DataFrame:
    return code.indent_parents(t.code_lines).withColumn("parent_line", F.coalesce("parent_line", F.lit(0).cast("long")))


AFFINITY = "pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, round(greatest(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0.0::DOUBLE), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"), "label")


@query("affinity", f"WITH {AFFINITY} SELECT * FROM pairs")
def _(t: Tables) -> DataFrame:
    return clustering.affinity(_vectors(t))


@query("affinity_degree", f"WITH {AFFINITY} SELECT id, sum(round(sim * 1000000.0)::BIGINT)::BIGINT / 1000000.0::DOUBLE AS degree FROM (SELECT i AS id, sim FROM pairs UNION ALL SELECT j, sim FROM pairs) GROUP BY id")
def _(t: Tables) -> DataFrame:
    return clustering.vector_degrees(_vectors(t))


@query(
    "laplacian",
    f"""WITH {AFFINITY}, degree AS (SELECT id, sum(round(sim * 1000000.0)::BIGINT)::BIGINT / 1000000.0::DOUBLE AS d FROM (SELECT i AS id, sim FROM pairs UNION ALL SELECT j, sim FROM pairs) GROUP BY id)
    SELECT i, j, round(CASE WHEN a.d > 1e-10 AND b.d > 1e-10 THEN -sim / sqrt(a.d * b.d) ELSE 0.0::DOUBLE END, 6) + 0.0::DOUBLE AS value FROM pairs JOIN degree a ON i = a.id JOIN degree b ON j = b.id""",
)
def _(t: Tables) -> DataFrame:
    return clustering.laplacian(_vectors(t))


MEANS = "means AS (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY label, dim)"


@query("centroids", f"WITH {MEANS} SELECT label, dim::INT AS dim, round(m, 6) AS mean FROM means")
def _(t: Tables) -> DataFrame:
    return clustering.centroids(_vectors(t))


@query(
    "nearest_centroid",
    f"""WITH {MEANS}, c AS (SELECT label, list(m ORDER BY dim) AS c FROM means GROUP BY label)
    SELECT vec_id AS id, c.label AS nearest, round(list_distance(embedding::DOUBLE[], c.c) ** 2, 6) AS distance FROM embeddings, c
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(embedding::DOUBLE[], c.c) ** 2, 6), c.label) = 1""",
)
def _(t: Tables) -> DataFrame:
    return clustering.nearest_centroids(_vectors(t))


@query("brace_depth", f"""WITH {CODE_LINES}, d AS (SELECT file, sum(len(text) - len(replace(text, '{{', '')) - len(text) + len(replace(text, '}}', ''))) OVER (PARTITION BY file ORDER BY line) AS depth FROM code_lines)
    SELECT file, max(depth)::BIGINT AS max_depth, count(*) AS n_lines FROM d GROUP BY file""")
def _(t: Tables) -> DataFrame:
    return code.brace_depth(t.code_lines)


@query("comment_rule", f"WITH {MANY_LINES} SELECT * FROM comment_lines")
def _(t: Tables) -> DataFrame:
    return code.comment_violations(t.many_lines)


@query(
    "violations",
    f"""WITH {MANY_LINES}, comments AS (SELECT file, 'no-comments' AS rule, count(*) AS n FROM comment_lines GROUP BY file),
    d AS (SELECT file, sum(len(text) - len(replace(text, '{{', '')) - len(text) + len(replace(text, '}}', ''))) OVER (PARTITION BY file ORDER BY line) AS depth FROM many_lines),
    s AS (SELECT file, max(depth) AS depth, count(*) AS n FROM d GROUP BY file),
    h AS (SELECT file, list(text ORDER BY line) FILTER (WHERE starts_with(text, CASE WHEN file LIKE '%.lua' THEN '--' WHEN regexp_matches(file, '[.](py|rb)$') THEN '#' ELSE '//' END)) AS heads
        FROM many_lines WHERE line <= 5 AND regexp_matches(file, '[.](ts|py|rb|lua)$') GROUP BY file)
    SELECT *, rule = 'no-comments' AND n > 10 AS rejects FROM (SELECT * FROM comments UNION ALL SELECT file, 'nesting', 1 FROM s WHERE depth > 6
        UNION ALL SELECT file, 'file-length', 1 FROM s WHERE n > 1000 UNION ALL SELECT file, 'header', 1 FROM h WHERE coalesce(len(heads), 0) < 2
        UNION ALL SELECT file, 'feature-tag', 1 FROM h WHERE len(heads) >= 2 AND NOT contains(upper(heads[2]), 'FEATURE:'))""",
)
def _(t: Tables) -> DataFrame:
    return code.violations(t.many_lines, most_comments=10)


@query("symbols", f"WITH {CODE_LINES}, {DEFINED} SELECT file, name, kind, line FROM defined")
def _(t: Tables) -> DataFrame:
    return t.code_symbols.select("file", "name", "kind", "line")


@query("retention", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def _(t: Tables) -> DataFrame:
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.select("event_type", "event_id", F.row_number().over(order).alias("n")).filter("n <= 100").drop("n")


@query(
    "change_classify",
    """WITH old AS (SELECT doc_id AS key, md5(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS hash FROM documents WHERE source <> 'src3'), new AS (SELECT doc_id AS key, md5(text) AS hash FROM documents WHERE source <> 'src4')
    SELECT key, CASE WHEN old.hash IS NULL THEN 'insert' WHEN new.hash IS NULL THEN 'delete' WHEN old.hash <> new.hash THEN 'update' ELSE 'skip' END AS change FROM old FULL JOIN new USING (key)""",
)
def _(t: Tables) -> DataFrame:
    old = t.documents.filter("source <> 'src3'").select(F.col("doc_id").alias("key"), F.md5(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    new = t.documents.filter("source <> 'src4'").select(F.col("doc_id").alias("key"), F.md5("text").alias("hash"))
    return search.classify_changes(old, new)


@query("cache_lookup", "SELECT source, count(*) FILTER (WHERE vec_id IS NOT NULL) AS hits, count(*) FILTER (WHERE vec_id IS NULL) AS misses FROM documents LEFT JOIN embeddings ON doc_id = vec_id AND n_chars % 7 <> label % 7 GROUP BY source")
def _(t: Tables) -> DataFrame:
    docs = t.documents.select("source", F.col("doc_id").alias("key"), "n_chars").withColumn("hash", F.explode(F.expr("filter(sequence(0L, 6L), x -> x <> n_chars % 7)")))
    cache = t.embeddings.select(F.col("vec_id").alias("key"), (F.col("label") % 7).cast("long").alias("hash"), F.col("embedding").alias("v"))
    found = search.cached_vectors(docs, cache).groupBy("key", "source").agg(F.max("hit").alias("hit"))
    return found.groupBy("source").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query(
    "progress_state",
    """SELECT s.event_id, s.user_id, CASE WHEN min(d.ts) IS NULL THEN 'running' ELSE 'done' END AS status, min(d.ts) AS done_at
    FROM events s LEFT JOIN events d ON d.user_id = s.user_id AND d.event_type IN ('purchase', 'error') AND (d.ts, d.event_id) > (s.ts, s.event_id) WHERE s.event_type = 'view' GROUP BY s.event_id, s.user_id""",
)
def _(t: Tables) -> DataFrame:
    after = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    done = F.first(F.when(F.col("event_type").isin("purchase", "error"), F.col("ts")), ignorenulls=True).over(after)
    return t.events.withColumn("done_at", done).filter("event_type = 'view'").select("event_id", "user_id", F.when(F.col("done_at").isNull(), "running").otherwise("done").alias("status"), "done_at")


@query(
    "merge_roles",
    """WITH r AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 < 2 THEN 'both' ELSE role END AS role FROM conversations),
    m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role AS starts FROM r),
    g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m)
    SELECT conv_id, island::BIGINT AS island, min(role) AS role, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, island""",
)
def _(t: Tables) -> DataFrame:
    return messages.merge_roles(t.conversations.withColumn("role", F.when(F.col("turn") % 4 < 2, "both").otherwise(F.col("role"))))


@query("message_truncate", "SELECT conv_id, turn, substr(text, 1, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS text FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.concat(F.substring("text", 1, 80), F.when(F.length("text") > 80, "...").otherwise("")).alias("text"))


@query("dangling_edges", "SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def _(t: Tables) -> DataFrame:
    of = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    nodes = t.customer.filter("c_acctbal >= 0").select(of("customer ", "c_custkey").alias("node")).union(t.orders.select(of("order ", "o_orderkey")))
    edges = t.orders.select(of("order ", "o_orderkey").alias("src"), of("customer ", "o_custkey").alias("dst"), "o_orderkey", "o_custkey")
    return graph.dangling(edges, nodes).select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))


@query("isolated_nodes", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def _(t: Tables) -> DataFrame:
    used = t.orders.filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_mktsegment").join(used, "c_custkey", "left_anti")


@query(
    "id_remap",
    """WITH ids AS (SELECT n_nationkey AS k, left(n_name, 2) AS id FROM nation), n AS (SELECT k, CASE WHEN id IN (SELECT left(r_name, 2) FROM region) THEN 'nd_' || id ELSE id END AS id FROM ids)
    SELECT k, id || repeat('_dup', (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INT) AS new_id FROM n""",
)
def _(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.col("n_nationkey").alias("n"), F.substring("n_name", 1, 2).alias("id"))
    found = diagrams.unique_nodes(nodes, t.region.select(F.substring("r_name", 1, 2).alias("id")))
    return found.select(F.col("n").alias("k"), "new_id")


@query("fan_in_out", "SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT l_partkey AS node, 0 AS i, 1 AS o FROM lineitem UNION ALL SELECT l_suppkey, 1, 0 FROM lineitem) GROUP BY node")
def _(t: Tables) -> DataFrame:
    return graph.degrees(t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("callers_callees", f"WITH {CYCLIC} SELECT a.src AS node, a.dst AS callee, b.src AS caller FROM edges a JOIN edges b ON a.src = b.dst")
def _(t: Tables) -> DataFrame:
    return graph.between(t.cyclic)


@query("descendants", f"WITH RECURSIVE {TREE}, d AS (SELECT path AS root, path, 0 AS steps FROM tree WHERE depth = 0 UNION ALL SELECT d.root, tree.path, steps + 1 FROM d JOIN tree ON tree.parent = d.path) SELECT root, count(*) AS nodes, max(steps) AS steps FROM d GROUP BY root")
def _(t: Tables) -> DataFrame:
    found = graph.descendants(t.tree.select(F.col("path").alias("node"), "parent"))
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.max("steps").alias("steps"))


@query("entry_points", "WITH edges AS (SELECT 2 * s_suppkey + 1 AS dst FROM supplier UNION SELECT 2 * s_suppkey + 2 FROM supplier WHERE s_suppkey % 5 <> 0) SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT dst FROM edges)")
def _(t: Tables) -> DataFrame:
    s = F.col("s_suppkey")
    edges = t.supplier.select(F.explode(F.array_compact(F.array(2 * s + 1, F.when(s % 5 != 0, 2 * s + 2)))).alias("dst"))
    return graph.entry_points(t.supplier.select(s.alias("node")), edges)


QUESTIONS = "event_type || ' in ' || props || CASE event_id % 6 WHEN 0 THEN ' trace' WHEN 1 THEN ' impact' WHEN 2 THEN ' overview' WHEN 3 THEN ' explain' WHEN 4 THEN ' data lineage' ELSE '' END"


@query("classify_question", f"SELECT event_id, CASE {' '.join(f"WHEN regexp_matches(lower({QUESTIONS}), '{p}') THEN '{r}'" for p, r in T.ROUTES)} ELSE 'direct_graph' END AS route FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.route_question(F.expr(QUESTIONS)).alias("route"))


@query(
    "subgraph",
    f"""WITH RECURSIVE {CYCLIC}, r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON r.node = e.src WHERE r.depth < 5) SELECT node, min(depth) AS depth FROM r GROUP BY node""",
)
def _(t: Tables) -> DataFrame:
    return graph.reach(t.cyclic, 0, 5)


@query("edge_bundle", "SELECT l_partkey % 100 AS src, l_suppkey AS dst, count(*) AS edges, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return diagrams.bundled(t.lineitem.select((F.col("l_partkey") % 100).alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight")))


NOW = "TIMESTAMP '1998-08-10 12:00:00'"


@query(
    "time_ago",
    f"""WITH m AS (SELECT o_orderkey, floor(epoch({NOW} - o_orderdate) / 60)::BIGINT AS m FROM orders)
    SELECT o_orderkey, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' WHEN m < 10080 THEN m // 1440 || 'd ago' ELSE m // 10080 || 'w ago' END AS ago FROM m""",
)
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", T.time_ago(F.col("o_orderdate").cast("timestamp"), F.expr(NOW)).alias("ago"))


@query("repo_name", "SELECT page_id, string_split(regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', ''), '/')[-1] AS name FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.repo_name(F.col("url")).alias("name"))


@query("tool_label", "SELECT o_orderkey, array_to_string(list_transform(string_split(replace(lower(o_orderpriority), '-', ' '), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS label FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", T.tool_label(F.lower("o_orderpriority")).alias("label"))


@query("line_range", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > l_linenumber THEN 'L' || l_linenumber || '-L' || l_quantity::INT ELSE 'L' || l_linenumber END AS range FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", T.line_range(F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("range"))


@query("bounding_box", "SELECT p_brand, min(p_size) AS x, max(p_size + p_partkey % 7) AS right, min(p_retailprice) AS y, max(p_retailprice + 10) AS bottom FROM part GROUP BY p_brand")
def _(t: Tables) -> DataFrame:
    boxes = t.part.select(F.col("p_brand").alias("group"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 7).alias("width"), F.lit(10).alias("height"))
    return diagrams.bounding_boxes(boxes).withColumnRenamed("group", "p_brand")


@query("event_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("name_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_partkey LIMIT 50")
def _(t: Tables) -> DataFrame:
    return t.part.filter(F.contains(F.lower("p_name"), F.lit("widget"))).select("p_partkey", "p_name").orderBy("p_partkey").limit(50)


@query("symbol_count", f"WITH {CODE_LINES} SELECT file, count(*) FILTER (WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#') AND NOT starts_with(trim(text), '-')) AS symbols FROM code_lines GROUP BY file")
def _(t: Tables) -> DataFrame:
    bare = T.trimmed(F.col("text"))
    return t.code_lines.groupBy("file").agg(F.count_if((bare != "") & ~bare.startswith("#") & ~bare.startswith("-")).alias("symbols"))


@query("feature_tag", f"WITH {CODE_LINES} SELECT file, line, nullif(trim(regexp_extract(CASE WHEN starts_with(text, '//') THEN text || chr(10) || '// FEATURE: ' || substr(text, 4) ELSE text END, '(?m)^(?://|#|--)\\s*FEATURE:\\s*([^\\n]+)', 1)), '') AS tag FROM code_lines")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("text").startswith("//"), F.concat("text", F.lit("\n// FEATURE: "), F.substring("text", 4, 1000))).otherwise(F.col("text"))
    return t.code_lines.select("file", "line", T.feature_tag(text).alias("tag"))


@query(
    "resolve_calls",
    f"""WITH {CODE_LINES}, {DEFINED}, called AS (SELECT DISTINCT file, line, unnest({CALLED}) AS callee FROM code_lines),
    best AS (SELECT c.file, c.callee, d.file AS def_file, d.line AS def_line FROM (SELECT DISTINCT file, callee FROM called) c JOIN defined d ON c.callee = d.name
        QUALIFY row_number() OVER (PARTITION BY c.file, c.callee ORDER BY contains(d.file, 'test') OR contains(d.file, 'spec') OR contains(d.file, '.demo.'), NOT starts_with(d.file, regexp_replace(c.file, '/[^/]*$', '')), d.file, d.line) = 1)
    SELECT file, line, callee, def_file, def_line, def_file IS NULL AS external FROM called LEFT JOIN best USING (file, callee)""",
)
def _(t: Tables) -> DataFrame:
    return code.resolve_calls(code.calls(t.code_lines), t.code_symbols).drop("ordinal")


@query("node_meta", f"WITH RECURSIVE {CYCLIC}, r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON r.node = e.src WHERE r.depth < 3), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT 'fn:' || s_name || ':' || s_suppkey AS id, coalesce(depth, -1) AS depth, CASE WHEN depth = 0 THEN 'target' WHEN depth = 1 THEN 'dependency' ELSE 'callee' END AS role FROM supplier LEFT JOIN m ON s_suppkey = node")
def _(t: Tables) -> DataFrame:
    meta = graph.reach(t.cyclic, 0, 3)
    role = F.when(F.col("depth") == 0, "target").when(F.col("depth") == 1, "dependency").otherwise("callee")
    return t.supplier.join(meta, F.col("s_suppkey") == F.col("node"), "left").select(F.concat(F.lit("fn:"), "s_name", F.lit(":"), F.col("s_suppkey").cast("string")).alias("id"), F.coalesce("depth", F.lit(-1)).alias("depth"), role.alias("role"))


@query(
    "skeleton",
    f"""WITH {CODE_LINES}, {DEFINED}
    SELECT file, string_agg('[' || kind || '] L' || line || ' ' || name || ';', chr(10) ORDER BY line) AS skeleton FROM defined GROUP BY file""",
)
def _(t: Tables) -> DataFrame:
    kept = code.definitions(t.code_lines)
    line = F.concat(F.lit("["), "kind", F.lit("] "), T.line_range(F.col("line"), F.col("line")), F.lit(" "), "name", F.lit(";"))
    return kept.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("x")))), lambda s: s["x"]), "\n").alias("skeleton"))


@query(
    "node_score",
    f"""WITH {CYCLIC}, d AS (SELECT node, sum(i) AS fi, sum(o) AS fo FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node), top AS (SELECT max(fi) AS fi, max(fo) AS fo FROM d)
    SELECT node, round(0.3::DOUBLE * (d.fi / top.fi::DOUBLE) + 0.15::DOUBLE * (d.fo / top.fo::DOUBLE) + CASE WHEN d.fi = 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM d, top""",
)
def _(t: Tables) -> DataFrame:
    return graph.score_nodes(graph.scaled_degrees(t.cyclic), "service_overview").select("node", F.round("score", 6).alias("score"))


@query("vector_dims", "SELECT vec_id, len(embedding)::INT AS dims, len(embedding) = 64 AS valid FROM (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT -1, embedding[1:10] FROM embeddings WHERE vec_id = 3)")
def _(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", "embedding")
    broken = e.filter("vec_id = 3").select(F.lit(-1).cast("long").alias("vec_id"), F.slice("embedding", 1, 10).alias("embedding"))
    return e.unionByName(broken).select("vec_id", F.size("embedding").alias("dims"), (F.size("embedding") == 64).alias("valid"))


@query("cluster_members", "SELECT label, count(*) AS n, min(vec_id) AS first_member, array_to_string(list(vec_id ORDER BY vec_id), ',') AS members FROM embeddings GROUP BY label")
def _(t: Tables) -> DataFrame:
    return clustering.members(t.embeddings.select("label", F.col("vec_id").alias("id")))


@query("layout_fallback", f"WITH {TREE} SELECT path, depth * 280 AS x, ((row_number() OVER (PARTITION BY depth ORDER BY path) - 1) * 90)::BIGINT AS y FROM tree")
def _(t: Tables) -> DataFrame:
    return diagrams.layered(t.tree.select(F.col("path").alias("node"), "depth")).withColumnRenamed("node", "path")


@query(
    "path_pattern",
    """WITH p AS (SELECT split_part(url, '/', 3) AS host, string_split(url, '/') AS parts FROM pages),
    g AS (SELECT host, count(*) AS n, min(parts) AS a, max(parts) AS b, min(len(parts)) AS m, min(parts[-1]) AS s0, max(parts[-1]) AS s1 FROM p GROUP BY host),
    c AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, m), lambda i: a[i] = b[i]), false), 0), m) - 1 AS k FROM g)
    SELECT host, CASE WHEN n <= 1 THEN NULL WHEN k > 0 THEN array_to_string(a[1:k], '/') || '/' || CASE WHEN s0 = s1 THEN s0 ELSE '*' END WHEN s0 = s1 THEN '*/' || s0 END AS pattern FROM c""",
)
def _(t: Tables) -> DataFrame:
    found = clustering.path_patterns(t.pages.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("label"), F.col("url").alias("path")))
    return found.withColumnRenamed("label", "host")


@query("icon_label", f"SELECT c_custkey, CASE {' '.join(f"WHEN regexp_matches(lower(c_mktsegment), '{p}') THEN '{i}'" for p, i in T.ICONS)} ELSE '{T.DEFAULT_ICON}' END AS icon FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.icon(F.col("c_mktsegment")).alias("icon"))


@query(
    "navigator_header",
    f"""WITH {CODE_LINES}, first AS (SELECT file, min(line) AS code FROM code_lines WHERE NOT starts_with(trim(text), '//') AND trim(text) <> '' GROUP BY file)
    SELECT file, coalesce(substr(string_agg(regexp_replace(text, '^//\\s*', ''), ' ' ORDER BY line) FILTER (WHERE line <= 5 AND line < code AND starts_with(text, '//')), 1, 200), '') AS header
    FROM code_lines JOIN first USING (file) GROUP BY file""",
)
def _(t: Tables) -> DataFrame:
    files = t.code_lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return files.select("file", T.navigator_header(F.col("text")).alias("header"))


@query(
    "content_hash",
    """WITH h AS (SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM part)
    SELECT p_partkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM h""",
)
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.content_hash(F.col("p_name")).alias("hash"))


@query(
    "message_rows",
    """WITH m AS (SELECT conv_id, turn, role AS sender, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS receiver, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS slot FROM conversations),
    a AS (SELECT role, row_number() OVER (ORDER BY role) - 1 AS at FROM (SELECT DISTINCT role FROM conversations WHERE role <> 'system'))
    SELECT conv_id, turn, s.at AS from_column, r.at AS to_column, slot * 60 AS y FROM m JOIN a s ON sender = s.role JOIN a r ON receiver = r.role""",
)
def _(t: Tables) -> DataFrame:
    return messages.exchanges(t.conversations)


@query(
    "apply_changes",
    """SELECT doc_id AS key, md5(text) AS hash FROM documents WHERE source NOT IN ('src3', 'src4') AND lang <> 'fr'
    UNION ALL SELECT doc_id, md5(text || '!') FROM documents WHERE source <> 'src4' AND (lang = 'fr' OR source = 'src3')""",
)
def _(t: Tables) -> DataFrame:
    d = t.documents
    cache = d.filter("source <> 'src3'").select(F.col("doc_id").alias("key"), F.md5("text").alias("hash"))
    fresh = d.filter("source <> 'src4' and (lang = 'fr' or source = 'src3')").select(F.col("doc_id").alias("key"), F.md5(F.concat("text", F.lit("!"))).alias("hash"))
    return search.apply_changes(cache, fresh, d.filter("source = 'src4'").select(F.col("doc_id").alias("key")))


@query("latest_status", "SELECT user_id AS node, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    return diagrams.latest_status(t.events.select(F.col("user_id").alias("node"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq")))


EDGE_KINDS = "typed AS (SELECT src, dst, CASE WHEN (src + dst) % 3 = 0 THEN 'imports' WHEN (src + dst) % 3 = 1 THEN 'calls' ELSE 'contains' END AS kind FROM edges)"


@query(
    "impact_subgraph",
    f"""WITH RECURSIVE {CYCLIC}, {EDGE_KINDS}, followed AS (SELECT * FROM typed WHERE kind IN ('calls', 'imports')),
    r AS (SELECT node, 0 AS depth FROM (SELECT unnest([0, 1, 7])::BIGINT AS node) UNION SELECT e.dst, r.depth + 1 FROM r JOIN followed e ON r.node = e.src WHERE r.depth < 5),
    n AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
    SELECT src, dst, kind, a.depth AS src_depth, b.depth AS dst_depth FROM followed JOIN n a ON src = a.node JOIN n b ON dst = b.node""",
)
def _(t: Tables) -> DataFrame:
    kind = F.when((F.col("src") + F.col("dst")) % 3 == 0, "imports").when((F.col("src") + F.col("dst")) % 3 == 1, "calls").otherwise("contains")
    roots = t.spark.range(8).filter("id in (0, 1, 7)").select(F.col("id").alias("node"))
    nodes, inner = graph.expand(t.cyclic.withColumn("kind", kind), roots, "dependency_impact")
    return inner.join(nodes.withColumnsRenamed({"node": "src", "depth": "src_depth"}), "src").join(nodes.withColumnsRenamed({"node": "dst", "depth": "dst_depth"}), "dst").select("src", "dst", "kind", "src_depth", "dst_depth")


@query(
    "rewired_edges",
    """WITH n AS (SELECT p_partkey AS n, p_type AS id FROM part), dup AS (SELECT n, id, id || repeat('_dup', (row_number() OVER (PARTITION BY id ORDER BY n) - 1)::INT) AS new_id FROM n),
    last AS (SELECT id, arg_max(new_id, n) AS new_id FROM dup GROUP BY id), e AS (SELECT p_partkey AS e, p_type AS src, p_brand AS dst FROM part)
    SELECT e, coalesce(a.new_id, src) AS src, coalesce(b.new_id, dst) AS dst FROM e LEFT JOIN last a ON src = a.id LEFT JOIN last b ON dst = b.id""",
)
def _(t: Tables) -> DataFrame:
    none = t.region.filter("false").select(F.col("r_name").alias("id"))
    renamed = diagrams.numbered_nodes(t.part.select(F.col("p_partkey").alias("n"), F.col("p_type").alias("id")), none)
    return diagrams.rewired(t.part.select(F.col("p_partkey").alias("e"), F.col("p_type").alias("src"), F.col("p_brand").alias("dst")), renamed)


@query(
    "provider_turns",
    """WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 4 IN (2, 3) THEN 'tool' ELSE role END AS role, coalesce(text, '') AS text FROM conversations),
    s AS (SELECT *, CASE WHEN role = 'tool' AND lag(role) OVER w IS NOT DISTINCT FROM 'tool' THEN 0 ELSE 1 END AS starts FROM r WHERE role IN ('system', 'user', 'assistant', 'tool') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM s)
    SELECT conv_id, min(turn) AS first_turn, CASE WHEN min(role) = 'tool' THEN 'user' ELSE min(role) END AS role, count(*)::INT AS n, md5(string_agg(text, chr(10) ORDER BY turn)) AS body FROM i
    GROUP BY conv_id, island HAVING NOT (min(role) = 'assistant' AND max(text) = '')""",
)
def _(t: Tables) -> DataFrame:
    none = F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    role = F.when((F.col("turn") % 4).isin(2, 3), "tool").otherwise(F.col("role"))
    found = messages.provider_turns(t.conversations.select("conv_id", "turn", role.alias("role"), F.col("text").alias("content"), none.alias("tool_calls"), F.col("turn").cast("string").alias("tool_call_id")))
    return found.select("conv_id", "first_turn", "role", F.size("blocks").alias("n"), F.md5(F.array_join("blocks.body", "\n")).alias("body"))


@query("spectral_clusters")
def _(t: Tables) -> DataFrame:
    return clustering.spectral_clusters(_vectors(t), ["label"])


def _tree_entries(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree without one region's own row, headers of customers, and symbols of those in debt."""
    entries = t.tree.filter("path <> 'ASIA'").select("path", "depth", (F.col("depth") < 2).alias("is_directory"))
    customers = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    named = customers.withColumn("path", F.concat_ws("/", "r_name", "n_name", "c_name"))
    member = F.struct(F.lit(1).alias("ordinal"), F.lit("method").alias("kind"), F.lit("owes").alias("name"), F.lit("owes(self)").alias("signature"), F.lit(4).alias("line"), F.lit(4).alias("end_line"), F.lit("Debt").alias("parent_name"))
    owner = F.struct(F.lit(0).alias("ordinal"), F.lit("class").alias("kind"), F.lit("Debt").alias("name"), F.lit("class Debt").alias("signature"), F.lit(2).alias("line"), F.lit(9).alias("end_line"), F.lit(None).cast("string").alias("parent_name"))
    symbols = named.filter("c_acctbal < 0").select(F.col("path").alias("file"), F.inline(F.array(owner, member)))
    return entries, named.select("path", F.col("c_mktsegment").alias("header")), tree.symbol_lines(symbols)


@query(
    "context_tree",
    f"""WITH {TREE}, headers AS (SELECT r_name || '/' || n_name || '/' || c_name AS path, c_mktsegment AS header, c_acctbal < 0 AS debt FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    entries AS (SELECT path, depth, depth < 2 AS dir, CASE WHEN starts_with(path, 'ASIA/') THEN depth ELSE depth + 1 END AS indent,
        CASE WHEN parent = 'ASIA' THEN NULL ELSE parent END AS parent FROM tree WHERE path <> 'ASIA'),
    lines AS (SELECT e.*, repeat('  ', indent) AS pad, repeat('  ', indent) || string_split(path, '/')[-1] || CASE WHEN dir THEN '/' ELSE '' END AS t0, header, debt FROM entries e LEFT JOIN headers USING (path)),
    texts AS (SELECT path, parent, indent, t0, t0 || coalesce(' | ' || header, '') AS t1,
        t0 || coalesce(' | ' || header, '') || CASE WHEN debt THEN chr(10) || pad || '  class: Debt (L2-L9)' || chr(10) || pad || '    method: owes(self) (L4)' ELSE '' END AS t2 FROM lines
        UNION ALL SELECT '.', NULL, 0, './', './', './'),
    budgets AS (SELECT tokens, CASE WHEN ceil((SELECT sum(length(t2) + 1) FROM texts) / 4.0) <= tokens THEN 2 WHEN ceil((SELECT sum(length(t1) + 1) FROM texts) / 4.0) <= tokens THEN 1 ELSE 0 END AS level
        FROM (SELECT (SELECT ceil(sum(length(t1) + 1) / 4.0) FROM texts) - 1 + d AS tokens FROM (VALUES (0), (1), (1000000)) v(d)))
    SELECT level, path, parent, indent, CASE level WHEN 2 THEN t2 WHEN 1 THEN t1 ELSE t0 END AS text,
        row_number() OVER (PARTITION BY level ORDER BY path <> '.', starts_with(path, 'ASIA/'), path) AS place FROM texts, budgets""",
)
def _(t: Tables) -> DataFrame:
    """Budgets one short of what headers take, just enough for them, and more than all takes."""
    entries, headers, lines = _tree_entries(t)
    sized = tree.context_tree(entries, headers, lines.limit(0), 10**9)
    enough = -(-sized.agg(F.sum(tree.units(F.col("text")) + 1)).first()[0] // 4)
    trees = [tree.context_tree(entries, headers, lines, budget) for budget in (enough - 1, enough, enough + 999_999)]
    every = trees[0].unionByName(trees[1]).unionByName(trees[2])
    return tree.places(every, "level", "chain", "path").select("level", "path", "parent", "indent", "text", "place")


def _k_means_sql(k: int, rounds: int) -> str:
    """Farthest-first starts and then rounds, each a table of its own."""
    parts = ["d AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)", "t1 AS (SELECT 0 AS label, v FROM d ORDER BY id LIMIT 1)"]
    for n in range(2, k + 1):
        parts.append(
            f"t{n} AS (SELECT * FROM t{n - 1} UNION ALL SELECT {n - 1}, v FROM (SELECT id, any_value(d.v) AS v, min(list_distance(d.v, t.v)) AS gap FROM d, t{n - 1} t GROUP BY id ORDER BY gap DESC, id LIMIT 1))"
        )
    centres = f"t{k}"
    for r in range(1, rounds + 1):
        parts.append(f"a{r} AS (SELECT d.id, any_value(d.v) AS v, arg_min(label, list_distance(d.v, c.v) + label * 1e-13) AS label FROM d, {centres} c GROUP BY d.id)")
        means = f"(SELECT label, list(m ORDER BY dim) AS v FROM (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS dim FROM a{r}) GROUP BY label, dim) GROUP BY label)"
        parts.append(f"m{r} AS (SELECT c.label, coalesce(n.v, c.v) AS v FROM {centres} c LEFT JOIN {means} n ON n.label = c.label)")
        centres = f"m{r}"
    return f"WITH {', '.join(parts)} SELECT id, label::INTEGER AS label FROM a{rounds}"


@query("k_means", _k_means_sql(4, 3))
def _(t: Tables) -> DataFrame:
    return spectral.k_means(_vectors(t).select("id", "v"), 4, 3)


@query("spectral_partition")
def _(t: Tables) -> DataFrame:
    """All vectors by the graph of their 16 nearest."""
    return spectral.spectral_partition(_vectors(t).select("id", "v"), neighbours=16)


@query("neighbour_graph", f"""WITH {AFFINITY.replace(", 6)", ", 12)")}, two_way AS (SELECT i, j, sim FROM pairs UNION ALL SELECT j, i, sim FROM pairs),
    best AS (SELECT * FROM two_way WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 16)
    SELECT least(i, j) AS i, greatest(i, j) AS j, round(max(sim), 6) AS sim FROM best GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    found = spectral.neighbour_graph(_vectors(t).select("id", "v"), 16)
    return found.select("i", "j", F.round("sim", 6).alias("sim"))


def _streamed(t: Tables, operator: Callable[[DataFrame], DataFrame], by: list[str]) -> DataFrame:
    """What an operator on streams makes of the events, read as one: the last row of each key."""
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder) if t.one_file("events") else t.spark.readStream.schema(schema).parquet(f"{t.folder}/events.parquet")
    out = scratch_path(t.spark, "streamed")
    state.keep_latest(operator(stream), out, scratch_path(t.spark, "stream-checkpoint"), {"availableNow": True}).awaitTermination()
    return state.read_latest(t.spark, out, by)


@query("log_status_stream", "SELECT 'svc.' || user_id AS node, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.lit("svc").alias("service"), F.col("user_id").cast("string").alias("function"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))
    return _streamed(t, lambda events: state.log_status(events.select(line.alias("value"))), ["node"])


@query(
    "progress_stream",
    """WITH e AS (SELECT event_id AS seq, user_id % 50 AS tool, CASE event_type WHEN 'view' THEN 'tool_start' WHEN 'purchase' THEN 'tool_done' WHEN 'error' THEN 'tool_error' ELSE event_type END AS event FROM events)
    SELECT s.tool, s.seq, coalesce(substr(arg_min(d.event, d.seq), 6), 'running') AS status, min(d.seq) AS "end"
    FROM e s LEFT JOIN e d ON d.tool = s.tool AND d.seq > s.seq AND d.event IN ('tool_done', 'tool_error') WHERE s.event = 'tool_start' GROUP BY s.tool, s.seq""",
)
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "tool_start").when(F.col("event_type") == "purchase", "tool_done").when(F.col("event_type") == "error", "tool_error").otherwise(F.col("event_type"))
    shaped = lambda events: events.select(F.col("event_id").alias("seq"), kind.alias("event"), (F.col("user_id") % 50).alias("tool"))
    return _streamed(t, lambda events: state.progress_stream(shaped(events)), ["tool", "seq"])


def _store(t: Tables) -> GraphStore:
    """Regions as services, nations as packages, customers as files and suppliers as functions of a nation's
    first file; what contains what, calls among suppliers, imports of nations."""
    r, n, c, s = t.region, t.nation, t.customer, t.supplier
    count = s.count()
    none = F.lit(None).cast("string")
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    node = lambda i, name, parent, file, meta, kind: [i.alias("id"), F.col(name).alias("name"), parent.alias("parent_id"), file.alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), meta.alias("metadata"), F.lit(kind).alias("type")]
    file = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_mktsegment")
    tests = F.to_json(F.struct((F.col("c_custkey") % 5 == 0).alias("is_test")))
    nodes = r.select(*node(key("r", "r_regionkey"), "r_name", none, none, F.lit("{}"), "service"))
    nodes = nodes.union(n.select(*node(key("n", "n_nationkey"), "n_name", key("r", "n_regionkey"), none, F.lit("{}"), "package")))
    nodes = nodes.union(c.select(*node(key("c", "c_custkey"), "c_name", key("n", "c_nationkey"), file, tests, "file")))
    nodes = nodes.union(s.select(*node(key("s", "s_suppkey"), "s_name", key("n", "s_nationkey"), none, F.lit("{}"), "function")))
    edge = lambda kind, source, target, weight, meta: [F.concat_ws(":", F.lit(kind), source, target).alias("id"), source.alias("source_id"), target.alias("target_id"), weight.alias("importance"), meta.alias("metadata"), F.lit(kind).alias("type")]
    contains = nodes.filter("parent_id is not null").select(*edge("contains", F.col("parent_id"), F.col("id"), F.lit(None).cast("double"), F.lit("{}")))
    called = F.concat(F.lit("s"), ((F.col("s_suppkey") * 3 + 1) % count).cast("string"))
    calls = s.select(*edge("calls", key("s", "s_suppkey"), called, F.col("s_suppkey") % 10 / F.lit(10.0), F.lit("{}")))
    imported = F.concat(F.lit("n"), (F.col("c_custkey") % 25).cast("string"))
    imports = c.select(*edge("imports", key("c", "c_custkey"), imported, F.col("c_custkey") % 4 / F.lit(4.0), F.to_json(F.struct((F.col("c_custkey") % 3 == 0).alias("is_stdlib")))))
    store = GraphStore(t.spark, scratch_path(t.spark, "graph-store"))
    store.write(nodes, contains.union(calls).union(imports))
    return store


STORE = """nodes AS (SELECT 'r' || r_regionkey AS id, 'service' AS type, r_name AS name, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS file_path, false AS is_test FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'package', n_name, 'r' || n_regionkey, NULL, false FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'file', c_name, 'n' || c_nationkey, 'n' || c_nationkey || '/' || c_mktsegment, c_custkey % 5 = 0 FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'function', s_name, 'n' || s_nationkey, NULL, false FROM supplier),
    edges AS (SELECT parent_id AS source_id, id AS target_id, 'contains' AS type, 1.0::DOUBLE AS importance, false AS is_stdlib FROM nodes WHERE parent_id IS NOT NULL
        UNION ALL SELECT 's' || s_suppkey, 's' || ((s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier)), 'calls', (s_suppkey % 10) / 10.0::DOUBLE, false FROM supplier
        UNION ALL SELECT 'c' || c_custkey, 'n' || (c_custkey % 25), 'imports', (c_custkey % 4) / 4.0::DOUBLE, c_custkey % 3 = 0 FROM customer)"""


@query("store_children", f"WITH {STORE} SELECT id, type, name FROM nodes WHERE parent_id = 'n3'")
def _(t: Tables) -> DataFrame:
    return _store(t).children("n3").select("id", "type", "name")


@query("store_by_type", f"WITH {STORE} SELECT id, type, parent_id FROM nodes WHERE type IN ('package', 'file')")
def _(t: Tables) -> DataFrame:
    return _store(t).nodes("package", "file").select("id", "type", "parent_id")


@query("store_by_file", f"WITH {STORE} SELECT id, file_path, is_test FROM nodes WHERE file_path = 'n3/MACHINERY' OR id = 'n3'")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    found = store.by_file("n3/MACHINERY").unionByName(store.node("n3"))
    return found.select("id", "file_path", store._flag("is_test").alias("is_test"))


@query("store_edges", f"WITH {STORE} SELECT source_id, target_id, type, importance FROM edges WHERE (source_id = 's4' AND type = 'calls') OR target_id = 'n7'")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    return store.out_edges("s4", "calls").unionByName(store.in_edges("n7")).select("source_id", "target_id", "type", "importance")


@query(
    "store_degrees",
    f"""WITH {STORE}, ends AS (SELECT source_id AS id, 0 AS i, 1 AS o FROM edges WHERE type IN ('calls', 'imports') UNION ALL SELECT target_id, 1, 0 FROM edges WHERE type IN ('calls', 'imports'))
    SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM ends GROUP BY id""",
)
def _(t: Tables) -> DataFrame:
    return _store(t).degrees("calls", "imports")


@query(
    "store_view",
    f"""WITH {STORE}, shown AS (SELECT * FROM nodes WHERE NOT is_test AND type IN ('service', 'package', 'file')),
    held AS (SELECT * FROM edges WHERE importance >= 0.25 AND NOT (type = 'imports' AND is_stdlib) AND source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown)),
    ways AS (SELECT source_id AS a, target_id AS b FROM held UNION SELECT target_id, source_id FROM held),
    one AS (SELECT 'n3' AS id UNION SELECT b FROM ways WHERE a = 'n3'), near AS (SELECT id FROM one UNION SELECT b FROM ways WHERE a IN (SELECT id FROM one))
    SELECT source_id, target_id, count(*) AS weight, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM held WHERE source_id IN (SELECT id FROM near) AND target_id IN (SELECT id FROM near) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return _store(t).view(0.8, least_importance=0.25, stdlib=False, tests=False, focus="n3")[1]
