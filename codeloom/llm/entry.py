"""Queries of this subpackage over the tables in a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path() -> str:
    """The public vocabulary file; it has to be on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _repeats(found: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), spans.alias("spans"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.suffix_array import suffix_array_dedup

    return _repeats(suffix_array_dedup(documents(spark, sf_dir)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.substring_dedup import substring_dedup

    return _repeats(substring_dedup(documents(spark, sf_dir)))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.source_mixing import mix_sources

    mixed = mix_sources(documents(spark, sf_dir), SOURCE_WEIGHTS)
    return mixed.select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "shuffle_key", F.length("text").cast("long").alias("text_length"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_path()).drop("rk")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir)).drop("rk")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.exact_dedup import find_copies

    return find_copies(documents(spark, sf_dir))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.simhash_golay import near_components

    found = near_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.pii_crf import KINDS, find_pii

    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    more = [F.size("spans").cast("long").alias("n_spans"), F.size("secrets").cast("long").alias("n_secret"), (F.size("spans") + F.size("secrets")).cast("long").alias("n_private"), text("secrets").alias("secret_spans")]
    return find_pii(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), *more)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.quality import classify

    return classify(documents(spark, sf_dir)).drop("rk")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.language_id import predict, train

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = predict(docs, train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.source_divergence import source_divergence

    return source_divergence(documents(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.toxicity import find_toxic, fit

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = find_toxic(docs, fit(docs.filter(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    spans = F.array_join(F.transform("passages", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), spans.alias("passages"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.lexical_search import lexical_search

    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Target weights of the mixing query and stage: a source that is not named weighs 1.
SOURCE_WEIGHTS = {f"src{i}": 1.0 + i % 4 for i in range(20)}

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_pii": op6_pii,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_toxicity": op12_toxicity,
    "op13_lexical_search": op13_lexical_search,
}

_REPEATS_SQL = """
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
        wins AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + {window}], ' ') AS key FROM (SELECT doc_id, w, unnest(range(len(w) - {window} + 1)) AS s FROM d WHERE len(w) >= {window})),
        later AS (SELECT doc_id, s FROM wins QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, s) > 1),
        cut AS (SELECT DISTINCT doc_id, s + o.o AS p FROM later, (SELECT unnest(range({window})) AS o) o),
        islands AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM cut) GROUP BY doc_id, g),
        spans AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM islands GROUP BY doc_id),
        kept AS (SELECT x.doc_id, count(c.p) AS n_removed, string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE c.p IS NULL) AS kept
            FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) x LEFT JOIN cut c ON c.doc_id = x.doc_id AND c.p = x.i GROUP BY x.doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256, coalesce(s.spans, '') AS spans
        FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN spans s ON s.doc_id = d.doc_id"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LETTERS_AND_DIGITS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_SHARE = "(1 + ((1000000000::HUGEINT * ({n} + 1)) // ({size}))::BIGINT)"

ORACLE_SQL = {
    "op1_suffix_array_dedup": _REPEATS_SQL.format(window=50),
    "op2_substring_dedup": _REPEATS_SQL.format(window=20),
    "op3_source_mixing": """
        WITH RECURSIVE sizes AS (
            SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size,
                   CASE WHEN regexp_matches(source, '^src(1?[0-9])$') THEN 1.0 + substr(source, 4)::INT % 4 ELSE 1.0 END::DOUBLE AS weight
            FROM documents GROUP BY source),
        rates AS (SELECT source, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes),
        parts AS (SELECT source, greatest(1, ceil(rate / 64.0))::INT AS parts, rate / greatest(1, ceil(rate / 64.0))::INT AS mean FROM rates),
        cdf AS (
            SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parts
            UNION ALL
            SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 24)),
        table_of AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
        draws AS (
            SELECT d.doc_id, d.source, length(d.text) AS text_length, t.cs,
                   ((('0x' || substr(md5('20:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || j.j), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
            FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN table_of t ON d.source IS NOT DISTINCT FROM t.source,
                 LATERAL (SELECT unnest(range(p.parts)) AS j) j),
        times AS (SELECT doc_id, source, text_length, sum(len(list_filter(cs, lambda c: c < u)))::INT AS n FROM draws GROUP BY ALL)
        SELECT doc_id, source, c.copy, md5('20-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || c.copy) AS shuffle_key, text_length
        FROM times, LATERAL (SELECT unnest(range(n)) AS copy) c""",
    "op8_exact_dedup": """
        WITH normal AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM normal WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_source_divergence": f"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all({_LOWERED}, '{_LETTERS}') AS terms FROM documents),
        words AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM d),
        sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
        shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", size="size + v")} AS p
            FROM sizes JOIN vocabulary USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
        of_lang AS (SELECT lang, term, {_SHARE.format(n="sum(n)", size="any_value(size) + any_value(v)")} AS q
            FROM counts JOIN (SELECT lang, sum(size) AS size FROM sizes GROUP BY lang) USING (lang) JOIN vocabulary USING (lang) GROUP BY lang, term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200""",
    "op13_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_LETTERS_AND_DIGITS}') AS terms FROM documents),
        totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS total FROM d),
        items AS (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{_LETTERS_AND_DIGITS}')) AS term FROM benchmark),
        wanted AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL),
        posts AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), totals),
        scored AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN posts USING (term), totals GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10""",
}
