"""Ranked lexical search: postings in buckets of terms, integer scores, the best documents of each item."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._common import materialize, quoted
from codeloom.llm._terms import NO_LETTERS_OR_DIGITS, count_terms

#: Rows of item terms that are broadcast at once; items with more are searched in several blocks.
BROADCAST_TERMS = 500_000
#: Buckets of terms, each a folder of the postings table.
BUCKETS = 8
#: The bucket of the documents' own rows, which have no term.
OF_DOCUMENTS = -1


def _bucket(buckets: int) -> Column:
    return F.when(F.col("term").isNull(), OF_DOCUMENTS).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times) of the items; rows that share an id are one item."""
    held = items.select(F.col(quoted(id_col)).alias("item_id"), F.col(quoted(text_col)).alias("text"))
    counted = count_terms(held, "text", NO_LETTERS_OR_DIGITS).select("item_id", F.inline_outer("terms")).filter("term is not null")
    return counted.groupBy("item_id", "term").agg(F.sum("tf").alias("times"))


def postings(docs: DataFrame, terms: DataFrame | None = None, broadcast: bool = True, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written postings (rid, doc_id, n, term, tf, bucket), by bucket of the term: a row for each
    different term of a document, and one without a term for the document itself.

    ``rid`` numbers the rows of docs, so repeated and null ids are documents of their own.  With
    ``terms`` (term) only those have postings; ``broadcast`` if their number is known to allow it.
    Terms are counted in the row of their text: nothing is shuffled.  A frequent term is spread over
    the tasks of its documents, so no bucket is one task's work.
    """
    held = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    counted = count_terms(held, "text", NO_LETTERS_OR_DIGITS)
    own = F.expr("array(named_struct('term', cast(null as string), 'tf', n))")
    rows = counted.select("rid", "doc_id", "n", F.inline_outer(F.concat(own, "terms")))
    if terms is not None:
        wanted = terms.select(F.col("term").alias("wanted")).distinct()
        joined = rows.join(F.broadcast(wanted) if broadcast else wanted, F.col("term") == F.col("wanted"), "left")
        rows = joined.filter("term is null or wanted is not null").drop("wanted")
    return materialize(rows.withColumn("bucket", _bucket(buckets)), "postings", by=("bucket",))


def search(posts: DataFrame, terms: DataFrame, k: int = 10, buckets: int = BUCKETS, most: int = BROADCAST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item of
    ``terms`` (item_id, term, times), the least doc_id first among equals, null ids last.

    A document's score sums, over the item's terms with repeats, w * (10^9 tf div (1000 tf + 8 m)),
    with w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 25 + 75 n N div L.  Only the buckets that
    hold a term of the items are read.  Each posting meets the items that have its term; matches are
    scored as integers and summed by item and document.  Postings are dealt by document for that, so
    that a sum needs no shuffle of matches, of which there are far more than postings; then each task
    sends on its best ``k`` of an item.  Item terms are broadcast, at most ``most`` rows at once: more
    are searched block by block of items, each block's result being written.
    """
    own = posts.filter(F.col("bucket") == OF_DOCUMENTS)
    docs, total = own.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not total:
        return terms.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(posts.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    read = [r[0] for r in terms.select(_bucket(buckets)).distinct().collect()]
    found = posts.filter(F.col("bucket").isin(*read) if read else F.lit(False))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    weighed = materialize(terms.join(df, "term").select("item_id", "term", (F.col("times") * weight).alias("weight")), "item-weights")
    blocks = max(1, math.ceil(weighed.count() / most))

    length = F.expr(f"cast(25 + (cast(75 as decimal(38, 0)) * n * {docs}L) div {total}L as bigint)")
    dealt = found.select("rid", "doc_id", "term", F.expr("1000000000 * tf").alias("over"), (F.expr("1000 * tf") + 8 * length).alias("under")).repartition("rid")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rid")

    def block(of: DataFrame) -> DataFrame:
        matches = dealt.join(F.broadcast(of), "term").select("item_id", "rid", "doc_id", F.expr("weight * (over div under)").alias("score"))
        summed = matches.groupBy("rid", "doc_id", "item_id").agg(F.sum("score").alias("score")).filter("score > 0")
        return summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

    if blocks == 1:
        return block(weighed)
    number = F.pmod(F.xxhash64(F.lit(5), "item_id"), F.lit(blocks))
    parts = [materialize(block(weighed.filter(number == b)), "best-of-items") for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = BROADCAST_TERMS) -> DataFrame:
    """The ``k`` best documents of each item: postings of the items' terms, then search.

    Terms are runs of ASCII letters and digits and of signs beyond ASCII in the whole text, A-Z
    lower-cased.  Null and empty texts have none: such a document is never found, such an item finds
    none.  Rows that share an item's id are one item.  Repeated documents are documents of their own,
    each with its rank.  Without documents or items the result is empty.  Other columns are not read,
    whatever their names.
    """
    terms = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    small = terms.count() <= most
    return search(postings(docs, terms, small, id_col=id_col, text_col=text_col), terms, k, most=most)
