"""Document fingerprints by consistent weighted sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._common import named, row_key

#: Samples computed side by side in one row.  More would make generated methods too large for the
#: JVM's compiler.
LANES = 8
#: ln(a) + SHIFT, scaled by STEPS, is a sample's order as 31 bits.
SHIFT, STEPS = 128.0, float(1 << 23)


def _bounds(docs: DataFrame, per_block: int, most_blocks: int) -> list[tuple]:
    """(doc_id, rk) pairs that cut docs into blocks of about ``per_block`` rows, at most ``most_blocks``:
    quantiles of a sample by a hash of rk, of 16 rows a block."""
    rows = docs.count()
    blocks = min(most_blocks, rows // per_block)
    if blocks < 2:
        return []
    share = min(1.0, 16 * blocks / rows)
    sample = sorted(tuple(r) for r in docs.filter(F.xxhash64(F.lit(3), "rk") <= min(2**63 - 1, int((share - 0.5) * 2**64))).filter("doc_id is not null").select("doc_id", "rk").distinct().collect())
    return sorted({sample[i * len(sample) // blocks] for i in range(1, blocks)}) if sample else []


def _constant(numbers: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>") if numbers else F.lit([]).cast("array<bigint>")


def with_next(docs: DataFrame, per_block: int = 500, most_blocks: int = 1 << 14) -> DataFrame:
    """From (rk, doc_id, text), adds __next_rk and __next_text of the row next in order of (id, rk).

    After the last comes the first.  Rows are ordered within blocks, each a window of its own; blocks
    are cut at quantiles, so they are even however ids lie, and many rows of one id are cut too.  Rows
    with a null id come first and are cut by their hash alone, which is even.  Only a block's last row
    looks up the first of the next block that has rows, over a table of a row for each block.
    """
    rows, nulls = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    cuts = _bounds(docs, per_block, most_blocks)
    parts = max(1, min(most_blocks, nulls // per_block))
    if cuts:
        # the number of cuts at or before a row, by halving: log2 steps of built-in functions over two constant arrays
        lists = [_constant([c[i] for c in cuts]) for i in (0, 1)]
        before = lambda i: (F.get(lists[0], i) < F.col("doc_id")) | ((F.get(lists[0], i) == F.col("doc_id")) & (F.get(lists[1], i) <= F.col("rk")))
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
        place = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(cuts)) & before(n + step - 1), n + step).otherwise(n)).cast("long")
    else:
        place = F.lit(0).cast("long")
    # a null id's block is below 0; the hash in its upper 32 bits grows with rk
    null_place = F.expr(f"((shiftright(rk, 32) + 2147483648) * {parts}) div 4294967296 - {parts}")
    # never null as Spark sees it: a join would else filter its side by that below the shuffle, and texts would be shuffled twice
    block = F.coalesce(F.when(F.col("doc_id").isNull(), null_place).otherwise(place), F.lit(0).cast("long"))
    order = Window.partitionBy("__block").orderBy(F.col("doc_id").asc_nulls_first(), "rk")
    held = docs.withColumn("__block", block).withColumns(
        {"__at": F.row_number().over(order), "__next_rk": F.lead("rk").over(order), "__next_text": F.lead("text").over(order)}
    )
    firsts = held.filter("__at = 1").select(F.col("__block").alias("__of"), F.col("rk").alias("__next_rk"), F.col("text").alias("__next_text"))
    there = sorted(r[0] for r in docs.select(block.alias("b")).distinct().collect())  # most_blocks twice at most
    along = F.arrays_zip(_constant(there).alias("__block"), _constant(there[1:] + there[:1]).alias("__of"))
    following = docs.sparkSession.range(1).select(F.inline(along)).toDF("__block", "__of")
    ends = held.filter("__next_rk is null").drop("__next_rk", "__next_text").join(following, "__block").join(firsts, "__of").drop("__of")
    return held.filter("__next_rk is not null").unionByName(ends).drop("__at", "__block")


def merged_terms(text: str, other: str) -> tuple[dict[str, Column], ...]:
    """Columns, a projection each, that make __terms: (h, n0, n1) for each word of two texts.

    h has 47 bits of the word's hash, and 16 of its length (65,535 at most).  Words are sorted by it, those of the other
    text behind; the ends of runs give the counts.
    """

    def hashed(name: str, side: int) -> Column:
        words = F.filter(F.split(F.col(name), "[\\t-\\r ]+"), lambda w: w != "")
        return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-1 << 17)).bitwiseOR(F.least(F.length(w), F.lit(65535)).cast("long") * 2 + side))

    same = lambda a, b: F.shiftright(a, 1) == F.shiftright(b, 1)
    ends = F.filter(
        F.transform("__sorted", lambda h, i: F.struct(h.alias("h"), i.alias("i"), (~h.eqNullSafe(F.get("__sorted", i + 1))).alias("end"))),
        lambda x: x["end"],
    )
    runs = F.transform("__ends", lambda x, i: F.struct(x["h"].alias("h"), (x["i"] - F.coalesce(F.get("__ends", i - 1)["i"], F.lit(-1))).alias("n")))

    def pair(x: Column, i: Column) -> Column:
        other_side = x["h"].bitwiseAND(F.lit(1)) == 1
        after = F.get("__runs", i + 1)
        before = F.get("__runs", i - 1)
        twin = F.when(after.isNotNull() & same(after["h"], x["h"]), after["n"]).otherwise(0)
        alone = ~(before.isNotNull() & same(F.coalesce(before["h"], F.lit(0)), x["h"]))
        word = F.shiftright(x["h"], 1)
        return F.when(other_side, F.when(alone, F.struct(word.alias("h"), F.lit(0).alias("n0"), x["n"].alias("n1")))).otherwise(F.struct(word.alias("h"), x["n"].alias("n0"), twin.alias("n1")))

    return (
        {"__sorted": F.sort_array(F.concat(hashed(text, 0), hashed(other, 1)))},
        {"__ends": ends},
        {"__runs": runs},
        {"__terms": F.filter(F.transform("__runs", pair), lambda x: x.isNotNull())},
    )


def signatures(pairs: DataFrame, key: str, text: str, other: str, samples: int = 32) -> DataFrame:
    """(key, s0, s1): the samples of two texts for each key, as arrays of 32-bit numbers.

    Each sample draws, for a word of weight S and from hashes of word and sample alone, r and c from
    the Gamma(2, 1) distribution and b from (0, 1); t = floor(ln S / r + b), and the word with the
    least c / exp(r (t - b + 1)) is taken, with its t.  Two texts take the same with the probability
    of their generalised Jaccard similarity.  A word weighs its count times its squared length, so
    that short function words count little.
    """
    terms = pairs.select(key, text, other)
    for step in merged_terms(text, other):
        terms = terms.withColumns(step)
    # explode() would bring a filter that the optimizer pushes down, with all these columns spelled out in it
    rows = terms.select(key, F.explode_outer("__terms").alias("__t")).select(key, "__t.*")
    length = F.col("h").bitwiseAND(F.lit(65535)).cast("double")
    weighed = rows.select(key, "h", F.ln(F.col("n0") * length * length).alias("ln0"), F.ln(F.col("n1") * length * length).alias("ln1"))
    lanes = weighed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // LANES))))
    each = range(LANES)
    unit = lambda bits, n: (bits + F.lit(0.5)) * F.lit(2.0**-n)
    top = lambda x: unit(F.shiftrightunsigned(x, 43), 21)
    mid = lambda x: unit(F.shiftrightunsigned(x, 22).bitwiseAND(F.lit((1 << 21) - 1)), 21)

    def order(s: int, j: int) -> Column:
        """A word's place in a sample; what the two texts share is computed once by Spark."""
        x, y = (F.xxhash64("h", F.col("lane") * LANES + shift) for shift in (j, j + 4096))
        r, ln_c, b = -F.ln(top(x) * mid(x)), F.ln(-F.ln(top(y) * mid(y))), unit(x.bitwiseAND(F.lit((1 << 22) - 1)), 22)
        t = F.floor(F.col(f"ln{s}") / r + b)
        place = ((ln_c - r * (t - b + 1) + SHIFT) * STEPS).cast("long")
        return F.shiftleft(place, 32).bitwiseOR(F.xxhash64("h", t).bitwiseAND(F.lit((1 << 32) - 1)))

    least = lanes.groupBy(key, "lane").agg(*[F.min(order(s, j)).alias(f"m{s}{j}") for s in (0, 1) for j in each])
    taken = lambda s: F.array(*[F.coalesce(F.col(f"m{s}{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)) for j in each])
    parts = least.select(key, "lane", taken(0).alias("s0"), taken(1).alias("s1")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("lane", "s0", "s1"))).alias("__parts"))
    return parts.select(key, *[F.slice(F.flatten(F.col(f"__parts.{s}")), 1, samples).alias(s) for s in ("s0", "s1")])


def fingerprint_text(samples: Column) -> Column:
    """8 hexadecimal digits for each sample."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a).cast("double")


def fingerprint_documents(docs: DataFrame, samples: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: rk, doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by as many of the next
    document's first (ascending id, after the last the first), or all it has.  Words are split at
    ASCII white space; beyond 65,535 characters a word weighs no more.  The texts are shuffled once, by
    blocks of ids; a word's samples are reduced where the text is, so what is shuffled next is the size
    of the fingerprints.

    Null counts as empty; a text without words has a fingerprint of zeros, alike only to another.
    Rows with equal ids follow each other in the order of a hash; a null id comes first.  Ids are
    integers.  An empty table gives an empty result.  Other columns are not read.
    """
    source = docs.select(row_key(id_col, text_col).alias("rk"), named(id_col, "doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars, tail = F.length("text").cast("long"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - tail), F.substring(F.col("__next_text"), F.lit(1), tail))
    pairs = with_next(source).select(
        "rk", "doc_id", F.col("__next_rk").alias("next_rk"), F.xxhash64("rk", "__next_rk").alias("pair"), chars.alias("n_chars"), "text", edited.alias("edited")
    )
    signed = signatures(pairs, "pair", "text", "edited", samples)
    none = F.array_repeat(F.lit(0).cast("long"), samples)
    rows = pairs.select("rk", "doc_id", "next_rk", "pair", "n_chars", F.sha2("edited", 256).alias("edited_sha256")).join(signed, "pair", "left")
    rows = rows.withColumns({"s0": F.coalesce("s0", none), "s1": F.coalesce("s1", none)})
    by_row = rows.groupBy(F.col("rk").alias("next_rk")).agg(F.first("s0").alias("s_next"))
    return rows.join(by_row, "next_rk").select(
        "rk", "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("s0")).alias("fingerprint"), fingerprint_text(F.col("s1")).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1")).alias("near_edited"), likeness(F.col("s0"), F.col("s_next")).alias("near_next"),
    )
