"""Near-dedup of 64-bit SimHash fingerprints, with candidates from Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import materialize, row_key
from codeloom.llm._components import connected_components

#: The generator polynomial of the binary Golay code of 23 bits: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: A fingerprint's three segments, as shift and width; each is the low bits of a 23-bit word.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
RADIUS = 3
#: Fingerprints of one bucket that a task compares; larger buckets are dealt out in pairs of blocks.
BUCKET = 8192


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of the division of 23-bit polynomials by the generator."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


class Golay:
    """Decodes 23-bit words to the codewords near them.

    The code is perfect: every word is within 3 bits of exactly one codeword.  A word at distance 3
    from it is at distance 4 from five others; a nearer word is so from none.  So the codewords
    within 4 bits of a word are 6 or 1, and two words that differ in one bit have the nearest
    codeword of either among those of the other.
    """

    def __init__(self) -> None:
        low, high = np.arange(1 << 12), np.arange(1 << 11) << 12
        self.low, self.high = _remainder(low), _remainder(high)
        bits = 1 << np.arange(23)
        sums = [np.zeros(1, np.int64)]  # error patterns by weight
        last = [np.zeros(1, np.int64)]
        top = [np.array([-1])]
        for _ in range(4):
            at = np.concatenate([np.full(23 - t - 1, i) for i, t in enumerate(top[-1])]) if len(last[-1]) else np.array([], int)
            new = np.concatenate([np.arange(t + 1, 23) for t in top[-1]])
            last.append(last[-1][at] | bits[new])
            top.append(new)
        sums = last
        self.errors = np.full((1 << 11, 6), -1, np.int64)
        for weight in range(4):
            self.errors[_remainder(sums[weight]), 0] = sums[weight]
        far = sums[4][np.argsort(_remainder(sums[4]), kind="stable")]
        of = _remainder(far)
        self.errors[of, 1 + np.arange(len(far)) % 5] = far

    def codewords(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 6) 12-bit indices of the codewords within 4 bits, the nearest first, and which exist."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        errors = self.errors[syndrome]
        return (words[:, None] ^ np.maximum(errors, 0)) >> 11, errors >= 0


_GOLAY: list[Golay] = []


def golay() -> Golay:
    """The code's tables, built once in each Python worker."""
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def candidate_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows such that fingerprints at 3 or fewer differing bits share a key.

    Of three segments, either each has at most one error, or one has two or more and the others have
    at most one together.  For the first case a key has a codeword of each segment: all near ones of
    two segments with the nearest of the third, and the nearest of two with all of the third; for
    the second an unchanged segment and a codeword of another.  Keys have 33 bits of a fingerprint
    at least.
    """
    prints = np.unique(prints)
    words = [(prints >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = [golay().codewords(w) for w in words]
    (a, a_is), (b, b_is), (c, c_is) = near
    keys, of = [], []

    def add(key: np.ndarray, there: np.ndarray) -> None:
        rows, cols = np.nonzero(there)
        keys.append(key[rows, cols])
        of.append(rows)

    n = len(prints)
    ab = (a[:, :, None] << 24 | b[:, None, :] << 12 | c[:, :1, None]).reshape(n, 36)
    add(ab, (a_is[:, :, None] & b_is[:, None, :]).reshape(n, 36))
    add(a[:, :1] << 24 | b[:, :1] << 12 | c[:, 1:], c_is[:, 1:])
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                tag += 1
                add(tag << 56 | words[i][:, None] << 12 | near[j][0], near[j][1])
    return np.concatenate(keys), prints[np.concatenate(of)]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a text: A-Z lower-cased, shingles of so many words with repeats, XXH64 with seed 42."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    """(.., text) to (.., fp), whatever columns stand before the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], np.uint64).view(np.int64)
            yield batch.drop_columns("text").append_column("fp", pa.array(prints, pa.int64()))

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), 8192):
            key, fp = candidate_keys(prints[at : at + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp.view(np.int64), pa.int64())], ["key", "fp"])


def local_links(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is reachable among distinct fingerprints of one bucket: for each part
    its least member with every other.  A member is compared with those not yet reached only, so a
    dense ball costs far less than its pairs and gives one link for each member."""
    links, left = [], np.sort(prints)
    while len(left) > 1:
        least, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            hit = np.bitwise_count(left ^ queue.pop()) <= RADIUS
            if hit.any():
                found = left[hit]
                left = left[~hit]
                links += [(int(least), int(x)) for x in found]
                queue.extend(found)
    return links


def _buckets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, fingerprints, whole) from rows sorted by key: buckets of up to ``most`` whole, a larger
    one in parts as they come, so that none is held."""
    keys: list[np.ndarray] = []
    prints: list[np.ndarray] = []
    large = None  # the key of the large bucket that goes on
    for batch in batches:
        k, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        p = p.view(np.uint64)
        if large is not None:
            end = int(np.searchsorted(k, large, "right"))
            if end:
                yield k[:end], p[:end], False
            k, p = k[end:], p[end:]
            large = large if not len(k) else None
        if not len(k):
            continue
        keys.append(k)
        prints.append(p)
        last = k[-1]
        cut = int(np.searchsorted(k, last))
        if cut or (len(keys) > 1 and keys[-2][-1] != last):
            yield np.concatenate([*keys[:-1], k[:cut]]), np.concatenate([*prints[:-1], p[:cut]]), True
            keys, prints = [k[cut:]], [p[cut:]]
        if sum(map(len, keys)) > most:
            yield np.concatenate(keys), np.concatenate(prints), False
            keys, prints, large = [], [], last
    if keys:
        yield np.concatenate(keys), np.concatenate(prints), True


def _links(most: int):
    """Links (a, b) of buckets; rows of a bucket beyond ``most`` come back as they are, with key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, prints, whole in _buckets(batches, most):
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            big = np.repeat((sizes > most) | ~np.bool_(whole), sizes)
            if big.any():
                none = pa.nulls(int(big.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(prints[big].view(np.int64)), none, pa.array(keys[big])], ["a", "b", "key"])
            if not whole:
                continue
            pairs = starts[sizes == 2]
            close = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= RADIUS]
            out = set(zip(prints[close].tolist(), prints[close + 1].tolist(), strict=True))
            middle = (sizes > 2) & (sizes <= most)
            for s, n in zip(starts[middle].tolist(), sizes[middle].tolist(), strict=True):
                out.update(local_links(np.unique(prints[s : s + n])))
            rows = np.array(sorted(out), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.nulls(len(rows), pa.int64())], ["a", "b", "key"])

    return run


def _block_links(rows: pa.Table) -> pa.Table:
    found = np.array(local_links(np.unique(rows.column("fp").to_numpy().view(np.uint64))), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def golay_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """From distinct fingerprints (fp), links (a, b) that join what is reachable at 3 or fewer bits.

    Each fingerprint is dealt to about 64 buckets by key; a bucket yields at most one link for each
    member.  A bucket of more than ``bucket`` fingerprints is no single task's work: its members are
    dealt to blocks by hash, and each pair of blocks is compared on its own, so a task holds about
    twice ``bucket`` of them and no pair is missed.
    """
    wide = prints.select("fp").repartition("fp")  # a row becomes 61 or so
    keyed = wide.mapInArrow(_keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(keyed.mapInArrow(_links(bucket), "a long, b long, key long"), "golay-links")
    large = found.filter("key is not null").select("key", F.col("a").alias("fp"))
    sizes = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("blocks")).cast("int")
    dealt = large.join(sizes, "key").withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
    across = pairs.groupBy("key", "i", "j").applyInArrow(_block_links, "a long, b long")
    return found.filter("key is null").select("a", "b").unionByName(across).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: rk (row key), doc_id, fp (64 bits as a long), component_id.

    Fingerprints link at 3 or fewer differing bits; component_id is the least id reachable.  Equal
    fingerprints are one node, so a group of copies is one row from the first aggregation on.
    Components come from rounds of stars over the links of golay_links, written after each.

    Null and empty texts have fingerprint 0 and link like any other; a text of one or two words is
    one shingle.  Ids may repeat or be null: null is no candidate for component_id unless a component
    has nothing else.  An empty table gives an empty result.  Other columns are not read.
    """
    source = docs.select(row_key(id_col, text_col).alias("rk"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    prints = materialize(source.mapInArrow(_fingerprints(3), f"rk long, doc_id {id_type}, fp long"), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(golay_links(nodes))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labels = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(labels, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("rk", "doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, the one with the least id; columns unchanged.

    Texts are near copies when their ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more.  Candidates are fingerprints of those shingles at 3 or fewer bits, by
    Golay keys; most near copies differ in more bits than that, so a prefix join over shingles adds
    the candidates that fingerprints can't give.  Each candidate is verified on the shingles, so that
    no pair is missed and none is wrong: see near_words.drop_similar, which also says how nulls,
    repeated rows and clashing names are treated.
    """
    from codeloom.llm.near_words import drop_similar

    def candidates(texts: DataFrame) -> DataFrame:
        """Links of nodes, from (node, text) rows of different texts."""
        of = materialize(texts.mapInArrow(_fingerprints(words), "node long, fp long"), "near-prints")
        first = of.groupBy("fp").agg(F.min("node").alias("first"))
        same = of.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
        links = golay_links(first).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
        return same.unionByName(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).filter("a <> b")

    return drop_similar(docs, words, similarity, id_col, text_col, candidates)
