"""Word windows that occur earlier, found through content-selected positions.

Both repeat operators share this frame.  Of every window of ``window`` words one position is
selected, that of its least word k-gram by hash; consecutive windows with one position make a
segment.  Equal windows select equal positions, so segments meet by the hash of the k-gram there, and
a position whose k-gram occurs once in the corpus can't be part of a repeat.  Only what is left is
cut out of the texts; equal segments become one row, and the operator's own matcher judges the
windows of each group of segments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.llm._common import RepeatFilter, materialize, named, quoted, row_key

#: Word hashes that a Python worker remembers.
MEMO = 40_000
#: Bytes of segments, by estimate, that a Python worker gathers before it sends them on.
GATHERED = 8_000_000
#: Rows of a batch that are Python objects at a time.
ROWS = 1000
#: Bytes of text in one batch of results.
PART = 4_000_000
#: Row keys of copies are broadcast up to this number (16 MB), and joined by a shuffle beyond.
BROADCAST_ROWS = 1 << 20
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

#: Words of an automaton's shard, by estimate and at most but for one group.
SHARD_WORDS = 50_000

#: Judges one group: each segment's words, place of the selected position and number of windows, in
#: order of (doc_id, start), to one array for each segment that tells which windows occur in an
#: earlier segment.
Matcher = Callable[[list[list[bytes]], list[int], list[int], int], list[np.ndarray]]


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def segments(words: list[bytes], window: int, k: int, memo: dict) -> tuple[np.ndarray, ...]:
    """(hash, start, windows, anchor) arrays: runs of windows that select one position.  anchor is
    the position's distance from the start."""
    n = len(words)
    if n < window:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int32)] * 3)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    grams = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams = grams * FACTOR + hashes[j : n - k + 1 + j]
    grams = (grams ^ grams >> np.uint64(31)) * MIX
    grams ^= grams >> np.uint64(29)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(1) + np.arange(n - window + 1)
    starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    counts = np.diff(np.concatenate((starts, [len(at)])))
    return grams[at[starts]], starts.astype(np.int32), counts.astype(np.int32), (at[starts] - starts).astype(np.int32)


def _tidy(run: Callable) -> Callable:
    """run, with Arrow's unused memory given back at its end: workers are kept for other tasks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return inner


def _find(window: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in batches:
            found, keys = [], []
            for rk, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                got = segments((text.as_py() or b"").split(), window, k, memo)
                if len(got[0]):
                    found.append(got)
                    keys.append((rk, len(got[0])))
            if found:
                gram, start, count, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
                rk = np.repeat(np.array([r for r, _ in keys], np.int64), [n for _, n in keys])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64), rk, start, count, anchor)], ["gram", "rk", "start", "windows", "anchor"])

    return _tidy(run)


def _cut(window: int, id_type: pa.DataType) -> Callable:
    names = ["route", "words", "doc_id", "rk", "start", "windows", "anchor"]
    types = [pa.int64(), pa.binary(), id_type, pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, bytes], tuple] = {}  # equal segments become one row here, before the shuffle
        size = 0

        def full() -> Iterator[pa.RecordBatch]:
            rows = [(*key, value[1], *value[2:]) for key, value in first.items()]
            for at in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + ROWS], strict=True), types, strict=True)], names)

        for batch in batches:
            for rk, doc_id, text, found in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = text.as_py().split()
                rk, doc_id = rk.as_py(), doc_id.as_py()
                for x in found.as_py():
                    start, count, anchor = x["start"], x["windows"], x["anchor"]
                    if x["hot"]:
                        parts = [(start + i, 1, anchor - i, b" ".join(words[start + i : start + i + window])) for i in range(count)]
                    else:
                        parts = [(start, count, anchor, b" ".join(words[start : start + count + window - 1]))]
                    for at, n, off, part in parts:
                        route = x["gram"]
                        if x["hot"]:
                            route = xxhash.xxh64_intdigest(part, 7)
                            route -= 1 << 64 if route >> 63 else 0
                        value = ((doc_id is not None, doc_id), doc_id, rk, at, n, off)
                        held = first.get((route, part))
                        if held is None:
                            size += len(part) + 300
                        if held is None or (value[0], rk, at) < (held[0], held[2], held[3]):
                            first[route, part] = value
                if size > GATHERED:
                    yield from full()
                    first, size = {}, 0
        yield from full()

    return _tidy(run)


def _judge(window: int, match: Matcher) -> Callable:
    """Rows come sorted by group, then id and start."""

    def verdicts(group: list[tuple]) -> list[tuple]:
        if len(group) == 1:  # a segment's own windows differ, as they are at different distances from its position
            flags = [np.zeros(group[0][4], np.uint8)]
        else:
            flags = match([g[1].split() for g in group], [g[5] for g in group], [g[4] for g in group], window)
        return [(g[2], g[3], np.asarray(f, np.uint8).tobytes()) for g, f in zip(group, flags, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["rk", "start", "flags"])

        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out: list[tuple] = []
            for row in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                if group and group[0][0] != row[0]:
                    out += verdicts(group)
                    group = []
                group.append(row)
            yield table(out)
        if group:
            yield table(verdicts(group))

    return _tidy(run)


def _removed(n: int, window: int, found: list[dict], judged: list[dict], copy: bool) -> np.ndarray:
    """Which of n words go: those of windows in candidate segments, unless a verdict clears them."""
    if copy:
        return np.full(n, n >= window)
    repeated = np.zeros(n, np.uint8)
    for x in found:
        repeated[x["start"] : x["start"] + x["windows"]] = 1
    for x in judged:
        flags = np.frombuffer(x["flags"], np.uint8)
        repeated[x["start"] : x["start"] + len(flags)] = flags
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(repeated)
    edges[starts] += 1
    edges[starts + window] -= 1
    return np.cumsum(edges)[:n] > 0


def _apply(window: int) -> Callable:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = (pa.int64(), pa.int64(), span, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            first, size = 0, 0

            def part(rows: list[tuple], first: int, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                ids = [batch.column(i).slice(first, len(rows)) for i in (0, 1)]
                return pa.RecordBatch.from_arrays([*ids, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["rk", "doc_id", "n_words", "n_removed", "spans", "kept"])

            for text, found, judged, copy in zip(*(batch.column(i) for i in (2, 3, 4, 5)), strict=True):
                words = (text.as_py() or b"").split()
                cut = _removed(len(words), window, found.as_py() or [], judged.as_py() or [], copy.is_valid)
                bounds = np.flatnonzero(np.diff(np.concatenate(([0], cut.view(np.int8), [0])))).reshape(-1, 2).tolist()
                kept = b" ".join(w for w, c in zip(words, cut.tolist(), strict=True) if not c) if bounds else b" ".join(words)
                rows.append((len(words), int(cut.sum()), [{"start": a, "end": b} for a, b in bounds], kept))
                size += len(kept)
                if size > PART:
                    yield part(rows, first)
                    first, rows, size = first + len(rows), [], 0
            if rows:
                yield part(rows, first)

    return _tidy(run)


def remove_repeats(docs: DataFrame, window: int, k: int, match: Matcher, id_col: str = "doc_id", text_col: str = "text", hot: int = 2048, shard_words: int | None = None, max_bits: int = 1 << 29) -> DataFrame:
    """One row per document: rk, doc_id, n_words, n_removed, spans (removed word ranges), kept_text.

    A word goes if it is covered by a window whose words also start earlier: in a row with a smaller
    id, or earlier in the same row.  Windows are judged on the input.

    Of rows with equal texts the first alone is looked at; the others have nothing that is not
    repeated.  Positions go to a written table and are counted there; a Bloom filter of those that
    occur again, sized by their number, clears most of the rest, and beyond ``max_bits`` of it a join
    does.  Texts are shuffled once, by row.  A position that occurs more than ``hot`` times is routed
    window by window instead, so that no task gets an unbounded group: equal segments and windows are
    one row for each task before they are shuffled.

    A group is what shares a position's k words, or, with ``shard_words``, a shard: such groups dealt
    by hash to as many shards as hold so many words each.
    """
    source = docs.select(row_key(quoted(id_col), quoted(text_col)).alias("rk"), named(id_col, "doc_id"), F.col(quoted(text_col)).cast("binary").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = materialize(source.select("rk", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")), "repeat-texts")
    groups = materialize(texts.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rk")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeat-groups")
    # groups and counts are written, so that joins have plain shuffles on both sides, of which Spark can split a hot key
    copies = materialize(texts.join(groups, ["h1", "h2"]).filter("rk <> first.rk").select("rk").distinct(), "repeat-copies")
    few = copies.count() <= BROADCAST_ROWS
    found = source.mapInArrow(_find(window, k), "gram long, rk long, start int, windows int, anchor int")
    places = materialize(found.join(F.broadcast(copies) if few else copies, "rk", "left_anti").select("gram", "rk", "start", "windows", "anchor"), "repeat-positions")
    repeated = RepeatFilter(places, "gram", hashes=1, bits_each=8, max_bits=max_bits, hashed=True)
    by_row = repeated.only(places, "gram", "n").groupBy("rk").agg(F.collect_list(F.struct("gram", "start", "windows", "anchor", (F.col("n") > hot).alias("hot"))).alias("found"))
    arrow_id = to_arrow_type(docs.schema[id_col].dataType)
    cut = source.join(by_row, "rk").mapInArrow(_cut(window, arrow_id), f"route long, words binary, doc_id {id_type}, rk long, start int, windows int, anchor int")
    if shard_words:
        segments_of = repeated.counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # a segment has half as many windows as the minimum is taken of, on average, and so many words more
        shards = max(1, math.ceil(segments_of * (window + (window - k) / 2) / shard_words))
        cut = cut.withColumn("route", F.pmod(F.xxhash64(F.lit(5), "route"), F.lit(shards)))
    firsts = cut.repartition("route").groupBy("route", "words").agg(F.min(F.struct("doc_id", "rk", "start", "windows", "anchor")).alias("f"))
    sorted_rows = firsts.select("route", "words", "f.rk", "f.start", "f.windows", "f.anchor", "f.doc_id").sortWithinPartitions("route", "doc_id", "rk", "start")
    judged = sorted_rows.mapInArrow(_judge(window, match), "rk long, start int, flags binary").groupBy("rk").agg(F.collect_list(F.struct("start", "flags")).alias("judged"))
    whole = source.join(by_row, "rk", "left").join(judged, "rk", "left").join(copies.withColumn("copy", F.lit(True)), "rk", "left")
    out = whole.mapInArrow(_apply(window), f"rk long, doc_id {id_type}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
    return out.select("rk", "doc_id", "n_words", "n_removed", "spans", F.col("kept").cast("string").alias("kept_text"))
