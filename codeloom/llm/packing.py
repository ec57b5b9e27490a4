"""Best-fit packing of token pieces by a configuration linear program over the length histogram."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.llm._common import materialize, row_key

#: Word pieces whose ids a Python worker remembers, about 200 bytes each.
REMEMBERED = 800_000
#: The tokenizer's own split of a lower-case text, spelled out for characters up to U+00FF.
LETTER, DIGIT, SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")


#: A text that goes to the tokenizer whole has one of these: separators that only Python takes for white space, or what is beyond U+00FF.
BEYOND = re.compile("[\x1c-\x1f\u0100-\U0010ffff]")
#: Signs that stand for themselves in the tokenizer's alphabet of bytes.
PLAIN = re.compile("[!-~]+")


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes.

    A piece of a text (run of letters, digit, run of other signs) has the same ids wherever it stands,
    so ids of pieces are remembered, and those of words between white space as well while half of
    what may be remembered is free.  That holds where lower-casing and normalisation act on single
    characters; a text with a character beyond U+00FF, or with what may be a special token, goes to
    the tokenizer whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.memo: dict[str, bytes] = {}
        self.remembered = remembered

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, pieces: set[str]) -> None:
        """Remembers pieces; those of plain signs need nothing of the tokenizer but its model."""
        others = []
        for piece in pieces:
            if PLAIN.fullmatch(piece):
                self.memo[piece] = self._packed([token.id for token in self.model.tokenize(piece)])
            else:
                others.append(piece)
        for piece, found in zip(others, self.whole.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.memo[piece] = self._packed(found.ids)

    def ids(self, text: str) -> bytes:
        if "<|" in text or BEYOND.search(text):
            return self._packed(self.whole.encode(text, add_special_tokens=False).ids)
        words = text.lower().split()
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > self.remembered:
                memo.clear()
            pieces = {w: PIECES.findall(w) for w in set(words) if w not in memo}
            self._learn({p for held in pieces.values() for p in held if p not in memo})
            new = {w: b"".join(map(memo.__getitem__, held)) for w, held in pieces.items()}
            if len(memo) < self.remembered // 2:
                memo |= new
            return b"".join([new[w] if w in new else memo[w] for w in words])


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str, remembered: int) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path, remembered)
    return _ENCODERS[path]


def _tokenize(path: str, capacity: int, end_id: int, remembered: int, id_type: pa.DataType):
    names = ["rk", "doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
    types = [pa.int64(), id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path, remembered), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for rk, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((rk, doc_id, piece, at // 4, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def dearest(weights: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack of the highest price: how much it is worth, and how often it holds each size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(weights[0]), capacity + 1):
        n = int(np.searchsorted(weights, room, "right"))
        worth = prices[:n] + best[room - weights[:n]]
        top = int(worth.argmax())
        best[room], last[room] = (worth[top], top) if worth[top] > best[room - 1] else (best[room - 1], -1)
    held, room = np.zeros(len(weights), np.int64), capacity
    while room > 0:
        if last[room] >= 0:
            held[last[room]] += 1
            room -= int(weights[last[room]])
        else:
            room -= 1
    return float(best[capacity]), held


def solve_fractional(weights: np.ndarray, need: np.ndarray, capacity: int, gap: float = 0.05, rate: float = 0.1, lazy: int = 50) -> tuple[dict[tuple[int, ...], float], float]:
    """How often to use each configuration (how many of each size, within capacity) to cover need, and
    a lower bound on all uses.

    Multiplicative weights: a size's price falls exponentially with how often it is covered, and each
    step uses the dearest configuration as often as covers ``rate`` of one of its sizes.  A knapsack
    dynamic program prices configurations; as prices move slowly, it is asked every ``lazy`` steps and
    known configurations serve in between.  Its prices are a dual solution: need at these prices, by
    the worth of the dearest configuration, bounds every solution from below.  Steps end when the
    uses, scaled to cover all, are within ``gap`` of the best bound; where a hundred times as many
    steps as there are sizes bring them no nearer, ``rate`` is halved.
    """
    if not len(weights):
        return {}, 0.0
    known = np.empty((0, len(need)))
    uses = np.zeros(0)
    covered, bound, best, stale, steps = np.zeros(len(need)), 0.0, np.inf, 0, 0
    while True:
        share = covered / need
        low = share.min()
        price = np.exp(low - share) / need
        if steps % lazy == 0:
            worth, held = dearest(weights, price, capacity)
            bound = max(bound, float(price @ need) / worth)
            if not (known == held).all(1).any():
                known, uses = np.vstack((known, held)), np.append(uses, 0.0)
            if low > 0:
                found = float(uses.sum() / low)
                if found <= bound * (1 + gap):
                    break
                best, stale = (found, 0) if found < best * (1 - gap / 50) else (best, stale + lazy)
                if stale > 100 * len(need):
                    rate, stale = rate / 2, 0
        steps += 1
        at = int((known @ price).argmax())
        some = known[at] > 0
        step = rate * float((need[some] / known[at][some]).min())
        uses[at] += step
        covered += known[at] * step
    return {tuple(np.repeat(np.arange(len(c)), c.astype(int))[::-1].tolist()): x / low for c, x in zip(known, uses, strict=True) if x}, bound


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs at least.

    For each limit up to half of capacity: what is longer than capacity less limit is alone, what is
    longer than half has one each, and what is between limit and half has to fit in what these leave.
    """
    n = np.zeros(capacity + 1, np.int64)
    for length, times in counts.items():
        n[length] = times
    size, at = np.cumsum(n * np.arange(capacity + 1)), np.cumsum(n)
    half, best = capacity // 2, -(-int(size[-1]) // capacity)
    for limit in range(half + 1):
        alone = int(at[-1] - at[capacity - limit])
        large = int(at[capacity - limit] - at[half])
        room = large * capacity - int(size[capacity - limit] - size[half])
        small = int(size[half] - (size[limit - 1] if limit else 0))
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) rows as best fit makes them of the pieces by falling length.  Sequences of equal
    content are one row, and each length divides one row at most, so work depends on the number of
    different lengths alone."""
    rows: dict[int, list[list]] = {}  # by room: [times, lengths]
    done: list[tuple[int, list[int]]] = []

    def put(times: int, lengths: list[int], room: int) -> None:
        if times and room:
            rows.setdefault(room, []).append([times, lengths])
        elif times:
            done.append((times, lengths))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in rows if r >= length):
            fit = room // length
            while left and rows.get(room):
                times, lengths = rows[room].pop()
                filled = min(times, left // fit)
                put(filled, lengths + [length] * fit, room - fit * length)
                left -= filled * fit
                if filled < times:  # fewer are left than fill one
                    put(1 if left else 0, lengths + [length] * left, room - left * length)
                    put(times - filled - (1 if left else 0), lengths, room)
                    left = 0
                    break
            if not rows.get(room):
                rows.pop(room, None)
            if not left:
                break
        fit = capacity // length
        put(left // fit, [length] * fit, capacity - fit * length)
        put(1 if left % fit else 0, [length] * (left % fit), capacity - left % fit * length)
    return done + [(times, lengths) for held in rows.values() for times, lengths in held]


def pack_histogram(counts: dict[int, int], capacity: int, grain: int = 64, unit: int = 8) -> list[tuple[int, list[int]]]:
    """(times, lengths) rows that use up every length's count, each row's lengths fitting capacity.

    Of three plans the one of the fewest sequences: the program's, its filling of single lengths
    without the program, and best fit of the pieces by falling length.  Cells make the program blind to
    lengths that only just fit together, and there the plain plans are better.  All three come from the
    histogram alone.
    """
    counts = {length: n for length, n in counts.items() if n}
    plans = [program_plan(counts, capacity, grain, unit, True), program_plan(counts, capacity, grain, unit, False), best_fit_decreasing(counts, capacity)]
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def program_plan(counts: dict[int, int], capacity: int, grain: int = 64, unit: int = 8, program: bool = True) -> list[tuple[int, list[int]]]:
    """(times, lengths) rows by the configuration program, or, without ``program``, by its filling alone.

    The program is solved over cells of ``grain`` lengths, or over the lengths where they are few; a
    cell weighs its mean length, in whole ``unit``s.  Rounding uses every configuration its whole
    number of times and with all its cells: a cell's place takes the length at hand that keeps the sum
    nearest to that of the means, the last two places those that fill the room best, until no lengths
    are left that fill the sequence as the program counts on.  What room is left, and the pieces left
    over, are filled longest first with the best fit of one or two lengths.  Work depends on the number of different lengths and not on that of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[int, list[int]]] = []

    def best_two(room: int, held: list[int]) -> list[int]:
        """The one or two lengths at hand that fill room best."""
        have = np.flatnonzero(left[: room + 1])
        have = have[have > 0]
        if not len(have):
            return []
        spare = Counter(held)
        free = left[have] - np.array([spare[int(x)] for x in have]) if held else left[have]
        have, free = have[free > 0], free[free > 0]
        if not len(have):
            return []
        one = int(have[-1])
        rest = np.searchsorted(have, room - have, "right") - 1
        other = np.where(rest >= 0, have[np.maximum(rest, 0)], 0)
        same = (other == have) & (free < 2)
        rest = np.where(same, rest - 1, rest)
        other = np.where(rest >= 0, have[np.maximum(rest, 0)], 0)
        sums = np.where(other > 0, have + other, 0)
        top = len(sums) - 1 - int(sums[::-1].argmax())
        return [int(have[top]), int(other[top])] if sums[top] > one else [one]

    def use(lengths: list[int], most: int) -> int:
        need = Counter(lengths)
        times = min(most, *(int(left[x]) // m for x, m in need.items()))
        if times:
            plan.append((times, sorted(lengths, reverse=True)))
            for x, m in need.items():
                left[x] -= m * times
        return times

    def fill(lengths: list[int]) -> list[int]:
        """Adds best fits until nothing fits."""
        room = capacity - sum(lengths)
        while room > 0 and (more := best_two(room, lengths)):
            lengths = lengths + more
            room -= sum(more)
        return lengths

    def at_hand(cell: int, room: int, held: list[int]) -> list[int]:
        return [x for x in members[cell] if x <= room and left[x] > held.count(x)]

    def placed(config: list[int]) -> list[int]:
        """Lengths at hand for all of a configuration's cells, with a sum of their means at least; none
        if there are no such."""
        lengths: list[int] = []
        aim, more = 0.0, (capacity - sum(middle[cell] for cell in config)) / len(config)
        for cell in config[:-2]:
            aim += middle[cell] + more
            have = at_hand(cell, capacity - sum(lengths), lengths)
            if not have:
                return []
            wanted = aim - sum(lengths)
            lengths.append(min(have, key=lambda x: abs(x - wanted)))
        room = capacity - sum(lengths)
        ends = [at_hand(cell, room, lengths) for cell in config[-2:]]
        both = [(x + y, x, y) for x in ends[0] for y in ends[-1] if x + y <= room and (x != y or left[x] > lengths.count(x) + 1)] if len(ends) > 1 else []
        lengths += max(both)[1:] if both else [max(ends[0])] if len(ends) == 1 and ends[0] else []
        return lengths if len(lengths) == len(config) and sum(lengths) > sum(middle[cell] for cell in config) - 1 else []

    lengths_used = [int(x) for x in np.flatnonzero(left)]
    if len(lengths_used) <= capacity // grain:
        members = [[x] for x in lengths_used]
    else:
        members = [list(g) for _, g in groupby(lengths_used, lambda x: (x - 1) // grain)]
    need = np.array([left[m].sum() for m in members], float)
    middle = [float((left[m] * np.array(m)).sum() / n) for m, n in zip(members, need, strict=True)]
    weights = np.array([-(-x // unit) for x in middle], np.int64)
    uses, bound = solve_fractional(weights, need, capacity // unit) if program else ({}, 0.0)
    scale = bound / max(1e-9, sum(uses.values()))  # what covers a length twice is no use
    for config, wanted in sorted(uses.items(), reverse=True):
        quota = int(wanted * scale)
        while quota > 0 and (lengths := placed(list(config))):
            quota -= use(fill(lengths), quota)
    while len(rest := np.flatnonzero(left)):
        use(fill([int(rest[-1])]), int(left[rest[-1]]))
    return plan


def _slots(plan: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """By length and first rank: where the pieces of a length with ranks from there on go."""
    rows, used, sequence = [], Counter(), 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    rows.sort()
    length, first, base, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return length << 40 | first, first, base, offset


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, base, offset = slots.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            columns = [batch.column(i) for i in range(6)] + [pa.array(base[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, ["rk", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: rk, doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are the tokenizer's without special tokens, then ``end_id``; only longer ones are
    cut, into pieces of ``capacity``.  The driver gets the histogram of lengths, at most ``capacity``
    rows, and deals configurations to it; pieces find their sequence by their rank among those of
    their length, which is made of ranks within tasks and the counts of tasks before, so no task
    ranks all pieces of a common length.  The table of slots has a few rows for each different length.

    ``tokenizer`` is the path of a word_bpe file, on every executor; ``remembered`` bounds the word
    pieces a Python worker keeps ids of, which trades memory for time and changes no result.  Null counts as empty: one piece
    with ``end_id`` alone.  Rows with equal or null ids are packed one by one; rk tells texts apart.
    An empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(row_key(id_col, text_col).alias("rk"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    arrow_id = to_arrow_type(docs.schema[id_col].dataType)
    schema = f"rk long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, place long"
    pieces = materialize(source.mapInArrow(_tokenize(tokenizer, capacity, end_id, remembered, arrow_id), schema), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(histogram, capacity)))
    ranked = pieces.join(starts, ["length", "task"]).select("rk", "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(_place(slots), f"rk long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
