"""Toxicity: maximum-scoring segments over the log-odds of tokens, calibrated by their extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import materialize, quoted, row_key, sample_by_hash

#: Words: runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: A word is looked up by itself and by its beginnings of these lengths.
BEGINNINGS = (3, 4, 5, 6)
#: Words that a task remembers the score of.
REMEMBERED = 300_000


def units(word: str) -> list[str]:
    """A word and its beginnings, the shortest first: each stands for all words that begin like it.
    The word itself ends in a blank, so that it's told from a beginning."""
    return [word[:n] for n in BEGINNINGS if n < len(word)] + [word + " "]


def log_odds(counts: dict[str, tuple[int, int]], clean: int, toxic: int, prior: float = 10.0, sure: float = 2.0, least: float = math.log(2)) -> dict[str, float]:
    """The log-odds of units by how many clean and toxic documents have a word of theirs.

    A unit's share of toxic documents has a two-class Dirichlet prior of weight ``prior`` around the
    share of its next shorter beginning, a shortest one around that of all documents.  Its log-odds
    against all documents are taken at the end of the Wilson interval of ``sure`` standard deviations
    that is nearer to them, so that rare words prove little; below ``least`` they count as 0.  Units that
    say what their beginning says are left out.
    """
    base = (toxic + 1) / (clean + toxic + 2)
    share: dict[str, float] = {}
    said: dict[str, float] = {}
    for unit in sorted(counts, key=lambda u: (len(u), u)):  # a beginning comes before what it begins
        word = unit.rstrip(" ")
        before = [word[:n] for n in BEGINNINGS if n < len(word)]
        above = next((share[b] for b in reversed(before) if b in share), base)
        n = sum(counts[unit]) + prior
        share[unit] = p = (counts[unit][1] + prior * above) / n
        middle, reach = p + sure**2 / (2 * n), sure * math.sqrt(p * (1 - p) / n + sure**2 / (4 * n * n))
        low, high = ((middle + side * reach) / (1 + sure**2 / n) for side in (-1, 1))
        near = min(max(base, low), high)
        odds = math.log(near / (1 - near)) - math.log(base / (1 - base))
        odds = odds if abs(odds) >= least else 0.0
        if odds != next((said[b] for b in reversed(before) if b in said), 0.0):
            said[unit] = odds
    return said


class Scores(dict):
    """The score of each word, found when first asked for."""

    def __init__(self, odds: dict[str, float], shift: float):
        super().__init__()
        self.odds, self.shift = odds, shift

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        known = next((self.odds[u] for u in reversed(units(word)) if u in self.odds), 0.0)
        self[word] = score = known - self.shift
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score): in order, apart, each of them without a part
    of it or a longer segment that scores more.  Linear time: only positive scores are walked, and
    segments that are passed over once are skipped by links afterwards."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # start, end, total before, total after, the last one before it of a lower total
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = at, at + 1, float(total[at]), float(total[at + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([start, end, low, high, j])
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(start, end, high - low) for start, end, low, high, _ in found]


@dataclass
class Toxicity:
    """What is learned: log-odds of units, the shift that makes clean text lose, the tail of the best
    segment of clean text (rate and frequency), and the logistic curve over evidence."""

    odds: dict[str, float] = field(default_factory=dict)
    shift: float = 1.0
    rate: float = 1.0
    often: float = 1.0
    low: float = -10.0
    slope: float = 0.0

    def scores(self) -> Scores:
        return Scores(self.odds, self.shift)

    def passages(self, words: list[str], scores: Scores, chance: float | None = 0.05) -> list[tuple[int, int, float, float]]:
        """Segments (first word, end, score, expected) of a text, where ``expected`` is how many as good
        ones a clean text of that length has; those of ``chance`` or less."""
        found = maximal_segments(np.fromiter(map(scores.__getitem__, words), float, len(words)))
        told = [(a, b, s, self.expected(len(words), s)) for a, b, s in found]
        return told if chance is None else [x for x in told if x[3] <= chance]

    def expected(self, length: int, score: float) -> float:
        return self.often * max(1, length) * math.exp(-self.rate * score)

    def evidence(self, found: list[tuple[int, int, float, float]]) -> float:
        """The sum of -log(expected) over segments that are rarer than one in a clean text."""
        return sum(max(0.0, -math.log(max(e, 1e-300))) for *_, e in found)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.low + self.slope * math.log1p(evidence)))))


def tail(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Rate and frequency of the exponential tail of clean texts' best segments: how many segments above
    x a text of n words has is n * often * exp(-rate x).  By the median of what goes beyond the upper
    fifth, which a few texts with wrong labels hardly move."""
    above = best[best > 0]
    if len(above) < 5:
        return 1.0, (len(above) + 1) / max(1.0, float(lengths.sum()))
    from_here = float(np.quantile(above, 0.8))
    beyond = above[above >= from_here] - from_here
    rate = min(2.0, max(0.2, math.log(2) / max(1e-6, float(np.median(beyond)))))
    return rate, len(beyond) * math.exp(rate * from_here) / max(1.0, float(lengths.sum()))


def curve(evidence: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """The logistic curve over log(1 + evidence): intercept and slope by Newton's method, with a weak
    pull of both towards 0."""
    x = np.stack([np.ones(len(labels)), np.log1p(evidence)], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (labels - p) - 0.01 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def _shingle_hash(words: str, seed: int, size: int = 3) -> Column:
    """The least hash of an array column's runs of ``size`` words: texts that share nearly all of them
    nearly always share it."""
    return F.expr(f"array_min(transform(sequence(1, greatest(1, size({words}) - {size - 1})), i -> xxhash64({seed}, concat_ws(' ', slice({words}, i, {size})))))")


def training_texts(docs: DataFrame, labels: DataFrame, train_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(h, text, words, toxic, fold) of at most ``train_rows`` labelled texts, chosen by their hash.

    Labels meet ids and hashes alone; the chosen ones are few, so only their texts are fetched.  Of
    equal texts one is taken, and of near copies that share the least hash of their shingles, for two
    seeds, as well, or else all words of a text with many copies would look toxic or clean.
    """
    said = labels.groupBy(F.col(quoted(id_col)).alias("id")).agg(F.max(quoted(label_col)).alias("toxic")).filter("id is not null and toxic is not null")
    held = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(quoted(text_col)).alias("h"), F.col(quoted(text_col)).alias("text"))
    chosen = materialize(sample_by_hash(held.select("id", "h").join(said, "id"), train_rows), "toxic-sample")
    fetched = held.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["h"])
    words = fetched.withColumn("words", F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))
    kept = materialize(words.select("h", "text", "words", F.col("toxic").cast("int").alias("toxic"), F.pmod("h", F.lit(2)).alias("fold"), *[_shingle_hash("words", seed).alias(f"m{seed}") for seed in (1, 2)]), "toxic-texts")
    first = kept.groupBy("m1").agg(F.min(F.struct("h", "m2")).alias("one")).groupBy("one.m2").agg(F.min("one.h").alias("h"))
    return kept.join(F.broadcast(first.select("h")), "h").drop("m1", "m2")


def _counts(texts: DataFrame, least_docs: int) -> list[dict]:
    """(unit, and by fold and label the documents with a word of it) of the units that have enough."""
    each = [F.count_if((F.col("fold") == fold) & (F.col("toxic") == toxic)).alias(f"n{fold}{toxic}") for fold in (0, 1) for toxic in (0, 1)]
    words = texts.select("fold", "toxic", F.explode_outer(F.array_distinct("words")).alias("word")).filter("word <> ''").groupBy("word").agg(*each)
    names = [f"n{fold}{toxic}" for fold in (0, 1) for toxic in (0, 1)]
    beginnings = F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in BEGINNINGS], F.concat("word", F.lit(" ")))
    named = words.select(F.explode_outer(F.array_compact(beginnings)).alias("unit"), *names)
    sums = named.groupBy("unit").agg(*[F.sum(n).alias(n) for n in names])
    return sums.filter(" + ".join(names) + f" >= {least_docs}").toArrow().to_pylist()


def _observe(shared) -> Callable:
    """Of each training text, scored by the model of the other fold: the scores of its segments, its
    length, and the sum of exp(log-odds) over its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [model.scores() for model in shared.value]
        for batch in batches:
            out = []
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scores = np.fromiter(map(held[1 - fold].__getitem__, WORD.findall((text or "").lower())), float)
                out.append((len(scores), [s for *_, s in maximal_segments(scores)]))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.float64()))], ["toxic", "n", "segments"])

    return run


def _shift(odds: dict[str, float], clean_words: Counter) -> float:
    """What to take off each word's log-odds, so that the sum of exp(score) over clean words is their
    number: then a clean text's score drifts down, and a segment of score s is exp(-s) rare."""
    scores, total = Scores(odds, 0.0), sum(clean_words.values())
    grown = sum(n * math.exp(scores[w]) for w, n in clean_words.items())
    return max(0.1, math.log(grown / total)) if total else 0.1


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Learns from at most ``train_rows`` labelled texts, the only rows of ``labels`` and of ``docs`` that
    decide anything; what reaches the driver is bounded by their number.

    Log-odds come from counts of documents by word and by beginning of a word.  The tail of clean
    texts' segments and the curve from evidence to score are fitted on scores of each half of the
    sample under the log-odds of the other half, since words prove more on the texts they come from.
    Without labels of both kinds every score is the share of toxic labels (0 if there is none).
    """
    texts = materialize(training_texts(docs, labels, train_rows, id_col, text_col, label_col), "toxic-training")
    sizes = {(r.fold, r.toxic): r.n for r in texts.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = (sum(n for (_, label), n in sizes.items() if label == y) for y in (0, 1))
    if not clean or not toxic:
        return Toxicity(low=30.0 if toxic else -30.0)
    rows = _counts(texts, least_docs)
    frequent = texts.filter("toxic = 0").select(F.explode_outer("words").alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    clean_words = Counter({r["word"]: r["n"] for r in frequent.filter(f"n >= {least_docs}").toArrow().to_pylist()})
    models = []
    for folds in ((0,), (1,), (0, 1)):
        counts = {r["unit"]: tuple(sum(r[f"n{f}{y}"] for f in folds) for y in (0, 1)) for r in rows}
        enough = {u: c for u, c in counts.items() if sum(c) >= least_docs}
        odds = log_odds(enough, *(sum(sizes.get((f, y), 0) for f in folds) for y in (0, 1)))
        models.append(Toxicity(odds, _shift(odds, clean_words)))
    *halves, model = models
    seen = texts.select("text", "fold", "toxic").mapInArrow(_observe(docs.sparkSession.sparkContext.broadcast(halves)), "toxic int, n long, segments array<double>").toArrow().to_pylist()
    rest = [r for r in seen if not r["toxic"]]
    model.rate, model.often = tail(np.array([max(r["segments"], default=0.0) for r in rest]), np.array([r["n"] for r in rest]))
    evidence = [model.evidence([(0, 0, s, model.expected(r["n"], s)) for s in r["segments"]]) for r in seen]
    model.low, model.slope = curve(np.array(evidence), np.array([r["toxic"] for r in seen], float))
    return model


def _find(shared, chance: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = model.scores()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            found, marks = [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                words = WORD.findall(text.lower())
                told = model.passages(words, scores, None)
                found.append(model.score(model.evidence(told)))
                rare = [x for x in told if x[3] <= chance]
                places = [m.span() for m in WORD.finditer(text)] if rare else []
                same = len(places) == len(words)  # lower-casing can add signs, but hardly words
                marks.append([{"start": places[a][0], "end": places[b - 1][1], "score": s, "expected": e} for a, b, s, e in rare] if same else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array(marks, spans)], ["doc_id", "rk", "score", "passages"])

    return run


def find_toxic(docs: DataFrame, model: Toxicity, chance: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, rk, score (0 to 1), passages (start, end, score, expected).

    Each word of the whole text has a score, its log-odds less a shift; one linear scan finds all
    maximal-scoring segments.  ``expected`` is how many segments as good a clean text of that length
    has by its extreme-value tail; passages of ``chance`` or less are returned, in code points with
    ``end`` exclusive.  The document's evidence sums -log(expected) over its segments, and a logistic
    curve fitted on held-out evidence gives the score.

    Nothing is shuffled.  Null and empty texts, and those without words, have no evidence and the
    curve's least score.  Ids may repeat or be null; repeated rows are judged alike; an empty table
    gives an empty result.  Other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(quoted(id_col)).alias("doc_id"), row_key(quoted(id_col), quoted(text_col)).alias("rk"), F.col(quoted(text_col)).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(_find(shared, chance), f"doc_id {kind}, rk long, score double, passages array<struct<start: long, end: long, score: double, expected: double>>")
