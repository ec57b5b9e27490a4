"""Quality classifier: weak labels by expectation maximisation, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import row_key, sample_by_hash

BAD, ABSTAIN, GOOD = 0, 1, 2
#: Votes of a labeller that sees a share of something: bad from the upper bound, good to the lower.
BOUNDS = {"signs": (0.01, 0.06), "doubled": (0.004, 0.02), "capitals": (0.12, 0.4), "shouts": (0.002, 0.03), "bars": (0.002, 0.05), "repeats": (0.03, 0.15), "few_words": (0.5, 0.8), "no_letters": (0.2, 0.3), "joined": (0.02, 0.1)}
LABELLERS = tuple(BOUNDS)
#: What each kind of bad document starts from.
BAD_KINDS = (("signs", "doubled", "joined"), ("capitals", "shouts"), ("bars",), ("repeats", "few_words"), ("no_letters",))
#: In texts with fewer words only these labellers vote, and only bad: a few clean words prove nothing.
FEW = 8
ANY_LENGTH = ("signs", "doubled", "capitals", "bars", "no_letters", "joined")
LOWER, UPPER, SIGNS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"*$&#%@~^=<>{}[]\\_+|"
#: Classes of bytes: letters by case, digits, spaces, line ends, beyond ASCII; every other sign its own.
_CLASSES = bytearray(range(256))
for _i in range(256):
    _c = chr(_i)
    _CLASSES[_i] = 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t" else 5 if _c in "\n\r\v\f" else 6 if _i > 127 else 7 + _i % 33
CLASSES = bytes(_CLASSES)
WIDTH = 40


def shares(text: bytes, words: list[bytes]) -> np.ndarray:
    """What each labeller looks at, as a share."""
    n, m = max(1, len(text)), max(1, len(words))
    no_space = max(1, n - text.count(b" ") - text.count(b"\n"))
    lower, upper = n - len(text.translate(None, LOWER)), n - len(text.translate(None, UPPER))
    high = 0 if text.isascii() else n - len(text.translate(None, bytes(range(128, 256))))
    signs = n - len(text.translate(None, SIGNS))
    twice = sum(text.count(bytes([s, s])) for s in b"*$&#%!")
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    distinct = len(set(words))
    expected = m if m < 50 else 50 + (m - 50) * 0.4
    return np.array(
        [
            signs / no_space,
            twice / n,
            upper / max(1, lower + upper + high),
            text.count(b"!!") / m,
            text.count(b"|") / m,
            repeats / m,
            1 - min(1.0, distinct / expected),
            1 - (lower + upper + high) / no_space,
            sum(1 for w in words if w[-2:].count(w[-1:]) == 2 and not w[-1:].isalnum() and w[-1] < 128) / m,
        ]
    )


def votes(text: bytes | None) -> int:
    """The labellers' votes as digits to base 3."""
    words = (text or b"").split()
    if not words:
        return sum(ABSTAIN * 3**i for i in range(len(LABELLERS)))
    seen, out, few = shares(text, words), 0, len(words) < FEW
    for i, (name, (low, high)) in enumerate(BOUNDS.items()):
        if few:
            out += (BAD if name in ANY_LENGTH and seen[i] >= high else ABSTAIN) * 3**i
        else:
            out += (BAD if seen[i] >= high else GOOD if seen[i] <= low else ABSTAIN) * 3**i
    return out


def digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def unsaid(cast: np.ndarray) -> np.ndarray:
    """Votes that were not asked for: a text without any vote for good has few words, and there
    abstaining is no evidence."""
    return (cast == ABSTAIN) & ~(cast == GOOD).any(1)[:, None]


class LabelModel:
    """How often each labeller votes what on good documents and on each kind of bad ones, and how many
    there are of each.  Labellers are independent within a kind, not among bad documents at large:
    one that looks for bars says nothing about capitals."""

    def __init__(self, rate: np.ndarray, share: np.ndarray):
        self.rate, self.share = rate, share

    def _by_class(self, patterns: np.ndarray) -> np.ndarray:
        cast, log = digits(patterns), np.log(self.rate)
        told = ~unsaid(cast)
        each = np.stack([(log[c, np.arange(len(LABELLERS))[None, :], cast] * told).sum(1) for c in range(len(self.share))], axis=1) + np.log(self.share)
        p = np.exp(each - each.max(1, keepdims=True))
        p[~(cast == BAD).any(1), 1:] *= 1e-6  # no kind of bad goes without a vote for bad
        return p / p.sum(1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of good by pattern of votes."""
        return self._by_class(patterns)[:, 0] if len(patterns) else np.zeros(0)

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
        """Expectation maximisation over patterns of votes and how many documents have each.  Class 0
        is good; the others start from labellers that look for one kind of bad document."""
        start = np.empty((1 + len(BAD_KINDS), len(LABELLERS), 3))
        start[0] = (0.01, 0.19, 0.8)
        start[1:] = (0.15, 0.15, 0.7)
        for c, names in enumerate(BAD_KINDS, 1):
            start[c, [LABELLERS.index(n) for n in names]] = (0.8, 0.15, 0.05)
        model = cls(start, np.array([0.85] + [0.15 / len(BAD_KINDS)] * len(BAD_KINDS)))
        if not len(patterns):
            return model
        cast = digits(patterns)
        cast = np.where(unsaid(cast), -1, cast)
        for _ in range(rounds):
            p = model._by_class(patterns) * counts[:, None]
            rate = np.stack([[[p[cast[:, i] == v, c].sum() for v in range(3)] for i in range(len(LABELLERS))] for c in range(len(start))]) + start
            share = p.sum(0) + 0.5
            model = cls(rate / rate.sum(2, keepdims=True), share / share.sum())
        return model


def features(text: bytes | None, size: int) -> np.ndarray:
    """Hashed counts of three-byte class patterns and of word repeats, as shares."""
    text = text or b""
    if 0 < len(text) < 3:
        text = b" " + text + b" "
    out = np.zeros(size, np.float32)
    if len(text) >= 3:
        c = np.frombuffer(text.translate(CLASSES), np.uint8).astype(np.int64)
        code = (c[:-2] * WIDTH + c[1:-1]) * WIDTH + c[2:]
        out += np.bincount(code * 0x9E3779B1 % (1 << 32) * size >> 32, minlength=size) / len(code)
    words = text.split()
    if len(words) > 1:
        out[0x51 % size] += sum(map(bytes.__eq__, words, words[1:])) / len(words)
        out[0xA3 % size] += 1 - len(set(words)) / len(words)
    return np.sqrt(out)


class Scorer:
    """A logistic score of hashed features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Scorer:
        """Adam on the cross entropy with posterior labels y; both classes get the same weight."""
        w, b = np.zeros(x.shape[1]), 0.0
        weight = y / max(1e-9, y.sum()) + (1 - y) / max(1e-9, (1 - y).sum())
        weight *= len(y) / weight.sum()
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            e = (p - y) * weight / len(y)
            g = np.append(x.T @ e + decay * w, e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            w, b = w - move[:-1], b - move[-1]
        return cls(w, float(b))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _quality(text: bytes | None, scorer: Scorer) -> float:
    """A text's score; one without words counts as good."""
    if not (text or b"").strip():
        return 1.0
    return float(scorer.score(features(text, len(scorer.weights))))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([votes(t.as_py()) for t in batch.column(0)], pa.int32())], ["pattern"])


def _sampled(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(votes(t), features(t, size).tobytes()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["pattern", "x"])

    return run


def _score(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            patterns = np.array([votes(t) for t in texts], np.int64)
            quality = [_quality(t, scorer) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(patterns, pa.int32()), pa.array(model.posterior(patterns)), pa.array(quality)], ["doc_id", "rk", "pattern", "weak_label", "quality"]
            )

    return run


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = 4000, size: int = 1024) -> tuple[Scorer, LabelModel]:
    """The scorer and the label model of a table.

    Votes are counted over all rows: the driver gets at most 3 to the number of labellers patterns.
    The scorer is fitted on at most ``train_rows`` different texts, chosen by their hash, with their
    posterior labels.
    """
    source = docs.select(F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("h"))
    seen = source.select("text").mapInArrow(_vote, "pattern int").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    model = LabelModel.fit(np.array([r.pattern for r in seen], np.int64), np.array([r.n for r in seen], float))
    chosen = sample_by_hash(source, train_rows).select("text").repartition(4)
    sample = chosen.mapInArrow(_sampled(size), "pattern int, x binary").collect()
    if not sample:
        return Scorer(np.zeros(size), 0.0), model
    x = np.stack([np.frombuffer(r.x, np.float32) for r in sample]).astype(float)
    return Scorer.fit(x, model.posterior(np.array([r.pattern for r in sample], np.int64))), model


def classify(docs: DataFrame, fitted: tuple[Scorer, LabelModel] | None = None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 4000) -> DataFrame:
    """One row per document: doc_id, rk, quality (0 to 1), keep, weak_label, votes.

    Overlapping heuristic labellers vote bad, good or nothing on each whole text; expectation
    maximisation estimates how reliable each is from the votes of all documents; the posterior labels
    train a linear scorer on hashed features, whose score decides.  No given label is used.

    Every text with a word is scored, however short; on fewer than 8 words only labellers that need no
    more vote, and only bad.  A text without words, null and empty ones too, has score 1 and stays.
    Ids may repeat or be null.  An empty table gives an empty result.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted or fit(docs, text_col, train_rows))
    source = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).cast("binary").alias("text"))
    scored = source.mapInArrow(_score(shared), f"doc_id {docs.schema[id_col].dataType.simpleString()}, rk long, pattern int, weak_label double, quality double")
    return scored.select("doc_id", "rk", "quality", (F.col("quality") >= threshold).alias("keep"), "weak_label", F.conv(F.col("pattern").cast("string"), 10, 3).alias("votes"))


def _keep(shared, threshold: float, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, _ = shared.value
        for batch in batches:
            good = [_quality((t.as_py() or "").encode(), scorer) >= threshold for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def keep_good(docs: DataFrame, threshold: float = 0.3, text_col: str = "text", train_rows: int = 4000) -> DataFrame:
    """The rows of docs that classify keeps, columns unchanged and in place: nothing is shuffled.

    A null or blank text stays.  Repeated rows are judged alike, an empty table stays empty, and no
    column is added or renamed on the way, so none can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, train_rows))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever signs are in the names
    return plain.mapInArrow(_keep(shared, threshold, docs.columns.index(text_col)), plain.schema).toDF(*docs.columns)
