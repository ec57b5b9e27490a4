"""Language identification by a small byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import row_key, sample_by_hash

UNKNOWN = "und"
ASCII_LETTER = re.compile(r"[A-Za-z]")
#: Bytes as the network sees them: A-Z lower-cased, other signs below 0x80 as a space, the rest as they are.
SEEN = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character's Unicode category is L: signs such as a superscript 2 are no letters."""
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text))


@dataclass
class ByteNetwork:
    """Embeds bytes, filters of several widths, the maximum over a window, and a softmax."""

    labels: list[str]
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    size: int = 8
    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            self.weights["bytes"] = rng.normal(0, 0.5, (256, self.size)).astype(np.float32)
            for w in self.widths:
                self.weights[f"filter{w}"] = rng.normal(0, (w * self.size) ** -0.5, (w * self.size, self.filters)).astype(np.float32)
                self.weights[f"bias{w}"] = np.zeros(self.filters, np.float32)
            n = self.filters * len(self.widths)
            self.weights["out"] = rng.normal(0, n**-0.5, (n, len(self.labels))).astype(np.float32)
            self.weights["out_bias"] = np.zeros(len(self.labels), np.float32)

    def windows(self, text: bytes) -> np.ndarray:
        """A whole text as rows of ``window`` bytes, the last filled up with spaces."""
        seen = text.translate(SEEN)
        rows = max(1, -(-len(seen) // self.window))
        return np.frombuffer(seen.ljust(rows * self.window), np.uint8).reshape(rows, self.window)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.weights["out"] + self.weights["out_bias"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01) -> ByteNetwork:
        """Adam on the cross entropy of windows x with label numbers y."""
        rng = np.random.default_rng(self.seed)
        means = {k: np.zeros_like(v) for k, v in self.weights.items()}
        squares = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                step += 1
                for k, g in self._gradients(x[rows], y[rows]).items():
                    means[k] = 0.9 * means[k] + 0.1 * g
                    squares[k] = 0.999 * squares[k] + 0.001 * g * g
                    self.weights[k] -= rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w8, n = self.weights, len(x)
        embedded = w8["bytes"][x]
        pooled, kept = [], []
        for w in self.widths:
            spans = self.window - w + 1
            patches = np.concatenate([embedded[:, j : j + spans] for j in range(w)], axis=2)
            out = patches @ w8[f"filter{w}"] + w8[f"bias{w}"]
            at = out.argmax(1)
            kept.append((patches, at))
            pooled.append(np.take_along_axis(out, at[:, None], 1)[:, 0])
        flat = np.concatenate(pooled, 1)
        error = self._softmax(flat)
        error[np.arange(n), y] -= 1
        error /= n
        grads = {"out": np.maximum(flat, 0).T @ error, "out_bias": error.sum(0)}
        back = (error @ w8["out"].T) * (flat > 0)
        grads["bytes"] = np.zeros_like(w8["bytes"])
        rows = np.arange(n)[:, None]
        for i, w in enumerate(self.widths):
            patches, at = kept[i]
            part = back[:, i * self.filters : (i + 1) * self.filters]
            chosen = patches[rows, at]  # (n, filters, w * size)
            grads[f"filter{w}"] = np.einsum("nfd,nf->df", chosen, part)
            grads[f"bias{w}"] = part.sum(0)
            to_bytes = part[:, :, None] * w8[f"filter{w}"].T[None]
            for j in range(w):
                np.add.at(grads["bytes"], x[rows, at + j], to_bytes[:, :, j * self.size : (j + 1) * self.size])
        return grads

    def tables(self) -> list[tuple[int, list[tuple[int, np.ndarray]], np.ndarray]]:
        """The filters as sums of looked-up rows: by byte pair, and by byte for an odd last one."""
        out = []
        for w in self.widths:
            single = [self.weights["bytes"] @ self.weights[f"filter{w}"][j * self.size : (j + 1) * self.size] for j in range(w)]
            parts = [(j, (single[j][:, None] + single[j + 1][None]).reshape(65536, -1) if j + 1 < w else single[j]) for j in range(0, w, 2)]
            out.append((w, parts, self.weights[f"bias{w}"]))
        return out

    def probabilities(self, x: np.ndarray, tables: list) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        pooled = []
        for w, parts, bias in tables:
            spans = self.window - w + 1
            total = None
            for j, table in parts:
                rows = np.take(table, (pairs if len(table) > 256 else x)[:, j : j + spans], axis=0)
                total = rows if total is None else np.add(total, rows, out=total)
            pooled.append(total.max(1) + bias)
        return self._softmax(np.concatenate(pooled, 1))


def train(docs: DataFrame, usable: Column, label_col: str = "lang", text_col: str = "text", most_docs: int = 6000, per_doc: int = 2, epochs: int = 4, window: int = 256) -> ByteNetwork | None:
    """Fits on windows at random places of at most ``most_docs`` usable texts with a label.

    The texts are chosen by their hash, which is no favour to any place, source or number of copies.
    The driver gets most_docs * per_doc windows, however large the table.  None if no row is usable.
    """
    labelled = docs.filter(usable & F.col(label_col).isNotNull())
    rows = labelled.filter(F.length(text_col) > 0).select(F.col(label_col).alias("y"), F.col(text_col).alias("t"))
    places = [F.substring(F.col("t"), (F.pmod(F.xxhash64("t", F.lit(i)), F.greatest(F.length("t") - window, F.lit(1))) + 1).cast("int"), F.lit(window)) for i in range(per_doc)]
    sample = sample_by_hash(rows.select(F.xxhash64("t").alias("h"), "y", F.array(*places).alias("parts")), most_docs).collect()
    if not sample:
        return None
    labels = sorted({r.y for r in sample})
    network = ByteNetwork(labels, window)
    x = np.concatenate([network.windows(p.encode())[:1] for r in sample for p in r.parts])
    y = np.array([labels.index(r.y) for r in sample for _ in r.parts])
    return network.fit(x, y, epochs)


#: The filters' tables of the network seen last, by the broadcast's number.
_TABLES: dict[int, list] = {}


def _predict(shared, number: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: ByteNetwork = shared.value
        if number not in _TABLES:
            _TABLES.clear()
            _TABLES[number] = network.tables()
        tables = _TABLES[number]

        def scored(texts: list[str]) -> list[tuple[str, float]]:
            windows = [network.windows(t.encode()) for t in texts]
            x = np.concatenate(windows)
            p = np.concatenate([network.probabilities(x[at : at + 256], tables) for at in range(0, len(x), 256)])
            weight = (x != 32).sum(1) + 1e-3
            starts = np.cumsum([0, *map(len, windows)])[:-1]
            mean = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
            best = mean.argmax(1)
            return [(network.labels[b], min(1.0, float(m[b]))) for b, m in zip(best, mean, strict=True)]

        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            known = [i for i, t in enumerate(texts) if t and has_letter(t)]
            at = 0
            while at < len(known):
                part, size = [], 0
                while at < len(known) and size < 2_000_000:
                    part.append(known[at])
                    size += len(texts[known[at]])
                    at += 1
                for i, got in zip(part, scored([texts[i] for i in part]), strict=True):
                    out[i] = got
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], ["doc_id", "rk", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, network: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, rk, lang_pred, score.

    A whole text is cut into windows; their probabilities are averaged by the letters in them, and
    the likeliest label is given with its probability.  Without a letter, or with null, or without a
    network: ``und`` and 0.  Only the text is looked at.  Ids may repeat or be null; an empty table
    gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("rk"))
    if network is None:
        return source.select("doc_id", "rk", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return source.mapInArrow(_predict(shared, shared._jbroadcast.id()), f"doc_id {docs.schema[id_col].dataType.simpleString()}, rk long, lang_pred string, score double")
