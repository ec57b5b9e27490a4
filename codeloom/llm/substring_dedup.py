"""Substring dedup: suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import materialize, quoted, row_key
from codeloom.llm._repeats import SHARD_WORDS, remove_repeats


class SuffixAutomaton:
    """Of the word sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, arcs: dict[bytes, int], link: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, at: int, word: bytes) -> int:
        """The state that ``at`` reaches by word, cut so that its longest sequence ends there."""
        target = self.next[at][word]
        if self.length[target] == self.length[at] + 1:
            return target
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[bytes]) -> None:
        at = 0
        for word in words:
            if word in self.next[at]:
                at = self._split(at, word)
                continue
            new = self._state(self.length[at] + 1, {}, 0)
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, word)
            at = new

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each place, the length of the longest sequence that ends there and has been added."""
        out, at, n = [], 0, 0
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if word in self.next[at]:
                at = self.next[at][word]
                n += 1
            out.append(n)
        return out


def match_automaton(texts: list[list[bytes]], anchors: list[int], windows: list[int], window: int) -> list[np.ndarray]:
    """Streams each stretch through the automaton of those before it in the shard, then adds it: its
    matching statistics tell which of its windows start earlier."""
    automaton, flags = SuffixAutomaton(), []
    for words, count in zip(texts, windows, strict=True):
        reached = automaton.statistics(words)
        flags.append(np.array(reached[window - 1 : window - 1 + count]) >= window)
        automaton.add(words)
    return flags


def substring_dedup(docs: DataFrame, window: int = 20, k: int = 6, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, hot: int = 2048) -> DataFrame:
    """One row per document: rk, doc_id, n_words, n_removed, spans, kept_text.

    Removes each word covered by ``window`` consecutive words whose sequence also starts earlier
    (smaller id, or same document and earlier start), judged on the input.

    The reference is the corpus itself.  What of it can match anything, by the hash of a selected
    position's k words, is dealt to shards of about ``shard_words`` words, and each shard's automaton
    is built in a task; documents are streamed, in the stretches that can match, through the automata
    of the shards that those stretches belong to.  Equal stretches are one before that, and the first
    keeps what the automaton finds new.  Since the reference grows with the corpus it isn't broadcast;
    remove_reference does so, where the reference is a table apart.

    Null and blank texts have no words.  A null id counts as smaller than any other; rows that agree in
    id and text are one document and get one result each.  An empty table gives an empty result.
    Other columns are not read, whatever their names.
    """
    return remove_repeats(docs, window, k, match_automaton, id_col, text_col, hot, shard_words)


def _stream(shared, window: int):
    types = (pa.int64(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        for batch in batches:
            rows = []
            for rk, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                for automaton in automata:
                    rows += [(rk, i) for i, n in enumerate(automaton.statistics(words)) if n >= window]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["rk", "last"])

    return run


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lasts in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                edge = np.zeros(len(words) + 1, np.int64)
                for last in lasts or []:
                    edge[last - window + 1] += 1
                    edge[last + 1] -= 1
                cut = np.cumsum(edge)[: len(words)] > 0
                out.append((len(words), int(cut.sum()), b" ".join(w for w, c in zip(words, cut.tolist(), strict=True) if not c)))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["rk", "doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text", round_words: int = 200_000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: rk, doc_id, n_words, n_removed, kept_text, without the words covered by
    ``window`` consecutive words that occur in a text of ``reference``, such as a benchmark.

    Reference texts are split among rounds of about ``round_words`` words by hash; a round's texts go
    to the driver, are made into automata of ``shard_words`` words each and broadcast, and all
    documents are streamed through them for matching statistics.  So what is broadcast has a bound
    (about 600 bytes a word) but for a longer single text, and a larger reference takes more rounds.

    Null texts have no words; rows that agree in id and text get one result each; either table may be
    empty.  Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    source = docs.select(row_key(quoted(id_col), quoted(text_col)).alias("rk"), F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("binary").alias("text"))
    texts = reference.select(F.col(quoted(reference_col)).alias("text")).filter("text is not null").distinct()
    total = texts.agg(F.coalesce(F.sum(F.size(F.split("text", "[\t-\r ]+"))), F.lit(0))).first()[0]
    rounds = max(1, -(-total // round_words))
    hits = None
    for at in range(rounds):
        automata, room = [], 0
        for row in texts.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == at).collect():
            words = row.text.encode().split()
            if len(words) < window:
                continue
            if room < len(words):
                automata.append(SuffixAutomaton())
                room = shard_words
            automata[-1].add(words)
            room -= len(words)
        found = source.select("rk", "text").mapInArrow(_stream(spark.sparkContext.broadcast(automata), window), "rk long, last int")
        found = materialize(found.distinct(), "reference-hits")
        hits = found if hits is None else hits.unionByName(found)
    by_row = hits.groupBy("rk").agg(F.collect_set("last").alias("lasts"))
    out = source.join(by_row, "rk", "left").mapInArrow(_strip(window), f"rk long, doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept binary")
    return out.select("rk", "doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
