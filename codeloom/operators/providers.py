"""Embedding and chat providers, and the loops that call them.  Nothing here needs a network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class TooLong(Exception):
    """A provider's answer to an input beyond its context."""


def hashed_vectors(texts: list[str], size: int = 64) -> list[list[float]]:
    """The default embedding: terms hashed to signed places, scaled to length one."""
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts, strict=True):
        apart = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", text)).lower()
        for term in re.split(r"[\s_-]+", apart):
            if len(term) > 1:
                h = zlib.crc32(term.encode())
                row[h % size] += 1 if h >> 16 & 1 else -1
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0).tolist()


def embed(texts: list[str], provider: Callable[[list[str]], list[list[float]]], batch: int = 8) -> list[list[float]]:
    """Vectors in order.  A batch that is too long is halved; one text is cut by a quarter, down to 256
    characters and nine times at most."""

    def one(text: str) -> list[float]:
        for _ in range(9):
            try:
                return provider([text])[0]
            except TooLong:
                if len(text) <= 256:
                    raise
                text = text[: max(256, int(len(text) * 0.75))]
        return provider([text])[0]

    def many(part: list[str]) -> list[list[float]]:
        if len(part) == 1:
            return [one(part[0])]
        try:
            return provider(part)
        except TooLong:
            middle = -(-len(part) // 2)
            return many(part[:middle]) + many(part[middle:])

    size = max(5, min(10, batch))
    return [v for at in range(0, len(texts), size) for v in many(texts[at : at + size])]


def embed_rows(rows: DataFrame, key: str = "key", text: str = "text", provider: Callable = hashed_vectors, batch: int = 8) -> DataFrame:
    """(key, v) of each row's text, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b[key], "v": embed(b[text].fillna("").tolist(), provider, batch)})

    return rows.select(key, text).mapInPandas(run, f"key {rows.schema[key].dataType.simpleString()}, v array<float>")


@dataclass
class Agent:
    """Answers a question with tools: rounds of chat, each tool's result cut, then one without tools."""

    chat: Callable[[list[dict], bool], dict]
    tools: dict[str, Callable[..., str]]
    rounds: int = 6
    longest: int = 12000
    messages: list[dict] = field(default_factory=list)

    def ask(self, question: str) -> str:
        self.messages.append({"role": "user", "content": question})
        for _ in range(self.rounds):
            reply = self.chat(self.messages, True)
            self.messages.append({"role": "assistant", **reply})
            if not reply.get("tool_calls"):
                return reply.get("content") or ""
            for call in reply["tool_calls"]:
                self.messages.append({"role": "tool", "tool_call_id": call["id"], "content": self._run(call)[: self.longest]})
        last = self.chat(self.messages, False)
        self.messages.append({"role": "assistant", **last})
        return last.get("content") or ""

    def _run(self, call: dict) -> str:
        tool = self.tools.get(call["name"])
        if tool is None:
            return f"Unknown tool: {call['name']}"
        try:
            return str(tool(**call.get("arguments", {})))
        except Exception as error:  # a tool's failure is an answer to the model
            return f"Error: {error}"
