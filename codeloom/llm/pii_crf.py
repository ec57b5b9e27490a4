"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import row_key, sample_by_hash

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, as the contract states them.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Tried at the start of a run of digits only, where alone it can begin; elsewhere a long run would cost its square.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORTH = re.compile(r"[0-9@]")
#: What the random field may label besides: number groups of 7 digits or more, words around an @, and long words of
#: letters and digits.
NUMBER = re.compile(r"\(?[0-9](?:[\x20().\-/]{0,2}[0-9])+")
GROUP = re.compile(r"[0-9]+")
WORD = re.compile(r"[^\s<>()\[\],;:\"']+")
LONG_WORD = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
#: A credential is known by the name before it; no kind of the base patterns, and reported apart from them.
ASSIGNED = re.compile(r"[:=][\x20\t]{0,3}[\"']?([A-Za-z0-9+/_-]{16,}+)")
SECRET_NAME = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[\x20\t]{0,3}$")
NOT_DIGIT = re.compile(r"[^0-9]")
#: Labels of the field: none, the base kinds, secret.
LABELS = 2 + len(KINDS)
#: Kinds of links: tokens that repeat, that resemble each other, that follow each other; and the strengths that fitting starts from.
REPEATED, SIMILAR, NEIGHBOUR = 0, 1, 2
STRENGTHS = (3.0, 1.0, 0.1)
ROUNDS, SETTLED, NEAR = 500, 1e-3, 40


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """EMAIL's matches.  It is tried only from the start of a run that reaches an @, since it fails
    everywhere else and would take the square of a long word's length to do so."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            out.append(found.span())
            done = found.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches that hold, by kind and then start."""
    if not WORTH.search(text):
        return []
    out = [(0, *span) for span in _emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        number = NOT_DIGIT.sub("", m.group())
        if 16 <= len(number) <= 19 and luhn(number):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _around_at(text: str) -> Iterator[tuple[int, int]]:
    """Words with an @ inside."""
    for m in WORD.finditer(text) if "@" in text else ():
        word = m.group().rstrip(".!?")
        at = word.find("@")
        if 0 < at < len(word) - 1:
            yield m.start(), m.start() + len(word)


def _cards_in(part: str) -> list[tuple[int, int]]:
    """Of a run of digit groups too long for a number: neighbouring groups that make up 16 to 19 digits
    and pass Luhn, the first ones first, none twice."""
    groups = [m.span() for m in GROUP.finditer(part)]
    digits = np.frombuffer(NOT_DIGIT.sub("", part).encode(), np.uint8).astype(np.int64) - 48
    ends = np.cumsum([e - s for s, e in groups])
    firsts = ends - [e - s for s, e in groups]
    doubled = digits * 2 - 9 * (digits > 4)
    even = np.arange(len(digits)) % 2 == 0
    sums = [np.concatenate(([0], np.cumsum(np.where(even == (p == 0), digits, doubled)))) for p in (0, 1)]
    last = np.searchsorted(ends, firsts + 16)
    last = np.minimum(last, len(ends) - 1)
    total = ends[last] - firsts
    parity = (ends[last] - 1) % 2
    check = np.where(parity == 0, sums[0][ends[last]] - sums[0][firsts], sums[1][ends[last]] - sums[1][firsts])
    out, free = [], 0
    for i in np.flatnonzero((total >= 16) & (total <= 19) & (check % 10 == 0)):
        if i >= free:
            out.append((groups[i][0], groups[last[i]][1]))
            free = last[i] + 1
    return out


class _Taken:
    """Spans that are spoken for."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.reach = np.maximum.accumulate([e for _, e in spans]).tolist() if spans else []

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i < 0 or self.reach[i] <= start


def named_secrets(text: str) -> list[tuple[int, int]]:
    return [m.span(1) for m in ASSIGNED.finditer(text) if SECRET_NAME.search(text, max(0, m.start() - 20), m.start())]


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(label, start, end): base matches and named secrets with their labels, candidates beside them
    with 0."""
    out = [(k + 1, s, e) for k, s, e in base]
    taken = _Taken([(s, e) for _, s, e in out])
    out += [(LABELS - 1, *span) for span in named_secrets(text) if taken.free(*span)]
    taken = _Taken([(s, e) for _, s, e in out])
    words = [span for span in _around_at(text) if taken.free(*span)]
    for m in LONG_WORD.finditer(text):
        if not m.group().isdigit() and not m.group().isalpha() and any(map(str.isdigit, m.group())) and taken.free(*m.span()):
            words.append(m.span())
    out += [(0, s, e) for s, e in words]
    taken = _Taken([(s, e) for _, s, e in out])
    for m in NUMBER.finditer(text):
        count = len(NOT_DIGIT.sub("", m.group()))
        parts = [(m.start() + s, m.start() + e) for s, e in _cards_in(m.group())] if count > 19 else []
        out += [(0, *span) for span in parts or [m.span()] if count >= 7 and taken.free(*span)]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


#: Features by which the patterns know their kinds; fitting hides them at times.
PATTERN = frozenset((2, 8, 9, 13, 17))
SHAPES = 1 << 2 | 1 << 8 | 1 << 13
FEATURES = 19


def features(text: str, start: int, end: int) -> int:
    """Of a token's shape and surroundings, as bits."""
    part = text[start:end]
    number = NOT_DIGIT.sub("", part)
    n = len(number)
    before, after = text[start - 1 : start], text[end : end + 1]
    dots = part.count(".")
    seen = (
        True,
        "@" in part,
        "@" in part and "." in part.rpartition("@")[2],
        7 <= n <= 9,
        10 <= n <= 12,
        13 <= n <= 15,
        16 <= n <= 19,
        n > 19,
        16 <= n <= 19 and luhn(number),
        part[:1] == "+" or before == "+",
        "(" in part,
        "-" in part or " " in part,
        dots == 3,
        dots == 3 and all(len(p) <= 3 for p in part.split(".")),
        before.isalnum() or after.isalnum(),
        n == len(part),
        len(part) >= 20 and n < len(part) and "@" not in part,
        bool(re.search(r"[:=][\x20\t]{0,3}[\"']?$", text[max(0, start - 5) : start])),
        before in ("'", '"') and before == after,
    )
    return sum(1 << i for i, x in enumerate(seen) if x)


def _unpacked(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(FEATURES) & 1).astype(float)


def edges(text: str, nodes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(node, node, kind of link): a repeated token with its first and its last occurrence, one that
    resembles it (same last 7 digits, same name before an @) likewise, and neighbours."""
    out = {(i, i + 1): NEIGHBOUR for i in range(len(nodes) - 1) if nodes[i + 1][1] - nodes[i][2] <= NEAR}
    first: dict[tuple, int] = {}
    last: dict[tuple, int] = {}
    for i, (_, s, e) in enumerate(nodes):
        part = text[s:e]
        number = NOT_DIGIT.sub("", part)
        if "@" in part:
            keys = [(("same", part.lower()), REPEATED), (("name", part.partition("@")[0].lower()), SIMILAR)]
        elif len(part) >= 20 and len(number) < len(part) // 2 + 10 and not part[:1] in "+(":
            keys = [(("word", part), REPEATED)]
        else:
            keys = [(("digits", number), REPEATED), (("tail", number[-7:]), SIMILAR)]
        for key, kind in keys:
            for at in (first.get(key), last.get(key)):
                if at is not None:
                    out[at, i] = min(kind, out.get((at, i), NEIGHBOUR))
            first.setdefault(key, i)
            last[key] = i
    return [(i, j, kind) for (i, j), kind in out.items()]


@dataclass
class Field:
    """Weights of the unary potentials, (features, labels), and of the links by kind; label 0 is none."""

    weights: np.ndarray
    strengths: np.ndarray

    @classmethod
    def fit(cls, masks: np.ndarray, links: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Field:
        """Maximum pseudo-likelihood by Adam: each token's label given its features and its neighbours'
        labels, unary and link weights together.

        A row stands for n equal tokens; links has a bit for each kind of link and neighbour's label.
        Each row counts a second time with the patterns' own features hidden: there the neighbours have
        to tell, which is what the field is asked later.  All labels weigh the same.
        """
        hidden = masks & ~sum(1 << f for f in PATTERN)
        x = np.concatenate((_unpacked(masks), _unpacked(hidden)))
        near = (links[:, None] >> np.arange(3 * LABELS) & 1).reshape(-1, 3, LABELS).astype(float)
        near, target = np.concatenate((near, near)), np.eye(LABELS)[np.concatenate((y, y))]
        weight = np.concatenate((n, n)).astype(float)[:, None] * target
        weight = (weight / np.maximum(weight.sum(0), 1e-9)).sum(1) / 2
        w, g = np.zeros((FEATURES, LABELS)), np.array(STRENGTHS)
        held = [np.zeros_like(a) for a in (w, g, w, g)]
        for t in range(1, steps + 1):
            z = x @ w + (near * g[None, :, None]).sum(1)
            p = np.exp(z - z.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - target) * weight[:, None]
            slopes = (x.T @ error + decay * w, (near * error[:, None, :]).sum((0, 2)) + decay * (g - STRENGTHS))
            for i, slope in enumerate(slopes):
                held[i] = 0.9 * held[i] + 0.1 * slope
                held[i + 2] = 0.999 * held[i + 2] + 0.001 * slope * slope
            moves = [rate * (held[i] / (1 - 0.9**t)) / (np.sqrt(held[i + 2] / (1 - 0.999**t)) + 1e-9) for i in (0, 1)]
            w, g = w - moves[0], np.maximum(0.0, g - moves[1])
        return cls(w, g)


def label_nodes(text: str, nodes: list[tuple[int, int, int]], field: Field) -> np.ndarray:
    """Marginals of the nodes' labels by loopy message passing until messages settle; base matches and
    named secrets are observed."""
    unary = _unpacked(np.array([features(text, s, e) for _, s, e in nodes])) @ field.weights
    given = np.array([label for label, _, _ in nodes])
    unary[given > 0] = np.where(np.arange(LABELS) == given[given > 0][:, None], 0.0, -30.0)
    unary -= unary.max(1, keepdims=True)
    links = edges(text, nodes)
    if not links:
        belief = np.exp(unary)
        return belief / belief.sum(1, keepdims=True)
    a, b, kind = (np.array(x) for x in zip(*links, strict=True))
    gain = np.exp(field.strengths[kind])
    source, target, gain = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((gain, gain))
    back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
    messages = np.full((len(source), LABELS), -np.log(LABELS))
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, target, messages)
        out = total[source] - messages[back]
        out = np.exp(out - out.max(1, keepdims=True))
        out = out.sum(1, keepdims=True) + (gain[:, None] - 1) * out  # exp(strength) where labels agree, else 1
        new = 0.5 * messages + 0.5 * np.log(out / out.sum(1, keepdims=True))
        moved = float(np.abs(new - messages).max())
        messages = new
        if moved < SETTLED:
            break
    belief = unary.copy()
    np.add.at(belief, target, messages)
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


Spans = list[tuple[int, int, int]]


def find_spans(text: str, field: Field | None, least: float = 0.5) -> tuple[Spans, Spans, Spans]:
    """A text's base spans, all spans with those the field adds, and secrets."""
    base = base_spans(text)
    if not WORTH.search(text):
        return base, base, []
    nodes = tokens(text, base)
    labels = [label for label, _, _ in nodes]
    if field is not None and not all(labels):
        marginals = label_nodes(text, nodes, field)
        labels = [label or (int(p.argmax()) if p.max() >= least else 0) for label, p in zip(labels, marginals, strict=True)]
    known = {(s, e) for _, s, e in base}
    found = [(label - 1, s, e) for label, (_, s, e) in zip(labels, nodes, strict=True) if label]
    added = [x for x in found if x[0] < len(KINDS) and x[1:] not in known]
    return base, sorted(base + added), [x for x in found if x[0] == len(KINDS)]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, features, links) of tokens.  A token without a label is left out if a link of the first
    two kinds ties it to one with a label, or if it looks like a kind the patterns know (passes Luhn,
    say): what it is, is what the field shall find."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            nodes = tokens(text, base_spans(text))
            seen, unsure = [0] * len(nodes), set()
            for i, j, kind in edges(text, nodes):
                if kind != NEIGHBOUR and (not nodes[i][0]) != (not nodes[j][0]):
                    unsure.add(j if nodes[i][0] else i)
                    continue
                seen[i] |= 1 << kind * LABELS + nodes[j][0]
                seen[j] |= 1 << kind * LABELS + nodes[i][0]
            marked = [(label, features(text, s, e), seen[i]) for i, (label, s, e) in enumerate(nodes) if i not in unsure]
            rows += [r for r in marked if r[0] or not r[1] & SHAPES]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(3)], ["y", "x", "links"])


def train(docs: DataFrame, text_col: str = "text", most_docs: int = 4000) -> Field | None:
    """Fits the field on at most ``most_docs`` texts with a digit or @, chosen by their hash.  Labels are
    the base patterns' and named secrets; no given label is used.  The driver gets counts of different
    rows of bits.  None if there are no tokens."""
    rows = docs.filter(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    chosen = sample_by_hash(rows, most_docs).select("text")
    seen = chosen.mapInArrow(_examples, "y int, x int, links int").groupBy("y", "x", "links").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "x", "links").collect()
    if not seen:
        return None
    return Field.fit(*(np.array([r[i] for r in seen], np.int64) for i in (1, 2, 0, 3)))


def _mark(shared) -> Callable:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = (*KINDS, "secret")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            found = [find_spans(t.as_py() or "", field) for t in batch.column(2)]
            lists = [pa.array([[{"kind": names[k], "start": s, "end": e} for k, s, e in f[i]] for f in found], span) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["rk", "doc_id", "base", "spans", "secrets"])

    return run


def find_pii(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: rk, doc_id, base, spans and secrets, arrays of (kind, start, end) by kind
    and start.

    Offsets are code points, end exclusive.  ``base`` are the fixed patterns' matches.  ``spans`` adds
    tokens that the patterns miss but the field labels: numbers, groups of digits within longer runs,
    and words around an @ whose shape, and the labels of repeated or similar tokens anywhere in the
    document, speak for a kind.  ``secrets`` are credentials: long words behind a name such as
    ``token =``, and such words elsewhere in the document if the field labels them so.
    Nothing is shuffled.  A token has four links at most to earlier ones; time goes with the text's length.

    Null counts as empty.  Ids may repeat or be null.  An empty table gives an empty result.  Other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs, text_col))
    source = docs.select(row_key(id_col, text_col).alias("rk"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    return source.mapInArrow(_mark(shared), f"rk long, doc_id {docs.schema[id_col].dataType.simpleString()}, base {spans}, spans {spans}, secrets {spans}")
