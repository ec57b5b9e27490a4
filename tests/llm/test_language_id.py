import math
import random

import numpy as np
from codeloom.llm.language_id import ByteNetwork, predict, train
from llm_cases import ODD_TEXTS
from pyspark.sql import functions as F

SOUNDS = {"aa": ["tion", "the", "ing", "wh"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["eau", "oi", "é", "ç"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows(n, seed=1):
    rng = random.Random(seed)
    langs = sorted(SOUNDS)
    return [(i, text(rng, langs[i % 3], rng.choice((3, 40, 300))), langs[i % 3], "s", 0) for i in range(n)]


def test_gradients_are_right():
    network = ByteNetwork(["a", "b"], window=12, filters=3, size=2)
    network.weights = {k: v.astype(float) for k, v in network.weights.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 100, (5, 12)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    loss = lambda: -np.log(network.probabilities(x, network.tables())[np.arange(5), y]).mean()
    grads = network._gradients(x, y)
    for k, v in network.weights.items():
        flat = v.reshape(-1)
        for i in rng.choice(len(flat), min(len(flat), 30), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - grads[k].reshape(-1)[i]) < 1e-4


def test_held_out_accuracy(table):
    docs = table(rows(600))
    network = train(docs, F.col("doc_id") >= 200)
    got = {r.doc_id: r for r in predict(docs, network).collect()}
    right = sum(got[i].lang_pred == lang for i, _, lang, _, _ in rows(600) if i < 200)
    assert right >= 190
    assert all(0 <= r.score <= 1 for r in got.values())


def test_long_text_is_read_to_its_end(table):
    rng = random.Random(3)
    network = train(table(rows(300)), F.lit(True))
    mixed = text(rng, "aa", 200) + " " + text(rng, "cc", 5000)
    assert predict(table([(1, mixed)]), network).first().lang_pred == "cc"


def test_odd_texts_and_no_training_rows(table):
    odd = table([(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "123 !?"), (1, "a")])
    network = train(table(rows(60)), F.lit(True))
    got = predict(odd, network).collect()
    assert len(got) == len(ODD_TEXTS) + 2
    assert sum(r.lang_pred == "und" and r.score == 0 for r in got) == 5
    assert train(odd, F.lit(True)) is None
    assert {r.lang_pred for r in predict(odd, None).collect()} == {"und"}
    assert predict(table([]), network).count() == 0


def plain_prediction(network, text):
    """The convolution position by position, and the average over windows, in loops."""
    w8 = {k: v.astype(float) for k, v in network.weights.items()}
    seen = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in text.encode())
    total, letters = [0.0] * len(network.labels), 0.0
    for at in range(0, len(seen), network.window):
        window = seen[at : at + network.window].ljust(network.window)
        pooled = []
        for w in network.widths:
            for f in range(network.filters):
                best = -math.inf
                for i in range(len(window) - w + 1):
                    patch = np.concatenate([w8["bytes"][b] for b in window[i : i + w]])
                    best = max(best, float(patch @ w8[f"filter{w}"][:, f]) + float(w8[f"bias{w}"][f]))
                pooled.append(max(0.0, best))
        z = [sum(p * w8["out"][i, k] for i, p in enumerate(pooled)) + w8["out_bias"][k] for k in range(len(network.labels))]
        e = [math.exp(v - max(z)) for v in z]
        weight = sum(b != 32 for b in window) + 1e-3
        total = [t + weight * v / sum(e) for t, v in zip(total, e, strict=True)]
        letters += weight
    best = max(range(len(total)), key=total.__getitem__)
    return network.labels[best], total[best] / letters


def test_equals_a_plain_computation(table):
    rng = random.Random(9)
    texts = [text(rng, lang, n) for lang in sorted(SOUNDS) for n in (1, 5, 30)] + ["A É\n7 b", "\u4e2d\u6587", "x" * 300]
    network = train(table(rows(90)), F.lit(True), window=64)
    got = {r.doc_id: r for r in predict(table(list(enumerate(texts))), network).collect()}
    for i, t in enumerate(texts):
        label, score = plain_prediction(network, t)
        assert got[i].lang_pred == label and abs(got[i].score - score) < 1e-4
