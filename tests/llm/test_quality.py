import math
import random

import numpy as np
from codeloom.llm.quality import ABSTAIN, ANY_LENGTH, BAD, BAD_KINDS, BOUNDS, CLASSES, FEW, GOOD, LABELLERS, WIDTH, LabelModel, classify, digits, fit, keep_good, shares, votes
from llm_cases import ODD_TEXTS


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "an", "ti", "er", "on", "wh"]) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.choice((12, 60, 200)))]
        bad = i % 6 == 0
        if bad:
            kind = i // 6 % 4
            words = [[w + "***" for w in words], [w.upper() + "!!" for w in words], [w + " |" for w in words], [words[0]] * len(words)][kind]
        text = ""
        for k, w in enumerate(words):
            text += w + (". " if k % 9 == 8 else " ")
        out.append((i, text, bad))
    return out


def test_agrees_with_the_truth_on_held_out_rows(table):
    rows = corpus()
    got = {r.doc_id: r for r in classify(table([r[:2] for r in rows])).collect()}
    wrong = sum(got[i].keep == bad for i, _, bad in rows)
    assert wrong <= 4
    assert all(0 <= r.quality <= 1 for r in got.values())
    kept = keep_good(table([r[:2] for r in rows]))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.85
    cast = np.where(rng.random((20000, len(LABELLERS))) < np.where(truth, 0.02, 0.5)[:, None], 0, 2)
    patterns, counts = np.unique((cast * 3 ** np.arange(len(LABELLERS))).sum(1), return_counts=True)
    model = LabelModel.fit(patterns, counts.astype(float))
    assert abs(model.share[0] - 0.85) < 0.02
    assert np.allclose(model.rate[0, :, 0], 0.02, atol=0.01)
    assert abs(((model.posterior((cast * 3 ** np.arange(len(LABELLERS))).sum(1)) > 0.5) == truth).mean() - 1) < 0.02


def test_few_words_are_not_judged():
    assert set(digits(np.array([votes(b"a b c")]))[0].tolist()) == {ABSTAIN}


def test_short_texts_are_judged(table):
    rows = [r[:2] for r in corpus()]
    bad = ["That*** atly.###", "Onesnt | theaeati | onanshat |", "$*&#" * 3000, "ON THE WHAN!!"]
    good = ["That on the whan.", "Anti onwh the.", "Thewh er on"]
    short = [(1000 + k, t) for k, t in enumerate(bad + good)]
    got = {r.doc_id: r for r in classify(table(rows + short)).collect()}
    assert [got[i].keep for i, _ in short] == [False] * len(bad) + [True] * len(good)
    assert all(got[i].weak_label > 0.9 for i, _ in short[len(bad) :])
    kept = {r.doc_id for r in keep_good(table(rows + short)).collect()}
    assert kept == {i for i, r in got.items() if r.keep}


def test_odd_texts_and_empty(table):
    odd = table([(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "a"), (1, "a"), (1, "a")])
    assert classify(odd).count() == len(ODD_TEXTS) + 3
    assert classify(table([])).count() == 0
    assert keep_good(table([])).count() == 0


def plain_votes(text):
    """A document's votes, labeller by labeller."""
    words = text.split()
    out = [ABSTAIN] * len(LABELLERS)
    for i, name in enumerate(LABELLERS if words else ()):
        low, high = BOUNDS[name]
        x = shares(text, words)[i]
        if len(words) >= FEW:
            out[i] = BAD if x >= high else GOOD if x <= low else ABSTAIN
        elif name in ANY_LENGTH and x >= high:
            out[i] = BAD
    return out


def plain_em(documents, rounds):
    """Expectation maximisation document by document, with dictionaries and loops."""
    kinds = range(1 + len(BAD_KINDS))
    start = {}
    for c in kinds:
        for i, name in enumerate(LABELLERS):
            looks = c and name in BAD_KINDS[c - 1]
            start[c, i] = (0.01, 0.19, 0.8) if not c else (0.8, 0.15, 0.05) if looks else (0.15, 0.15, 0.7)
    rate, share = dict(start), [0.85] + [0.15 / len(BAD_KINDS)] * len(BAD_KINDS)

    def expected(cast):
        asked = [v != ABSTAIN or GOOD in cast for v in cast]
        p = [share[c] * math.prod(rate[c, i][v] for i, v in enumerate(cast) if asked[i]) for c in kinds]
        if BAD not in cast:
            p = [p[0], *(x * 1e-6 for x in p[1:])]
        return asked, [x / sum(p) for x in p]

    for _ in range(rounds):
        seen = {key: list(v) for key, v in start.items()}
        total = [0.5] * len(share)
        for cast in documents:
            asked, p = expected(cast)
            for c in kinds:
                total[c] += p[c]
                for i, v in enumerate(cast):
                    if asked[i]:
                        seen[c, i][v] += p[c]
        rate = {key: [x / sum(v) for x in v] for key, v in seen.items()}
        share = [x / sum(total) for x in total]
    return [expected(cast)[1][0] for cast in documents]


def plain_score(text, scorer):
    """The linear score from counts of three-byte patterns, one by one."""
    size = len(scorer.weights)
    x = [0.0] * size
    for a, b, c in zip(text, text[1:], text[2:]):
        code = (CLASSES[a] * WIDTH + CLASSES[b]) * WIDTH + CLASSES[c]
        x[code * 0x9E3779B1 % 2**32 * size // 2**32] += 1 / (len(text) - 2)
    words = text.split()
    if len(words) > 1:
        x[0x51] += sum(a == b for a, b in zip(words, words[1:])) / len(words)
        x[0xA3] += 1 - len(set(words)) / len(words)
    return 1 / (1 + math.exp(-sum(math.sqrt(v) * w for v, w in zip(x, scorer.weights, strict=True)) - scorer.bias))


def test_equals_a_plain_computation(table):
    rows = [r[:2] for r in corpus(150, seed=5)] + [(900, "That*** atly.###"), (901, "a plain line"), (902, "ON | THE | WHAN")]
    docs = table(rows + rows[:20])
    fitted = fit(docs)
    casts = {i: plain_votes(t.encode()) for i, t in rows}
    weak = dict(zip(casts, plain_em([*casts.values(), *list(casts.values())[:20]], 50)))
    scored = {i: plain_score(t.encode(), fitted[0]) for i, t in rows}
    got = classify(docs, fitted).collect()
    assert len(got) == len(rows) + 20
    for r in got:
        assert abs(r.weak_label - weak[r.doc_id]) < 1e-6
        assert abs(r.quality - scored[r.doc_id]) < 1e-4 and r.keep == (r.quality >= 0.3)
