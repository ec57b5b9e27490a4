import random

import numpy as np
from codeloom.llm.toxicity import WORD, Scores, Toxicity, curve, find_toxic, fit, log_odds, maximal_segments, tail, units
from llm_cases import ODD_TEXTS

SYLLABLES = ["the", "an", "ti", "er", "on", "wh", "lo", "ma"]
BAD = ["vexblot", "grumph", "snarkle"]


def corpus(n=500, seed=1, share=0.15):
    """(doc_id, text, toxic): toxic ones have bad words, or words that begin like "zlug", here and there."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))
    out = []
    for i in range(n):
        toxic = rng.random() < share
        words = [word() for _ in range(rng.choice((12, 60, 300)))]
        if toxic:
            bad = BAD if i % 2 else [f"zlug{word()}" for _ in range(3)]
            for _ in range(max(2, len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(bad).upper() if rng.random() < 0.3 else rng.choice(bad)
        out.append((i, " ".join(words), int(toxic)))
    return out


def labels_of(spark, rows):
    return spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def every_segment(scores):
    """Maximal segments by their definition: of all segments, those that no part beats or equals and
    that lie in no longer one of that kind."""
    n = len(scores)
    total = [0.0]
    for s in scores:
        total.append(total[-1] + s)
    proper = []
    for a in range(n):
        for b in range(a + 1, n + 1):
            inside = [total[d] - total[c] for c in range(a, b) for d in range(c + 1, b + 1) if (c, d) != (a, b)]
            if total[b] - total[a] > 0 and all(x < total[b] - total[a] for x in inside):
                proper.append((a, b))
    return [(a, b) for a, b in proper if not any((c, d) != (a, b) and c <= a and b <= d for c, d in proper)]


def test_segments_against_their_definition():
    rng = random.Random(4)
    for _ in range(150):
        scores = np.array([rng.choice([-3, -2, -1, -0.5, 1.25, 2.125, 4.0625]) + rng.random() / 1000 for _ in range(rng.randrange(12))])
        assert [(a, b) for a, b, _ in maximal_segments(scores)] == every_segment(scores.tolist())


def test_segments_take_linear_time():
    found = maximal_segments(np.tile([1.0, -1.0000001], 300_000))
    assert len(found) == 300_000
    assert maximal_segments(np.zeros(0)) == []


def test_log_odds_and_words_known_by_their_beginning():
    counts = {"zlug": (0, 60), "zlugan ": (0, 5), "the ": (800, 100), "rare ": (0, 1), "zlugno ": (40, 0), "clear ": (300, 2)}
    odds = log_odds(counts, 900, 100)
    assert odds["zlug"] > 3 and odds["clear "] < -0.69
    assert "the " not in odds and "rare " not in odds
    scores = Scores(odds, 0.1)
    assert scores["zlugwhatever"] == odds["zlug"] - 0.1 and scores["zlugno"] < 1.5 and scores["unheard"] == -0.1
    assert units("abcd") == ["abc", "abcd "]


def test_held_out_documents(spark, table):
    rows = corpus(700)
    train, rest = rows[:500], rows[500:]
    model = fit(table([r[:2] for r in train]), labels_of(spark, train))
    got = {r.doc_id: r for r in find_toxic(table([r[:2] for r in rest]), model).collect()}
    wrong = [i for i, _, y in rest if (got[i].score >= 0.5) != bool(y)]
    assert len(wrong) <= 3
    assert all(0 <= r.score <= 1 for r in got.values())
    texts = {i: t for i, t, _ in rest}
    marked = [(i, texts[i][p.start : p.end].lower()) for i, r in got.items() for p in r.passages]
    assert marked and sum(any(b in m for b in [*BAD, "zlug"]) for _, m in marked) >= 0.9 * len(marked)
    assert all(p.expected <= 0.05 for r in got.values() for p in r.passages)


def test_many_near_copies_teach_no_common_words(spark, table):
    rows = corpus(400, seed=2)
    rng = random.Random(7)
    base = [t for _, t, y in rows if y and len(t) > 1500][0].split()
    copies = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(len(words))] = f"own{i}"
        copies.append((10_000 + i, " ".join(words), 1))
    model = fit(table([r[:2] for r in rows + copies]), labels_of(spark, rows + copies))
    clean = [(i, t) for i, t, y in corpus(200, seed=3, share=0.0)]
    assert sum(r.score >= 0.5 for r in find_toxic(table(clean), model).collect()) <= 2


def test_tail_and_curve():
    rng = np.random.default_rng(1)
    rate, often = tail(rng.exponential(1 / 1.5, 20_000), np.full(20_000, 100))
    assert abs(rate - 1.5) < 0.1 and abs(often * 100 - 1) < 0.3
    evidence = np.concatenate([np.zeros(300), np.full(100, 20.0)])
    low, slope = curve(evidence, (evidence > 0).astype(float))
    model = Toxicity(low=low, slope=slope)
    assert model.score(0.0) < 0.1 < 0.9 < model.score(20.0)
    assert tail(np.zeros(3), np.ones(3))[0] == 1.0


def test_odd_texts_labels_of_one_kind_and_empty_tables(spark, table):
    rows = corpus(120)
    odd = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "grumph"), (1, "a"), (1, "a"), (77, "grumph " * 200_000), (78, "İx grumph vexblot")]
    model = fit(table([r[:2] for r in rows] + odd), labels_of(spark, rows + [(1, "", 0), (1, "", 1)]))
    got = find_toxic(table(odd), model).collect()
    assert len(got) == len(odd)
    quiet = {r.score for r in got if r.doc_id is not None and r.doc_id < 4 and r.doc_id != 1}
    assert len(quiet) == 1 and quiet.pop() < 0.5
    assert [r.score for r in got if r.doc_id == 77][0] > 0.5
    for kind, score in ((0, 0.0), (1, 1.0)):
        one = [r for r in rows if r[2] == kind]
        scores = {round(r.score, 6) for r in find_toxic(table(odd), fit(table([r[:2] for r in one]), labels_of(spark, one))).collect()}
        assert scores == {score}
    none = fit(table([]), labels_of(spark, []))
    assert find_toxic(table([]), none).count() == 0
    assert {r.score for r in find_toxic(table([(1, "x")]), none).collect()} == {none.score(0)}


def test_clashing_columns(spark, table):
    rows = corpus(120)
    plain = table([r[:2] for r in rows])
    wide = table([(i, t, "en", "s", 0, "h", 1, "w") for i, t, _ in rows], ", h string, toxic int, `a.b` string")
    scores = lambda docs: sorted((r.doc_id, r.score) for r in find_toxic(docs, fit(docs, labels_of(spark, rows))).collect())
    assert scores(plain) == scores(wide)


def test_lengths_of_words_match():
    assert [w for w in WORD.findall("a_b-c1 é")] == ["a", "b", "c1", "é"]
