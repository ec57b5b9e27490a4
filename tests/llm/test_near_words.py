import random

import corpus_pipeline
import numpy as np
from codeloom.llm import near_words
from codeloom.llm.near_words import drop_similar, similar_groups
from codeloom.llm.simhash_golay import drop_near_copies
from llm_cases import ODD_TEXTS, words


def brute_kept(rows, n=5, similarity=0.8):
    """Ids of one document of each group, by all pairs of sets."""

    def shingles(text):
        found = (text or "").encode().lower().split()
        return {b" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))}

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both / (len(sets[a]) + len(sets[b]) - both) >= similarity:
                group[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def corpus():
    """Texts with edits of every strength, of all lengths, some with one passage in common."""
    rng = random.Random(11)
    passage, rows = words(rng, 40), []
    for b in range(25):
        base = words(rng, rng.choice((5, 6, 12, 20, 60, 200))).split()
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(99)}"
            if b % 5 == 0:
                text += passage.split()
            rows.append((len(rows), " ".join(text)))
    return rows + [(1000 + k, t) for k, t in enumerate(ODD_TEXTS)]


def test_stage_keeps_what_brute_force_keeps(spark, table):
    rows = corpus()
    want = brute_kept(rows)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = stage(spark, table(rows), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert len(want) < 150


def test_lengths_and_similarities_are_parameters(table):
    rows = corpus()
    for n, similarity in ((3, 0.6), (2, 1.0)):
        kept = drop_similar(table(rows), n, similarity)
        assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows, n, similarity)


def test_blocks_change_nothing(table):
    rows = corpus()
    assert sorted(r.doc_id for r in drop_similar(table(rows), together=3).collect()) == brute_kept(rows)


def test_the_operator_and_its_candidates(table):
    rows = corpus()
    assert sorted(r.doc_id for r in drop_near_copies(table(rows)).collect()) == brute_kept(rows)


def test_clashing_names(table):
    rows = [(i, f"a b c d e {i // 2}", "en", "s", 1, "own", 5, "dot") for i in range(20)]
    docs = table(rows, ", node string, __maybe int, `a.b` string")
    for kept in (drop_near_copies(docs), drop_similar(docs)):
        assert kept.columns == docs.columns
        assert {(r.node, r["a.b"]) for r in kept.collect()} == {("own", "dot")}


def test_nulls_repeats_and_empty(table):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "other words here now"), (2, None), (3, "")]
    assert sorted(str(r.doc_id) for r in drop_similar(table(rows)).collect()) == ["1", "2", "None"]
    assert drop_similar(table([])).count() == 0
    assert drop_near_copies(table([])).count() == 0


def test_groups_are_reached_over_pairs():
    sets = [np.arange(a, a + 20, dtype=np.uint64) for a in (0, 2, 4, 100)]
    assert similar_groups(sets, 0.8).tolist() == [0, 0, 0, 3]
    assert near_words.spare(20, 0.8) == 4 and near_words.spare(4, 0.8) == 0
