import random

import pytest
from codeloom.llm._repeats import remove_repeats
from codeloom.llm.substring_dedup import SuffixAutomaton, match_automaton, remove_reference, substring_dedup
from codeloom.llm.suffix_array import match_suffixes, suffix_array_dedup

WAYS = {"array": (suffix_array_dedup, match_suffixes, 50), "automaton": (substring_dedup, match_automaton, 20)}


def brute(rows, window):
    seen, out = {}, {}
    texts = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(texts):
        words, cut = texts[i], set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                cut.update(range(s, s + window))
            seen.setdefault(key, (i, s))
        out[i] = (len(words), len(cut), b" ".join(w for p, w in enumerate(words) if p not in cut).decode())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000):x}"
    passages = [[word() for _ in range(n)] for n in (20, 49, 50, 51, 60, 200)]
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.choice((0, 1, 19, 20, 60, 300)))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice((p, p, p[a:], p[:a]))
        rows.append((i, rng.choice((" ", "\n", " \t")).join(words)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 3)]
    rows += [(300, "er " * 500), (301, "a b " * 300), (302, "er " * 70), (303, None), (304, ""), (305, "É\x85É\x1c " * 60)]
    rows += [(400 + i, " ".join(passages[4] + [f"n{i}"] * (i % 3) + passages[5])) for i in range(40)]
    return rows


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("hot", [2048, 5])
def test_matches_brute_force(table, way, hot):
    _, match, window = WAYS[way]
    rows = corpus(window + hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(table(rows), window, 6, match, hot=hot).collect()}
    assert got == brute(rows, window)
    assert sum(x[1] for x in got.values()) > 3000


@pytest.mark.parametrize("hot", [2048, 5])
@pytest.mark.parametrize("words", [50, 4000])
def test_shards_match_brute_force(table, hot, words):
    rows = corpus(words)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(table(rows), shard_words=words, hot=hot).collect()}
    assert got == brute(rows, 20)


def test_a_full_filter_changes_nothing(table):
    rows = corpus(77)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(table(rows), 20, 6, match_automaton, max_bits=1).collect()}
    assert got == brute(rows, 20)


@pytest.mark.parametrize("words", [30, 200_000])
def test_reference_spans_are_removed(spark, table, words):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(300):x}"
    reference = [[word() for _ in range(n)] for n in (3, 20, 25, 60, 400)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.choice((0, 10, 100)))]
        part = rng.choice(reference)
        a = rng.randrange(len(part))
        text[len(text) // 2 : len(text) // 2] = rng.choice((part, part[a:], part[: a + 1]))
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, "")]
    known = {tuple(r[i : i + 20]) for r in reference for i in range(len(r) - 19)}
    want = {}
    for i, t in rows:
        w = (t or "").split()
        cut = {p for s in range(len(w) - 19) if tuple(w[s : s + 20]) in known for p in range(s, s + 20)}
        want[i] = (len(w), len(cut), " ".join(x for p, x in enumerate(w) if p not in cut))
    other = spark.createDataFrame([(" ".join(r),) for r in reference] + [(None,), ("",)], "passage string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_reference(table(rows), other, reference_col="passage", round_words=words, shard_words=40).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 300
    assert remove_reference(table(rows), other.limit(0), reference_col="passage").filter("n_removed > 0").count() == 0


@pytest.mark.parametrize("way", WAYS)
def test_spans_hold_what_is_removed(table, way):
    find, _, window = WAYS[way]
    text = " ".join(f"w{i}" for i in range(80))
    got = {r.doc_id: r.spans for r in find(table([(1, text), (2, "x y " + text + " z")])).collect()}
    assert got[1] == [] and [(s.start, s.end) for s in got[2]] == [(2, 82)]


@pytest.mark.parametrize("way", WAYS)
def test_nulls_repeated_rows_and_empty(table, way):
    find = WAYS[way][0]
    text = " ".join(f"w{i}" for i in range(60))
    got = find(table([(None, text), (1, text), (1, text), (1, text + " end"), (None, None)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 60, 60, 60]
    assert find(table([])).count() == 0


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 15))] for _ in range(3)]
        automaton = SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        query = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        inside = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}
        want = [max(n for n in range(e + 2) if tuple(query[e + 1 - n : e + 1]) in inside) for e in range(30)]
        assert automaton.statistics(query) == want
