import random
import re
from collections import Counter

import pytest
from codeloom.llm.source_divergence import source_divergence
from llm_cases import ODD_TEXTS

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, most=200):
    """Each number as it is defined, with Python's integers."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        seen = Counter(t for r in own for t in set(r[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2] if t in kept) for s in {r[1] for r in own}}
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        for s, c in counts.items():
            pairs = [(-sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept), other.encode(), other) for other, o in counts.items() if other != s]
            terms = [(-((share(c, t) - share(whole, t)) ** 2 // share(whole, t)), t.encode(), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(listed, 1)]
    return sorted(out)


def found(docs, **options):
    return sorted(tuple(r) for r in source_divergence(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def rows_of(n, sources, rng, vocabulary=60):
    return [(i, " ".join(f"{rng.choice('abcé')}{'xyzw'[k % 4] * (k % 5)}" for k in (rng.randrange(vocabulary) for _ in range(rng.randrange(30)))), rng.choice(["en", "de"]), rng.choice(sources)) for i in range(n)]


def test_against_brute_force(table):
    rows = rows_of(150, ["s1", "s2", "s3", "s4", None], random.Random(1))
    rows += [(1000 + i, t, None, "odd") for i, t in enumerate(ODD_TEXTS)] + [(7, "Émile ÉMILE émile A a", "fr", "one")] * 4
    assert found(table([r + (0,) for r in rows])) == brute(rows)


def test_terms_are_cut_at_the_limit_and_ties_go_by_the_item(table):
    rows = [(i, " ".join(chr(97 + k) * 3 for k in range(26)) if i < 3 else "zz zz", "en", "a" if i < 3 else "b") for i in range(6)]
    assert found(table([r + (0,) for r in rows]), most_terms=5) == brute(rows, most=5)


def test_a_language_without_kept_terms_and_a_group_without_terms(table):
    rows = [(1, "a b", "en", "s"), (2, "", "en", "t"), (3, None, "en", "u"), (4, "x x x", "de", "s"), (5, "x", "de", "s"), (6, "x", "de", "s"), (7, "1 2", "de", "t")]
    got = found(table([r + (0,) for r in rows]))
    assert got == brute(rows)
    assert {r[4] for r in got if r[0] == "en"} == {0}


def test_a_hot_source_with_very_long_and_repeated_texts(table):
    rng = random.Random(3)
    rows = rows_of(60, ["s1", "s2"], rng) + [(500 + i, "word long " * 20_000, "en", "hot") for i in range(4)] + [(9, "same text again", "en", "hot")] * 90
    assert found(table([r + (0,) for r in rows])) == brute(rows)


def test_large_counts_stay_exact(spark):
    from codeloom.llm.source_divergence import share

    for n, size in ((0, 1), (10**12, 3 * 10**12 + 7), (8 * 10**15, 8 * 10**15 + 3), (5, 9 * 10**15)):
        assert spark.sql(f"SELECT {share(f'{n}L', f'{size}L')} AS p").first().p == 1 + 10**9 * (n + 1) // size


def test_clashing_columns_and_empty_table(table):
    rows = [(i, "a b c", "en", "st"[i % 2], 0, "x", "y", 1, "z") for i in range(6)]
    docs = table(rows, ", term string, vector string, at int, `a.b` string")
    assert found(docs) == brute([r[:4] for r in rows])
    assert source_divergence(table([])).count() == 0


@pytest.mark.parametrize("lost", ["Python", "Arrow", "CartesianProduct"])
def test_plan(table, lost):
    plan = source_divergence(table([(1, "a", "en", "s", 0)]))._jdf.queryExecution().executedPlan().toString()
    assert lost not in plan
