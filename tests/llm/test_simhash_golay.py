import random

import numpy as np
import xxhash
from codeloom.llm._components import connected_components
from codeloom.llm.simhash_golay import candidate_keys, fingerprint, golay, golay_links, local_links, near_components

ODD = [None, "", " ", "a", "A", "a b", "A B", "é É", "x " * 3000, "\x1c\x85\xa0 z", "one two three"]


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(prints):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, p, least[find(k)]) for k, (i, p) in enumerate(prints))


def test_every_word_is_within_three_bits_of_a_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 20000)
    index, there = golay().codewords(words)
    assert set(there.sum(1).tolist()) == {1, 6}
    flipped = words ^ (1 << np.random.default_rng(2).integers(0, 23, 20000))
    other, other_there = golay().codewords(flipped)
    assert all(a[0] in b[m] for a, b, m in zip(index, other, other_there, strict=True))


def test_close_fingerprints_share_a_key():
    rng = random.Random(3)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 4)):
            b ^= 1 << bit
        key, of = candidate_keys(np.array([a, b], np.uint64))
        assert set(key[of == a].tolist()) & set(key[of == b].tolist())


def test_fingerprint_matches_definition():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 4, 200):
        text = " ".join(f"w{rng.randrange(50)}É" for _ in range(n))
        assert fingerprint(text.encode()) == brute_print(text)


def test_components_match_brute_force(table):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(30)]
    rows = []
    for i in range(300):
        words = list(base[i % 30])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(120)] = "new"
        rows.append((i, " ".join(words)))
    rows += [(1000 + k, t) for k, t in enumerate(ODD)]
    got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in near_components(table(rows)).collect())
    want = brute_components(rows)
    assert got == want
    assert len({c for _, _, c in want}) < 250


def reached(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(n) for n in nodes]


def test_large_buckets_are_split_and_lose_no_link(spark):
    rng = random.Random(8)
    ball = {0x1234567890ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(1500)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in ball | {rng.getrandbits(64) for _ in range(200)})
    want = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    docs = spark.createDataFrame([(p,) for p in prints], "fp long")
    for bucket in (8192, 100):
        links = [(r.a, r.b) for r in golay_links(docs, bucket).collect()]
        assert reached(links, prints) == reached(want, prints)
        assert len(links) < len(prints) * 70


def test_local_links_join_exactly_the_reachable():
    rng = random.Random(6)
    start = rng.getrandbits(64)
    ball = {start}
    for _ in range(500):
        x = rng.choice(sorted(ball))
        ball.add(x ^ (1 << rng.randrange(12)))
    far = {rng.getrandbits(64) for _ in range(50)}
    links = local_links(np.array(sorted(ball | far), np.uint64))
    assert len(links) == len(ball) - 1


def test_long_paths(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 101)) and got[501] == 500


def test_nulls_repeats_and_empty(table):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "other words here now"), (2, None)]
    assert near_components(table(rows)).count() == 5
    assert near_components(table([])).count() == 0
