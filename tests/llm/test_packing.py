import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from codeloom.llm import packing
from codeloom.llm.packing import Encoder, pack_documents, pack_histogram, solve_fractional
from llm_cases import ODD_TEXTS, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers():
    encoder, rng = Encoder(PATH), random.Random(1)
    signs = [chr(i) for i in range(256)] + list("''''ssttrevmlld  \n") * 3
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["<|endoftext|> a", "ŒUVRE ﬁ İ Σς é", "日本語 text", "I'll DON'T we've"]
    for text in texts:
        assert encoder.ids(text) == np.array(encoder.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_known_words_are_not_cut_again(monkeypatch):
    encoder, texts = Encoder(PATH), ["Two words, don't 12\x85x", "don't\xa0x words, Two", "a\x1cb words,"]
    want = [np.array(encoder.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert [encoder.ids(text) for text in texts] == want
    monkeypatch.setattr(packing, "PIECES", None)
    assert [encoder.ids(text) for text in texts] == want
    monkeypatch.undo()
    small = Encoder(PATH, remembered=4)
    assert [small.ids(text) for text in texts * 2] == want * 2


@pytest.mark.parametrize("seed", range(4))
def test_every_length_is_packed_once_and_few_bins_are_used(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 513): rng.randrange(1, 40) for _ in range(rng.choice((1, 5, 300)))} | ({512: 9} if seed else {})
    plan = pack_histogram(counts, 512)
    used = {}
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= 512
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    bins = sum(t for t, _ in plan)
    large = sum(v for k, v in counts.items() if k > 256)
    assert bins <= max(large, -(-total // 512)) * (1.02 if len(counts) > 100 else 1.4) + 1
    assert pack_histogram({}, 512) == []


@pytest.mark.parametrize("counts", [{775: 91, 1731: 446, 569: 416, 663: 428, 1203: 463, 920: 82}, {779: 1935, 1557: 1370, 1920: 1186, 1431: 1376, 965: 987}])
def test_the_program_beats_its_filling_alone(counts):
    with_program = sum(t for t, _ in packing.program_plan(counts, 4096))
    assert with_program < sum(t for t, _ in packing.program_plan(counts, 4096, program=False)) * 0.992
    assert sum(t for t, _ in pack_histogram(counts, 4096)) <= with_program


def plain_best_fit(counts, capacity):
    """Pieces one by one, longest first, each into the fullest sequence that takes it."""
    at_room = np.zeros(capacity + 1, np.int64)
    sequences = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = np.flatnonzero(at_room[length:])
            if len(fits):
                room = length + int(fits[0])
                at_room[room] -= 1
            else:
                room, sequences = capacity, sequences + 1
            at_room[room - length] += 1
    return sequences


def histogram(n, low, high, seed):
    return dict(Counter(np.random.default_rng(seed).integers(low, high + 1, n).tolist()))


HISTOGRAMS = [(6000, 2040, 2056), (5000, 1900, 2200), (5000, 1300, 1450), (5000, 900, 1500), (20000, 1, 4096), (500, 1, 4096), (3000, 4000, 4096), (3000, 1, 30), (4000, 1365, 1366), (4000, 1000, 1100),
              (2000, 2000, 4096), (2000, 1, 2048), (1, 7, 7), (999, 4096, 4096), (2500, 2048, 2049), (2500, 1024, 1025), (3000, 600, 700), (3000, 100, 3000), (700, 1364, 2800), (1500, 3000, 3100)]


@pytest.mark.parametrize("n, low, high", HISTOGRAMS)
def test_never_more_sequences_than_best_fit_decreasing(n, low, high):
    counts = histogram(n, low, high, seed=n + low)
    plan = pack_histogram(counts, 4096)
    used = Counter()
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= 4096
        for x in lengths:
            used[x] += times
    assert used == counts
    greedy = plain_best_fit(counts, 4096)
    assert sum(times for times, _ in packing.best_fit_decreasing(counts, 4096)) == greedy
    assert packing.lower_bound(counts, 4096) <= sum(times for times, _ in plan) <= greedy


def test_the_bound_is_a_bound():
    assert packing.lower_bound({60: 3, 50: 1, 40: 2}, 100) == 4
    assert packing.lower_bound({51: 10}, 100) == 10
    assert packing.lower_bound({2049: 7, 2048: 1}, 4096) == 8
    assert packing.lower_bound({}, 100) == 0


def test_uses_cover_all_within_the_bound():
    rng = random.Random(4)
    weights = np.array(sorted(rng.sample(range(20, 200), 12)))
    need = np.array([rng.randrange(10, 500) for _ in weights], float)
    uses, bound = solve_fractional(weights, need, 512)
    covered = np.zeros(len(need))
    for config, x in uses.items():
        assert sum(weights[i] for i in config) <= 512
        for i in config:
            covered[i] += x
    assert (covered >= need * (1 - 1e-9)).all()
    assert bound <= sum(uses.values()) <= 1.05 * bound + 1e-6
    assert 1.05 * bound >= (weights * need).sum() / 512


def check(rows, got, capacity):
    encoder = Encoder(PATH)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        ids = encoder.ids(text or "") + np.array([1], "<u4").tobytes()
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // (4 * capacity))))
        for r in mine:
            part = ids[4 * capacity * r.piece : 4 * capacity * (r.piece + 1)]
            assert (r.start, r.length, r.ids_crc32) == (capacity * r.piece, len(part) // 4, zlib.crc32(part))
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= capacity
    return len(ends)


def test_pieces_against_brute_force(table):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.choice((3, 40, 90, 400)))) for i in range(200)] + [(900 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = pack_documents(table(rows), PATH, 256).collect()
    sequences = check(rows, got, 256)
    assert sequences <= 1.02 * sum(r.length for r in got) / 256 + 1


def test_repeated_rows_null_ids_and_empty(table):
    got = pack_documents(table([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)]), PATH).collect()
    assert len(got) == 4 and len({r.sequence_id for r in got}) == 1
    assert pack_documents(table([]), PATH).count() == 0
