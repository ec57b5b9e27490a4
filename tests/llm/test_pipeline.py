import pathlib
import random

import corpus_pipeline
import public_tokenizers
from codeloom.llm import entry
from codeloom.llm._common import scratch_path
from codeloom.llm.packing import Encoder
from llm_cases import ODD_TEXTS
from test_near_words import brute_kept

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n):
    syllables = ["the", "an", "ti", "er", "on", "wh", "sh", "ed"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def corpus():
    rng = random.Random(9)
    rows = [(i, words(rng, rng.choice((20, 100, 400))), "en", f"src{i % 5}", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "src0", 0) for i in range(20)]
    near = rows[50][1].split()
    rows += [(300 + i, " ".join(near[:-1] + [f"z{i}"]), "en", "src1", 0) for i in range(5)]
    rows += [(400 + i, words(rng, 60).replace(" ", "*** "), "en", "src2", 0) for i in range(12)]
    return rows + [(500 + i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)]


def run(spark, docs):
    """Each stage's result, by name, every one worked on by the next."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        out[name] = docs
    return out


def test_stages_against_brute_force(spark, table):
    rows = corpus()
    texts = {i: t for i, t, *_ in rows}
    out = run(spark, table(rows))
    ids = {k: sorted(r.doc_id for r in df.select("doc_id").collect()) for k, df in out.items()}
    for name in ("quality", "exact_dedup", "near_dedup", "source_mixing"):
        assert out[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = ids["quality"]
    assert not set(range(400, 412)) & set(kept) and set(range(120)) <= set(kept)
    last = {}
    for i in kept:
        key = (texts[i] or "").translate(UPPER)
        last[key] = max(i, last.get(key, i))
    assert ids["exact_dedup"] == sorted(last.values())
    assert ids["near_dedup"] == brute_kept([(i, texts[i]) for i in ids["exact_dedup"]])
    assert len(set(ids["near_dedup"]) & set(range(300, 305))) == 1 or 50 in ids["near_dedup"]
    assert set(ids["source_mixing"]) <= set(ids["near_dedup"])
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(encoder.ids(texts[i] or "")) // 4 + 1 for i in ids["source_mixing"])
    pieces = out["packing"].collect()
    assert sum(r.length for r in pieces) == tokens
    assert set(ids["packing"]) == set(ids["source_mixing"])


def test_clashing_names_go_through(spark, table):
    extra = ", __key string, __sha string, row string, __copy int, `a.b` string, tie int"
    rows = [(i, f"one two three four five six number {i // 2}", "en", f"src{i % 3}", 0, "k", "s", "r", 1, "d", 2) for i in range(40)]
    docs = table(rows, extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == table(rows, extra).columns, name
        assert {(r["__key"], r["__sha"], r.row, r["__copy"], r["a.b"], r.tie) for r in docs.collect()} == {("k", "s", "r", 1, "d", 2)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_scratch_tables_are_removed(spark, tmp_path, table):
    shared = pathlib.Path(scratch_path(spark, "x").removeprefix("file:")).parent
    before = set(shared.iterdir()) if shared.exists() else set()
    table(corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    left = sorted(p.name.rpartition("-")[0] for p in set(shared.iterdir()) - before)
    assert left == ["pieces", "pipeline-source_mixing"]  # what the returned table is read from


def test_an_empty_table_goes_through(spark, table):
    assert run(spark, table([]))["packing"].count() == 0


def test_every_operator_has_a_query():
    numbers = [int(n[2:].split("_")[0]) for n in entry.QUERIES]
    assert sorted(numbers) == list(range(1, 11))
    assert set(entry.ORACLE_SQL) <= set(entry.QUERIES)
