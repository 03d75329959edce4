"""The pipeline's stages against plain Python versions, stage by stage, each on what the stage before kept."""

import re

import pytest

import corpus_pipeline
from lodestone.llm import mixing, pseudonyms, queries, toxicity
from lodestone.llm.common import staged

from .test_near_copies import brute
from .test_operators import targets

D = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{D}/documents.parquet")]
    for _, f in corpus_pipeline.STAGES:
        out.append(staged(f(spark, out[-1], D)))
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "packing"]
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_toxicity_stage(spark, stages):
    docs, kept = stages[0], stages[1]
    model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet").where(queries.remainder(5) != 0))
    want = sorted(tuple(r) for r in docs.collect() if toxicity.chance(r.text, model) < 0.5)
    assert sorted(map(tuple, kept.collect())) == want
    assert 0 < docs.count() - kept.count() < 0.2 * docs.count()


def test_near_copies_stage(stages):
    """The least id of each group that a likeness of 0.8 in shingles of five words connects, by brute force."""
    docs = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == brute(docs)


def test_personal_data_stage(stages):
    p = pseudonyms.Permutation(queries.PII_KEY.encode())
    want = sorted((r.doc_id, pseudonyms.pseudonymised(r.text, p)[0], r.lang, r.source, r.n_chars) for r in stages[2].collect())
    assert sorted(map(tuple, stages[3].collect())) == want
    assert any(a != b.text for a, b in zip((w[1] for w in want), sorted(stages[2].collect(), key=lambda r: r.doc_id), strict=True))


def test_mixing_stage(stages):
    words = lambda t: len(re.findall(mixing.WORD, t))
    before, after = stages[3].collect(), stages[4].collect()
    sizes, got = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in after:
        got[r.source] = got.get(r.source, 0) + words(r.text)
    want = targets(sizes)
    assert all(abs(got.get(s, 0) - want[s]) <= 1 for s in sizes)
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in after)


def test_packing_stage(stages):
    docs = [(r.doc_id, r.text) for r in stages[4].collect()]
    pieces = stages[5].collect()
    alone = {d for d, _ in docs if sum(x == d for x, _ in docs) == 1}
    first = {}
    for d, t in docs:
        first.setdefault(d, t)
    assert sum(p.length for p in pieces) > 0
    own = [p for p in pieces if p.doc_id in alone]
    whole = {}
    for p in own:
        whole[p.doc_id] = whole.get(p.doc_id, 0) + p.length
    assert {d: n for d, n in whole.items()} == {p.doc_id: p.doc_tokens for p in own}
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 0 and corpus_pipeline.ORACLE_SQL is None
