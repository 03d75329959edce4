"""Near copies against brute-force likeness over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import near_copies


def brute(docs, likeness=0.8):
    """The ids that stay: the least of each group."""
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= likeness * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return sorted({find(i) for i in sets})


def edited(words, r, times):
    words = list(words)
    for _ in range(times):
        words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
    return words


def kept(spark, docs, **more):
    return sorted(x.doc_id for x in near_copies.representatives(spark.createDataFrame(docs, "doc_id long, text string"), **more).collect())


@pytest.mark.parametrize("block", [8, 512])
def test_groups_of_every_likeness(spark, block):
    """Copies at likeness 0.5 to 1, one group larger than the blocks; those below 0.8 stay, no pair above is lost."""
    r = random.Random(4)
    docs = []
    for g in range(14):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.choice([60, 150, 300]))]
        for _ in range(40 if not g else 5):
            docs.append((len(docs), " ".join(edited(base, r, r.randint(0, len(base) // 30)))))
    want = brute(docs)
    assert 20 < len(want) < len(docs) - 15
    assert kept(spark, docs, block=block) == want


def test_given_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert kept(spark, docs) == brute(docs)


def test_sketches_are_bounds():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.8], r.integers(0, 1 << 63, r.integers(0, 900)).astype(np.uint64)]))
        assert near_copies.differing(near_copies.sketch(a), near_copies.sketch(b)) <= len(np.setxor1d(a, b))


def test_less_alike_texts_stay(spark):
    """Two changed words in 60 leave a likeness of 0.70, though only 44 of 256 fingerprint bits differ; one leaves 0.84."""
    base = [f"w{i}" for i in range(60)]
    twice, once = list(base), list(base)
    twice[5] = twice[11] = once[30] = "x"
    assert kept(spark, [(1, " ".join(base)), (2, " ".join(twice)), (3, " ".join(once))]) == [1, 2]
