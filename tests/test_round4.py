"""Tests of what was changed after the findings of round 3."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone import models
from lodestone.operators import search, tokenizers
from lodestone.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_tile_is_not_sorted_whole(monkeypatch):
    sizes, plain = [], np.partition

    def partition(a, *args, **how):
        sizes.append(a.size)
        return plain(a, *args, **how)

    monkeypatch.setattr(search.np, "partition", partition)
    x = np.random.default_rng(5).normal(size=(9000, 16))
    x[4000:4020] = x[0]  # more equal vectors than are asked for
    ids = np.arange(len(x)) * 3
    q, i, d = search.nearest(ids[:300], x[:300], ids, x, "euclidean", 10, True)
    assert len(q) == 3000 and 0 < max(sizes) <= search.TILE_QUERIES * 1024
    for n in range(0, 300, 23):
        true = ((x - x[n]) ** 2).sum(1)
        true[n] = np.inf
        assert list(i[q == ids[n]]) == list(ids[np.lexsort((ids, true))[:10]])


def test_hash_embed_shuffles_no_text(spark):
    df = catalogue.QUERIES["hash_embed"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in plan(df) and df.count() == 200


@pytest.mark.parametrize("sizes", [(3, 4, 5), (1, 2), (7,), (2, 9)])
def test_packed_grams_are_the_grams(monkeypatch, sizes):
    monkeypatch.setattr(models, "PIECE", 40)
    for text in ["", "__", "a a a b", "ß İstanbul ﬁ 漢字 é", "word " * 50 + "other words in a row", "x" * 300]:
        marked = [f"<{w}>".encode() for w in re.findall(r"[^\W_]+", text.casefold())] or [b"<>"]
        v = np.zeros(16)
        for gram, n in Counter(w[i : i + k] for w in marked for k in sizes for i in range(max(1, len(w) - k + 1))).items():
            v[zlib.crc32(gram) % 16] += (1 if zlib.adler32(gram) & 1 else -1) * (1 + math.log(n))
        if np.linalg.norm(v):
            assert (models.HashEmbedder(16, False, sizes).vector(text) == v).all(), text


def test_words_meet_their_texts_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(tokenizers, "BLOCK", 30)
    t = tokenizers.WordPiece({t: i for i, t in enumerate(["[UNK]", "ab", "abc", "##c", "##cd", "##d", "a", "##"])}, {"unk": "[UNK]"})
    texts = ["abcd abcd", "ab a zz", "", None, "abcd " * 40, "abcd abcd", "  ", "ab" + "c" * 300]
    rows = spark.createDataFrame([(i % 6, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = tokenizers.encode(rows, t, tokenizers.Options(0))
    assert "posexplode" not in plan(got)  # an occurrence of a word is no row of its own
    split = {"abcd": ["abc", "##d"], "ab": ["ab"], "a": ["a"], "zz": ["[UNK]"], "ab" + "c" * 300: ["[UNK]"]}
    want = [[p for w in (x or "").split() for p in split[w]] for x in texts]
    assert sorted((r["doc_id"], r["tokens"], r["ids"], r["mask"]) for r in got.collect()) == sorted((i % 6, w, [t.vocabulary[p] for p in w], [1] * len(w)) for i, w in enumerate(want))
