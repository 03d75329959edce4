"""Operators 11 to 13 against plain loops, and their odd inputs."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import codes, language_model, manifest, queries

D = "/root/testdata/sf0.001"


# ---- language model


def plain_model(texts, order):
    """How often each symbol follows each context."""
    seen = {}
    for t in texts:
        symbols = [0] * order + [x + 1 for x in t] + [257]
        for i in range(order, len(symbols)):
            for k in range(order + 1):
                seen.setdefault(tuple(symbols[i - k : i]), {}).setdefault(symbols[i], 0)
                seen[tuple(symbols[i - k : i])][symbols[i]] += 1
    return seen


def plain_probability(seen, context, symbol):
    """From the longest context down, with the symbols of longer ones excluded."""
    p, excluded = 1.0, set()
    while True:
        have = {s: n for s, n in seen.get(context, {}).items() if s not in excluded}
        if have:
            total = sum(have.values()) + (0 if len(seen[context]) == 257 else len(have))
            if symbol in have:
                return p * have[symbol] / total
            p *= len(have) / total
            excluded |= set(have)
        if not context:
            return p / (257 - len(excluded))
        context = context[1:]


def plain_score(seen, text, order):
    symbols = [0] * order + [x + 1 for x in text] + [257]
    return sum(math.log10(plain_probability(seen, tuple(symbols[i - order : i]), symbols[i])) for i in range(order, len(symbols)))


def remainder(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(4)
    made = ["".join(r.choice("abcde fgh\tXé\U0001f600\x00") for _ in range(r.randrange(0, 80))) for _ in range(40)]
    return [*made, None, "", " ", "a", "a", "A", "word " * 2000, "\x0b\x1c two\x85words "]


def test_scores_are_the_plain_loop(spark, odd_texts):
    queries.small_batches(spark)
    rows = [(k if k % 9 else None, t, "x") for k, t in enumerate(odd_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch string")
    got = language_model.scores(docs, F.col("text"), queries.remainder(7) != 2, [F.col("doc_id"), F.col("text")], order=3, batch_bytes=700).collect()
    assert len(got) == len(rows)
    raw = lambda t: (t or "").encode().lower()
    train = [raw(t) for i, t, _ in rows if remainder(i, 7) != 2]
    seen = plain_model(train, 3)
    tokens = [w for t in train for w in [*t.split(), None]]
    total, kinds = len(tokens), len(set(tokens))
    for g in got:
        t = raw(g["text"])
        own = [*t.split(), None]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"], g["n_bytes"]) == (len(own), sum(w in tokens for w in own), total, len(t))
        assert g["base_score"] == pytest.approx(sum(math.log10((tokens.count(w) + 1) / (total + kinds + 1)) for w in own))
        assert g["score"] == pytest.approx(plain_score(seen, t, 3), rel=1e-9)


def test_probabilities_of_a_context_add_up_to_one(spark):
    """Asks for every symbol in some contexts, through the operator's own joins."""
    order, texts = 2, [b"abracadabra", b"banana", bytes(range(256)) * 2]
    seen = plain_model(texts, order)
    contexts = [(0, 0), (0, 98), (98, 99), (99, 98), (3, 200), (200, 3)]
    grams = {(c[0] << 18) | (c[1] << 9) | s: 0 for c in contexts for s in range(1, 258)}
    for t in texts:
        for g in language_model.packed([t], order)[0].tolist():
            grams[g] = grams.get(g, 0) + 1
    rows = spark.createDataFrame(list(grams.items()), "gram long, n long")
    value = {r[0]: 10 ** r[1] for r in language_model.code_lengths(rows, order).collect()}
    for c in contexts:
        own = [value[(c[0] << 18) | (c[1] << 9) | s] for s in range(1, 258)]
        assert sum(own) == pytest.approx(1)
        for s in (1, 98, 99, 257):
            assert own[s - 1] == pytest.approx(plain_probability(seen, c, s))


def test_long_texts_are_packed_in_parts(monkeypatch):
    texts = [b"abc" * 50, b"", b"xyz" * 700, b"q" * 200, b"last"]
    whole, of = language_model.packed(texts, 4)
    monkeypatch.setattr(language_model, "SLICE", 100)
    parts = list(language_model.slices(texts, 4))
    assert len(parts) > 20
    assert np.concatenate([k for k, _ in parts]).tolist() == whole.tolist()
    assert np.concatenate([n for _, n in parts]).tolist() == of.tolist()


def test_scores_without_training_rows_and_of_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.scores(docs, F.col("text"), F.lit(None).cast("boolean"), [F.col("doc_id")]).collect()}
    assert got[1]["score"] == pytest.approx(-5 * math.log10(257)) and got[1]["base_score"] == 0 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0
    assert got[2]["score"] == pytest.approx(-math.log10(257)) and got[2]["n_tokens"] == 1
    assert language_model.scores(docs.limit(0), F.col("text"), F.lit(True), [F.col("doc_id")]).count() == 0


def test_likelier_texts_score_higher(spark):
    """A text in the corpus' language costs fewer bits a byte than its letters in another order."""
    got = queries.op11_lm_scores(spark, D).where("held_out and n_bytes > 200").select("doc_id", "score", "n_bytes").collect()
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall())
    seen = plain_model([t.encode().lower() for i, t in docs.items() if remainder(i, 7) != 2], 4)
    for g in got[:4]:
        text = docs[g["doc_id"]].encode().lower()
        assert g["score"] == pytest.approx(plain_score(seen, text, 4), abs=1e-4)
        shuffled = bytearray(text)
        random.Random(0).shuffle(shuffled)
        assert plain_score(seen, bytes(shuffled), 4) < 1.3 * g["score"]


# ---- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text), by position in the result (doc_id, leaf, subroot, root, proof, folded, verified)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        trees[x].sort(key=lambda y: y[:3])
    levels = {x: plain_levels([y[2] for y in trees[x]]) for x in order}
    top, out = plain_levels([levels[x][-1][0] for x in order]), []
    for k, x in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(trees[x]):
            path = [(at, level) for at, level in [*((i >> n, lv) for n, lv in enumerate(levels[x][:-1])), *((k >> n, lv) for n, lv in enumerate(top[:-1]))]]
            beside = [level[at ^ 1] if at ^ 1 < len(level) else None for at, level in path]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = plain_leaf((*r[:3], r[3] + 1, r[4])) if hit and r[3] is not None else leaf
            for (at, _), b in zip(path, beside, strict=True):
                node = H(node) if b is None else H(b, node) if at & 1 else H(node, b)
            out.append((r[0], leaf, levels[x][-1][0], top[-1][0], H(*(b for b in beside if b)), node, node == top[-1][0]))
    return out


def manifest_rows(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_paths_of_fractal_traversal_are_the_trees(monkeypatch):
    for n in [1, 2, 3, 5, 8, 9, 31, 64, 100]:
        leaves = [H(str(i)) for i in range(n)]
        for height in {manifest.height_of(n), 7}:
            levels = [leaves]
            for _ in range(height):
                levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
            for step in (1, 2, 3, 7):
                for i, path in enumerate(manifest.paths(leaves, height, step)):
                    want = ["" if (i >> k) ^ 1 >= len(levels[k]) else "RL"[i >> k & 1] + levels[k][(i >> k) ^ 1] for k in range(height)]
                    assert path == want
                    assert manifest.top_of(leaves[i], path) == levels[height][0]


def test_traversal_holds_few_nodes(monkeypatch):
    """Subtrees are ready when they are entered, and hold 2**(step + 1) nodes a level at most."""
    late, held = [], []
    filled = manifest.Subtree.filled

    def watched(self, leaves):
        if self.low and self.next > self.end or self.kept and not (self.stack and self.stack[0][0] == self.high):
            late.append(self)
        out = filled(self, leaves)
        held.append(len(out.kept) + len(out.stack))
        return out

    monkeypatch.setattr(manifest.Subtree, "filled", watched)
    assert len(list(manifest.paths([str(i) for i in range(1024)], 10, 3))) == 1024
    assert not late and max(held) <= 2**4


@pytest.mark.parametrize("height", [2, 3, 10])
def test_manifest_is_the_plain_loop(spark, height, monkeypatch):
    r = random.Random(height)
    rows = [(None if k % 17 == 0 else r.randrange(150), r.choice(["a", None, "é", "-"]), r.choice(["en", "en", "en", "de", None, "", "\U0001f600", "￮"]), r.choice([None, 0, k]), r.choice([None, "", "x" * k, "téxt"])) for k in range(300)]
    rows += [(3, "s", "solo", 1, "one")] + [(5, "s", "en", 2, "same")] * 40
    docs = spark.createDataFrame([(*x, "t", 0) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, at int")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    prove = manifest.prove
    monkeypatch.setattr(manifest, "prove", lambda *a, **b: prove(*a, **b, height=height))
    got = manifest_rows(queries.op12_manifest(spark, ""))
    assert got == sorted(plain_manifest(rows), key=str)
    assert 0 < sum(not x[-1] for x in got) < len(got)


@pytest.mark.parametrize("rows", [[], [(1, "s", None, 3, None)], [(i, "s", "en", 1, "a") for i in (1, 2, 3)]])
def test_manifest_of_few_rows(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert manifest_rows(queries.op12_manifest(spark, "")) == sorted(plain_manifest(rows), key=str)


def test_manifest_of_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{D}/documents.parquet'").fetchall()
    assert manifest_rows(queries.op12_manifest(spark, D)) == sorted(plain_manifest(rows), key=str)


# ---- codes


def plain_codes(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label): plain Lloyd in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda c: [min(range(len(book[p])), key=lambda e: (far(c[p], book[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        found = [nearest(c) for c in cut]
        for p in range(parts):
            for e in range(len(book[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p] == e]
                if own:
                    book[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [nearest(c) for c in cut]
    errors = [sum(far(c[p], book[p][f[p]]) for p in range(parts)) for c, f in zip(cut, found, strict=True)]
    by = {}
    for (_, _, y), e in zip(kept, errors, strict=True):
        by[y] = by.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{x:02x}" for x in f), e, by[y], digest) for (i, _, y), f, e in zip(kept, found, errors, strict=True)]


def code_rows(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_are_plain_lloyd_with_ties(spark):
    r = np.random.default_rng(2)
    vectors = (r.integers(-3, 4, (300, 8)) / 4).tolist()  # few values: many ties and repeated parts
    rows = [(i if i % 50 else None, v, None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.5, None] * 4, 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("-inf")] + [0.0] * 7, None), (904, [0.1, 0.2], 2), *[(1, vectors[1], 1)] * 30]
    df = spark.createDataFrame([(*x, "w") for x in rows], "vec_id long, embedding array<float>, label long, row string")
    want = sorted(plain_codes([x for x in rows if x[0] != 904], 4, 16, 4, 4), key=str)
    assert code_rows(codes.compress(df, 4, 16, 4, 4)) == want
    assert code_rows(codes.compress(df.repartition(5), 4, 16, 4, 4)) == want


def test_codes_of_the_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{D}/embeddings.parquet'").fetchall()
    vectors = spark.read.parquet(f"{D}/embeddings.parquet")
    assert code_rows(codes.compress(vectors, 4, 32, 4, 1024)) == sorted(plain_codes(rows, 4, 32, 4, 1024), key=str)


def test_bounds_rule_out_and_never_change_a_result():
    r = np.random.default_rng(3)
    centres = r.integers(-4000, 4000, (12, 6))
    x = np.concatenate([c + r.integers(-90, 90, (200, 6)) for c in centres])
    old = centres + r.integers(-40, 40, centres.shape)
    entry, upper, lower = codes.scan(x, old)
    scanned = 0
    for _ in range(6):
        new = np.stack([x[entry == e].sum(0) // (entry == e).sum() if (entry == e).any() else old[e] for e in range(len(old))])
        entry, upper, lower, full = codes.reassigned(x, old, new, entry, upper, lower)
        d = ((x[:, None] - new[None]) ** 2).sum(2)
        assert (entry == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), entry])).all()
        d[np.arange(len(x)), entry] = np.iinfo(np.int64).max
        assert (lower <= np.sqrt(d.min(1))).all()
        scanned, old = scanned + full.sum(), new
    assert scanned < len(x)  # of 6 len(x) comparisons


def test_wide_integers_are_compared_exactly():
    x = np.array([[2**26, 1], [2**26, 3]])
    book = np.array([[2**26, 2], [2**26 - 1, 1], [-(2**26), 2]])
    assert codes.squared(x, book).tolist() == [[1, 1, 2**54 + 1], [1, 5, 2**54 + 1]]
    assert codes.scan(x, book)[0].tolist() == [0, 0]


@pytest.mark.parametrize("rows", [[], [(1, [0.5, -0.25, 1.0], 3)], [(2, None, 1)], [(1, [], 1)]])
def test_codes_of_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")
    got = codes.compress(df, 4, 256, 4, 1024).collect()
    assert [(g["vec_id"], g["code"], g["error"]) for g in got] == [(i, "00000000", 0) for i, v, _ in rows if v is not None]


# ---- SQL


@pytest.mark.parametrize("name", ["op11_lm_scores", "op12_manifest", "op13_codes"])
def test_queries_are_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchall()
    names = [x[0] for x in con.description]
    df = queries.QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# ---- pseudonyms


def test_a_day_is_one_pseudonym_in_every_form():
    import datetime

    from lodestone.llm import pseudonyms

    p, seen = pseudonyms.Permutation(b"key"), set()
    for k in range(0, 73000, 61):
        day = datetime.date(1900, 1, 1) + datetime.timedelta(k)
        forms = [day.strftime("%Y-%m-%d"), day.strftime("%Y/%m/%d"), day.strftime("%d.%m.%Y"), day.strftime("%m/%d/%Y"), f"{day.day} {day:%B} {day.year}", f"{day:%b} {day.day}, {day.year}"]
        forms += [day.strftime("%d/%m/%Y")] if day.day > 12 else []
        new = [pseudonyms.pseudonymised(f"on {f}.", p)[0][3:-1] for f in forms]
        image = datetime.date.fromisoformat(new[0])
        want = [image.strftime("%Y-%m-%d"), image.strftime("%Y/%m/%d"), image.strftime("%d.%m.%Y"), image.strftime("%m/%d/%Y"), f"{image.day} {image:%B} {image.year}", f"{image:%b} {image.day}, {image.year}", image.strftime("%d/%m/%Y")]
        want[5] = f"{image:%B} {image.day}, {image.year}" if day.month == 5 else want[5]  # May is a long name
        assert new == want[: len(new)] and (image.day > 12) == (day.day > 12)
        seen.add(image)
    assert len(seen) == len(range(0, 73000, 61))


def test_bank_accounts_stay_valid_and_linked():
    from lodestone.llm import pseudonyms

    p = pseudonyms.Permutation(b"key")
    valid = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    plain, spaced = "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"
    new, spans = pseudonyms.pseudonymised(f"pay {plain} or {spaced}; not GB83WEST12345698765432", p)
    first, second = spans[0]["pseudonym"], spans[1]["pseudonym"]
    assert [x["kind"] for x in spans] == ["iban", "iban"] and first == second.replace(" ", "") != plain and valid(first) and first[:2] == "GB"
    assert [len(x) for x in second.split(" ")] == [4, 4, 4, 4, 4, 2] and new.endswith("GB83WEST12345698765432") and first[4:8].isalpha() and first[8:].isdigit()
