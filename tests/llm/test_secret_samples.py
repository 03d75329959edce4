"""What the identifier model of the secret scan learns from."""

from lodestone.llm import secret_scan


def test_identifiers_of_distinct_whole_texts(spark):
    texts = ["alpha beta", "gamma delta", "ab " * 7000 + "zulu"]
    docs = spark.createDataFrame([(t,) for t in texts for _ in range(5)], "text string")
    assert {"alpha", "beta", "gamma", "delta", "ab", "zulu"} <= set(secret_scan.identifiers(docs, rows=3))


def test_words_are_not_cut_by_alphabet(spark):
    docs = spark.createDataFrame([(" ".join(a + b + c + d for a in "abz" for b in "abcdefghij" for c in "abcdefghij" for d in "abcdefghij"),)], "text string")
    some = [w for w in secret_scan.identifiers(docs, words=300) if len(w) == 4]
    assert {w[0] for w in some} == {"a", "b", "z"}
