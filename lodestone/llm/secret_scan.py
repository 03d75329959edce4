"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models.

The patterns find assignments, access key ids and long hexadecimal runs. Besides, every run of key characters that is long enough is scored by two first-order
character models, one trained on random strings and one on ordinary identifiers; where the mean log-likelihood ratio per character step reaches the threshold,
which labelled samples held back from training set, the run is a secret too. Offsets count code points, ends are exclusive.

Defined results: null text counts as empty and has no spans; repeated rows each get their row; an empty table gives no rows; texts are scanned whole, and take
time in proportion to their length and matches; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length; in the order in which kinds are listed.
PATTERNS = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same runs, with the least length in the pattern where that cannot change what is matched.
QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pattern_spans(text: Column, kind: str, rank: int, pattern: str, group: int = 0, least: int = 0, block: int = 256) -> Column:
    """Array of (start, rank, kind, end, run) of the leftmost non-overlapping matches whose group has `least` characters.

    Matches are walked in blocks, whose starts come from the blocks' sums, so that many matches in a text do not copy one growing array again and again.
    """
    found, inside, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start: bigint, rank: int, kind: string, end: bigint, run: string>>)")
    zero = F.lit(0).cast("long")

    def step(s: Column, m: Column) -> Column:
        begin = s["at"] + F.length(m["gap"])
        end = begin + F.length(m["run"])
        one = F.array(F.struct(begin.cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), m["run"].alias("run")))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(m["part"]) >= least, F.concat(s["spans"], one)).otherwise(s["spans"]).alias("spans"))

    def walk(parts: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / block).cast("int"))
        rows = lambda b: F.slice(parts, b * block + 1, F.lit(block))
        sums = F.transform(blocks, lambda b: F.aggregate(rows(b), zero, lambda s, m: s + F.length(m["gap"]) + F.length(m["run"])))
        starts = F.aggregate(sums, F.array(zero), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b: F.aggregate(rows(b), F.struct(F.element_at(at, b + 1).alias("at"), empty.alias("spans")), step, lambda s: s["spans"]))))

    parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("run"), inside.alias("part"))
    return F.when(text.rlike(pattern), let(parts, walk)).otherwise(empty)


def train(random_strings: Iterable[str], identifiers: Iterable[str]) -> list[float]:
    """Log-likelihood ratio of each step between two characters of ALPHABET: random strings over identifiers, add-one smoothed."""
    n = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    tables = []
    for words in (random_strings, identifiers):
        c = [[1.0] * n for _ in range(n)]
        for w in words:
            at = [place.get(x, -1) for x in w]
            for a, b in zip(at, at[1:], strict=False):
                if a >= 0 and b >= 0:
                    c[a][b] += 1
        tables.append([[math.log(x / sum(row)) for x in row] for row in c])
    return [tables[0][a][b] - tables[1][a][b] for a in range(n) for b in range(n)]


def mean_ratio(run: str, table: list[float]) -> float:
    """The mean log-likelihood ratio of a run's steps."""
    n, at = len(ALPHABET), [ALPHABET.index(c) for c in run]
    return sum(table[a * n + b] for a, b in zip(at, at[1:], strict=False)) / max(1, len(at) - 1)


def random_strings(count: int = 6000, seed: int = 11) -> list[str]:
    """Labelled samples of random strings: hexadecimal in either case, alphanumeric, base 64, base 32, and letters alone, mixed and lower-case."""
    r = random.Random(seed)
    kinds = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[:26] + "234567", ALPHABET[:52], ALPHABET[26:52]]
    return ["".join(r.choices(kinds[k % len(kinds)], k=r.randint(16, 64))) for k in range(count)]


def identifiers(docs: DataFrame, rows: int = 1000, text_col: str = "text", words: int = 200_000) -> list[str]:
    """Labelled samples of ordinary identifiers: the distinct whole words of 2 to 15 letters and digits in at most `rows` distinct texts chosen by hash, read whole,
    after what the patterns find and runs long enough to be scored are taken out; with joined forms of them, as in code and addresses. More than `words` words
    are sampled by hash."""
    texts = docs.select(F.col(text_col).alias("t")).where(F.col("t").isNotNull()).withColumn("h", F.xxhash64("t"))
    bare = F.col("t")
    for pattern in (*(p[1] for p in PATTERNS[:2]), RUN):
        bare = F.regexp_replace(bare, pattern, " ")
    chosen = texts.where(F.col("h").isin([x[0] for x in texts.select("h").distinct().orderBy("h").limit(rows).collect()]))
    whole = F.regexp_extract_all(bare, F.lit(r"(?<![\p{L}\p{N}+/_=-])[\p{L}\p{N}]{2,15}(?![\p{L}\p{N}+/_=-])"), F.lit(0))
    found = chosen.select(F.explode(F.array_distinct(whole)).alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(words)
    ws = sorted(x[0] for x in found.collect())
    return ws + joined_forms(ws, 300, 5) + [f"{w}{n}" for w, n in zip(ws[:: max(1, len(ws) // 500)], range(1, 9999, 17), strict=False)]


def joined_forms(words: list[str], times: int, seed: int) -> list[str]:
    """Identifiers of three words each, joined as in code and addresses."""
    r = random.Random(seed)
    return [sep.join(r.choices(words, k=3)) for sep in ("_", "-", "/", "=", "") for _ in range(times)] if words else []


def threshold_of(table: list[float], secrets: Iterable[str], ordinary: Iterable[str], wrong: float = 0.002) -> float:
    """The least mean ratio that at most the share `wrong` of the ordinary samples reach, or the middle between both kinds' means if that is more."""
    long = [w for w in ordinary if len(w) >= 16 and all(c in ALPHABET for c in w)]
    low, high = sorted(mean_ratio(w, table) for w in long), [mean_ratio(w, table) for w in secrets]
    if not low:
        return sum(high) / len(high) / 2
    return max(low[min(len(low) - 1, int(len(low) * (1 - wrong)))], (sum(low) / len(low) + sum(high) / len(high)) / 2)


def markov_spans(text: Column, table: list[float], threshold: float, rank: int) -> Column:
    """Spans of runs that the models take for random strings."""
    n = len(ALPHABET)
    ratio = F.array(*[F.lit(round(x, 6)) for x in table])

    def mean(run: Column) -> Column:
        at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        steps = let(at, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.element_at(ratio, (a * n + b + 1).cast("int"))))
        return let(steps, lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x))

    return F.filter(pattern_spans(text, "markov", rank, RUN), lambda s: mean(s["run"]) >= threshold)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, table: list[float], threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans of the patterns) and found (those and the models' spans), each sorted by start and kind."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    own = [pattern_spans(F.col("text"), kind, rank, QUICK.get(kind, pattern), group, 0 if kind in QUICK else least) for rank, (kind, pattern, group, least) in enumerate(PATTERNS)]
    d = d.withColumn("base", F.array_sort(F.concat(*own))).withColumn("more", markov_spans(F.col("text"), table, threshold, len(PATTERNS)))
    return d.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("found"))


def report(scanned: DataFrame) -> DataFrame:
    """Counts of each kind, digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(p[0]) for p in PATTERNS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
