"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source queues its documents in a shuffled order that a seed fixes, up to `repeats` rounds over. A document's virtual finish time in a round is the
cumulated size of its source up to and with it, rounds before included, over the source's weight. The virtual clock runs until the budget, the size of all
documents, is spent: what finishes by then is taken whole, what a source is serving then is cut there, and what comes later is not taken. Sources whose rounds
are over leave the rest to the others. The clock's last time has a closed form over the sources' sizes (water filling), so the truncation needs no
sequential pass; the mixture itself is range-sorted by virtual finish time over all rounds.

Cumulated sizes come in two levels: sums of (source, hash bucket) and a prefix sum over those, then a window inside each bucket, so that a source with a third
of all rows is spread over many buckets, each of about `per_bucket` rows at most.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in order; repeated rows and equal ids queue one after another,
in the order of their texts' hashes; empty tables give no rows; the input's columns travel in one struct, and those named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


#: services: virtual finish time and words of each round in which words of the document are taken; virtual_finish: that of its first round.
RESULTS = ("size", "source_size", "target", "taken", "virtual_finish", "services")


def word_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], repeats: int) -> DataFrame:
    """From a row per source (_src, _null, source_size): _weight, target and the virtual time _level of the cut.

    Targets are min(level * weight, repeats * size); level is where they sum to all sizes. As sources in order of
    repeats * size / weight fill up, the level is what is left over the weights that are left.
    """
    order = Window.orderBy("_null", F.encode("_src", "utf-8"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("_weight", F.get(w, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * float(repeats))
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_null", F.encode("_src", "utf-8"))
    earlier, later = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("_rest", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_weight").over(later))
    # the first source that does not fill up has the level; for one that does, its own cap counts
    full = F.col("_rest") * F.col("_weight") >= F.col("_cap")
    s = s.withColumn("_level", F.first(F.when(~full, F.col("_rest")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_weight"))))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, seed: str = "mix", per_bucket: int = 100_000, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """The rows of docs with size, source_size, target, taken, virtual_finish and services.

    weights go to the sources in code point order, again and again; repeats: rounds in which a document may be taken. Each source meets floor(target).
    """
    size = word_count(F.col("text")) if size is None else size
    buckets = max(1024, docs.count() // per_bucket)
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    d = docs.select(row, F.col(id_col).alias("_id"), F.col(source_col).isNull().alias("_null"), F.coalesce(F.col(source_col), F.lit("")).alias("_src"), size.alias("size"), tie.alias("_tie"))
    d = d.withColumn("_key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    d = d.withColumn("_bucket", (F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") * buckets / (1 << 48)).cast("int"))
    held = d.groupBy("_null", "_src", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_null", "_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    sizes = held.groupBy("_null", "_src").agg(F.sum("_sum").alias("source_size"))
    starts = starts.join(source_targets(sizes, weights, repeats), ["_null", "_src"])
    inside = Window.partitionBy("_null", "_src", "_bucket").orderBy("_key", "_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_end", F.sum("size").over(inside)).join(starts, ["_null", "_src", "_bucket"])
    end = F.col("_start") + F.col("_end")
    served = F.floor(F.col("target") + F.lit(1e-6))  # of the source's queue when the clock stops

    def service(k: Column) -> Column:
        finish = end + F.col("source_size") * k
        return F.struct((finish / F.col("_weight")).alias("virtual_finish"), F.least(F.col("size"), served - finish + F.col("size")).cast("long").alias("words"))

    d = d.withColumn("services", F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), service), lambda s: s["words"] > 0))
    d = d.withColumn("taken", F.aggregate("services", F.lit(0).cast("long"), lambda s, x: s + x["words"])).withColumn("virtual_finish", end / F.col("_weight"))
    return d.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in RESULTS], *RESULTS)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The mixture itself, in order of virtual finish time over all rounds: a row for each time a document is taken, cut where the clock stopped.

    A copy keeps the document's columns; text and n_chars are those of the copy. Texts without a word are not taken.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"), F.col(id_col).alias("_i"), F.col(source_col).alias("_s"), F.col("text"))
    m = mix(packed, id_col="_i", source_col="_s", **how).select("_doc", "text", "size", F.explode("services").alias("_service"))
    # word by word with the white space before each, so that what is cut keeps its form
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.col("_service.words").cast("int")), "")
    m = m.select("_doc", "_service", F.when(F.col("_service.words") < F.col("size"), head).otherwise(F.col("text")).alias("_copy"))
    own = {"text": F.col("_copy"), "n_chars": F.length("_copy").cast("long")}
    return m.orderBy("_service.virtual_finish").select(*[(own[c] if c in own else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def mix_sql(weights: Sequence[int], repeats: int, seed: str) -> str:
    """DuckDB SQL for mix() over documents: a row for each document and round with its virtual finish time, the clock's last time, and what is served by then."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {list(weights)}[1 + (row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % {len(weights)}]::DOUBLE AS weight, source_size * {float(repeats)} AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, (source IS NULL), encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, (source IS NULL), encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
clock AS (SELECT coalesce(first(rest ORDER BY cap / weight, (source IS NULL), encode(source)) FILTER (rest * weight < cap), 'infinity'::DOUBLE) AS stop FROM f),
q AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM d),
c AS (SELECT q.*, w.source_size, w.weight, least(w.cap, clock.stop * w.weight) AS target, stop, (cum + source_size * n) / weight AS finish, cum + source_size * n - size AS begun
  FROM q JOIN w ON q.source IS NOT DISTINCT FROM w.source, clock, unnest(range({repeats})) AS rounds(n)),
t AS (SELECT *, CASE WHEN finish <= stop THEN size ELSE greatest(0, least(size, floor(stop * weight + 1e-6)::BIGINT - begun)) END AS words FROM c)
SELECT any_value(doc_id) AS doc_id, any_value(size)::BIGINT AS size, any_value(source_size) AS source_size, round(any_value(target), 6) AS target, sum(words)::BIGINT AS taken, round(min(finish), 6) AS virtual_finish
FROM t GROUP BY r"""
