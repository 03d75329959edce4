"""Canonical exact digests in DataFrame functions only.

A text's canonical form is its compatibility composition (NFKC), folded in case and white space. Its digest is 128 bits of xxhash. Rows of one
digest are compared byte by byte: the least and the greatest canonical form of a bucket must be the same; where they differ, the members'
fingerprints get a suffix from their SHA-256, so equal fingerprints mean equal canonical texts.

Defined results: null text counts as empty; repeated rows each get their row; a lone document is its own next document; empty tables give no rows.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Ranges whose characters NFKC leaves alone wherever they stand (tests hold them against the Unicode tables).
STABLE = r"\x00-\x7FÀ-ıĴ-ľŁ-ňŊ-žΑ-ΡΣ-ώЀ-҂Ҋ-ԯא-תء-ي‐‒-‖‘-‣ぁ-ゖァ-ヺ一-鿿가-힣"
LEAD, VOWEL, TAIL = "".join(map(chr, range(0x1100, 0x1113))), "".join(map(chr, range(0x1161, 0x1176))), "".join(map(chr, range(0x11A8, 0x11C3)))
SYLLABLES = "".join(map(chr, range(0xAC00, 0xD7A4)))


@functools.cache
def unicode_tables() -> dict[str, dict[str, str]]:
    """From the Unicode database: single characters that NFKC changes, canonical decompositions, compositions of a pair, combining classes."""
    norm = unicodedata.normalize
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c <= 0xD7A3]
    changed = {c: norm("NFKC", c) for c in chars if norm("NFKC", c) != c}
    split = {c: norm("NFD", c) for c in chars if norm("NFD", c) != c and norm("NFC", c) == c}
    pairs = {"".join(map(lambda x: chr(int(x, 16)), unicodedata.decomposition(c).split())): c for c in split if len(unicodedata.decomposition(c).split()) == 2}
    return {"changed": changed, "split": split, "pairs": pairs, "class": {c: str(unicodedata.combining(c)) for c in chars if unicodedata.combining(c)}}


def lookup(table: dict[str, str]) -> Column:
    """A constant map column."""
    sep = "\ue000"
    return F.map_from_arrays(F.split(F.lit(sep.join(table)), sep), F.split(F.lit(sep.join(table.values())), sep))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_class(chars) -> str:
    """The characters as ranges inside a regular expression's brackets."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


def composed_marks(text: Column) -> Column:
    """Canonical order and composition of each run of a character and its marks, in time that grows with a run as sorting does.

    No character is composed of more than `depth` + 1. So of the marks of one class behind a starter only the first `depth` can join it, and of
    the starters behind it likewise; where that many have been passed, a run is cut into pieces that are composed on their own.
    """
    t = unicode_tables()
    split, pairs = lookup(t["split"]), lookup(t["pairs"])
    depth = max(map(len, t["split"].values())) - 1
    marks, joining = char_class(t["class"]), char_class({p[1] for p in t["pairs"]} - set(t["class"]))
    ranks = "".join(chr(0x100 + int(k)) for k in t["class"].values())
    none = F.lit("")

    def decomposed(run: Column) -> Column:
        known = F.filter(F.array_distinct(F.split(run, "")), lambda c: F.map_contains_key(split, c))
        return F.aggregate(known, run, lambda s, c: F.replace(s, c, F.try_element_at(split, c)))

    def ordered(m: Column) -> Column:
        """k, i, c of marks in canonical order: by class, equal ones as they came."""
        return let(F.split(F.translate(m, "".join(t["class"]), ranks), ""), lambda k: F.sort_array(F.transform(F.split(m, ""), lambda c, i: F.struct(F.get(k, i).alias("k"), i.alias("i"), c.alias("c")))))

    def attach(base: Column, m: Column) -> Column:
        """base with what joins it of its marks, and the rest of them in order."""

        def step(s: Column, x: Column) -> Column:
            joined = F.when(s["last"] < x["k"], F.try_element_at(pairs, F.concat(s["base"], x["c"])))
            return let(joined, lambda j: F.when(j.isNotNull(), F.struct(j.alias("base"), s["last"].alias("last"), F.array_append(s["used"], x["i"]).alias("used"))).otherwise(F.struct(s["base"].alias("base"), x["k"].alias("last"), s["used"].alias("used"))))

        def joined(o: Column) -> Column:
            start = F.struct(base.alias("base"), none.alias("last"), F.array().cast("array<int>").alias("used"))
            first = F.filter(o, lambda x, i: (i < depth) | (F.get(o, i - depth)["k"] != x["k"]))
            rest = lambda s: F.array_join(F.transform(F.filter(o, lambda x: ~F.array_contains(s["used"], x["i"])), lambda x: x["c"]), "")
            return let(F.aggregate(first, start, step), lambda s: F.struct(s["base"].alias("base"), rest(s).alias("rest")))

        return F.when(m == "", F.struct(base.alias("base"), none.alias("rest"))).otherwise(let(ordered(m), joined))

    def compose(piece: Column) -> Column:
        def step(s: Column, part: Column) -> Column:
            def added(z: Column) -> Column:
                one = F.when(s["rest"] == "", F.try_element_at(pairs, F.concat(s["base"], z)))
                behind = F.concat(s["done"], s["base"], s["rest"])
                return let(one, lambda j: let(attach(F.coalesce(j, z), F.substring(part, F.length(z) + 1, F.length(part))), lambda a: F.struct(F.when(j.isNotNull(), s["done"]).otherwise(behind).alias("done"), a["base"].alias("base"), a["rest"].alias("rest"))))

            return let(F.regexp_extract(part, rf"(?s)^[^{marks}]?", 0), added)

        parts = F.filter(F.regexp_extract_all(piece, F.lit(rf"(?s)[^{marks}]?[{marks}]*"), F.lit(0)), lambda x: x != "")
        return F.aggregate(parts, F.struct(none.alias("done"), none.alias("base"), none.alias("rest")), step, lambda s: F.concat(s["done"], s["base"], s["rest"]))

    cut = F.lit(rf"(?s)[^{marks}]?[{marks}]*(?:[{joining}][{marks}]*){{0,{depth}}}")
    pieces = lambda r: F.array_join(F.transform(F.regexp_extract_all(decomposed(r), cut, F.lit(0)), compose), "")
    runs = F.regexp_extract_all(text, F.lit(r"(?s)[^\p{M}]?\p{M}+|[^\p{M}]+?(?=[^\p{M}]\p{M})|[^\p{M}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"\p{M}"), pieces(r)).otherwise(r)), "")


def composed_hangul(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"(?s)[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[가-힣][ᆨ-ᇂ]|."), F.lit(0))

    def join(r: Column) -> Column:
        lead, vowel = F.instr(F.lit(LEAD), F.substring(r, 1, 1)), F.instr(F.lit(VOWEL), F.substring(r, 2, 1))
        tail = F.when(F.length(r) == 3, F.instr(F.lit(TAIL), F.substring(r, 3, 1))).otherwise(F.lit(0))
        whole = F.instr(F.lit(SYLLABLES), F.substring(r, 1, 1))
        second = F.instr(F.lit(TAIL), F.substring(r, 2, 1))
        syllable = lambda n: F.substring(F.lit(SYLLABLES), n, F.lit(1))
        fits = (F.length(r) == 2) & (whole > 0) & (second > 0) & ((whole - 1) % 28 == 0)
        return F.when((F.length(r) >= 2) & (lead > 0) & (vowel > 0), syllable((lead - 1) * 588 + (vowel - 1) * 28 + tail + 1)).when(fits, syllable(whole + second)).otherwise(r)

    return F.array_join(F.transform(runs, join), "")


def nfkc_slow(t: Column) -> Column:
    """The compatibility composition of a text that has characters outside STABLE."""
    changed = unicode_tables()["changed"]
    one = {c: d for c, d in changed.items() if len(d) == 1}
    more = F.arrays_zip(F.split(F.lit("\x01".join(c for c in changed if c not in one)), "\x01").alias("c"), F.split(F.lit("\x01".join(d for c, d in changed.items() if c not in one)), "\x01").alias("d"))
    t = F.translate(t, "".join(one), "".join(one.values()))
    t = let(t, lambda x: F.aggregate(F.filter(more, lambda p: x.contains(p["c"])), x, lambda s, p: F.replace(s, p["c"], p["d"])))
    t = let(t, lambda x: F.when(x.rlike(r"\p{M}"), composed_marks(x)).otherwise(x))
    return let(t, lambda x: F.when(x.rlike(r"[ᅡ-ᅵᆨ-ᇂ]"), composed_hangul(x)).otherwise(x))


def is_plain(text: Column) -> Column:
    """Whether a text is ASCII, or at least of STABLE characters: nearly all are, and take no more than this look."""
    return (F.octet_length(text) == F.length(text)) | ~text.rlike(rf"(?![{STABLE}])[^\x00-\x7F]")


def nfkc(text: Column) -> Column:
    """The compatibility composition of a text."""
    return let(text, lambda t: F.when(is_plain(t), t).otherwise(nfkc_slow(t)))


#: White space besides blank, tabulator and line ends, in ASCII and beyond.
RARE_SPACE = r"[\x0B\x0C\x1C-\x1F]"
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def canonical(text: Column) -> Column:
    """NFKC, then case and white space folded; null counts as empty. Each step is taken once, on the step before, and costly ones only where a look finds need."""
    blank = F.lit(" ")
    wide = lambda t: F.regexp_replace(nfkc_slow(t), WIDE_SPACE, " ")
    t = let(F.coalesce(text, F.lit("")), lambda x: F.when(is_plain(x), x).otherwise(wide(x)))
    t = F.replace(F.replace(F.replace(F.upper(t), F.lit("\n"), blank), F.lit("\t"), blank), F.lit("\r"), blank)
    t = let(t, lambda x: F.when(x.rlike(RARE_SPACE), F.regexp_replace(x, RARE_SPACE, " ")).otherwise(x))
    t = let(t, lambda x: F.when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x))
    return let(F.lower(F.trim(t)), lambda x: F.when(x.contains("ς"), F.replace(x, F.lit("ς"), F.lit("σ"))).otherwise(x))


def wide_hash(form: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits: two 64-bit hashes, the second of the form behind a fixed prefix."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second half"), form)), 16, "0")))


def digest_of(text: Column) -> Column:
    """Struct of a text's digest and the suffix that it gets if its bucket is uneven."""
    return let(canonical(text), lambda f: F.struct(wide_hash(f).alias("digest"), F.substring(F.sha2(f, 256), 1, 16).alias("suffix")))


def uneven_buckets(forms: DataFrame) -> DataFrame:
    """digest of the buckets (columns digest, form) whose forms aren't all the same bytes."""
    return forms.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("most")).where("least <> most").select("digest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint for each row: equal for texts of one canonical form, and for no others."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest_of(F.col(text_col)).alias("own"))
    uneven = uneven_buckets(d.select(F.col("own.digest").alias("digest"), canonical(F.col("text")).alias("form"))).withColumn("uneven", F.lit(True))
    return d.select("doc_id", "own.*").join(uneven, "digest", "left").select("doc_id", named().alias("fingerprint"))


def named() -> Column:
    return F.when(F.col("uneven"), F.concat("digest", F.lit("-"), "suffix")).otherwise(F.col("digest"))


KEY = ["k0", "k1", "k2"]


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text (last third replaced by the start of the next document, in descending id order),
    and whether they, or it and the next document's, are alike (an exact digest: 1 or 0).

    Texts move once, by id, and a third of them again; digests and the order of ids are in a range-partitioned table without texts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # ascending keys are descending ids, nulls last; the id comes back from the key, so all uses of the dealt texts are one exchange
    keyed = docs.select(text.alias("text"), F.col(id_col).isNull().alias("k0"), F.bitwise_not(F.coalesce(F.col(id_col), F.lit(0)).cast("long")).alias("k1"), F.xxhash64(text).alias("k2"))
    small = keyed.select(*KEY, F.length("text").cast("long").alias("n"), digest_of(F.col("text")).alias("own")).groupBy(*KEY).agg(F.max("n").alias("n"), F.max("own").alias("own"), F.count("*").alias("times"))
    small = staged(small.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()))
    row = F.struct(*KEY, "own")
    heads = small.groupBy("part").agg(F.min(row).alias("head"))
    after = heads.withColumn("follow", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy()))).select("part", "follow")  # a row per partition
    nexts = small.select(*KEY, "n", "own", "part", F.lead(row).over(Window.partitionBy("part").orderBy(*KEY)).alias("here")).join(after, "part").withColumn("next", F.coalesce("here", "follow"))
    wanted = nexts.select(*[F.col(f"next.{k}").alias(k) for k in KEY], F.struct(*KEY, "own", F.col("next.own").alias("follow")).alias("to"), F.floor(F.col("n") / 3).cast("int").alias("need"))

    dealt = keyed.repartition(parts, *KEY)
    given = dealt.join(wanted, KEY).select(F.expr("substring(text, 1, need)").alias("head"), "to")
    given = given.groupBy(*[F.col(f"to.{k}").alias(k) for k in KEY]).agg(F.min(F.struct("head", F.col("to.own").alias("own"), F.col("to.follow").alias("follow"))).alias("g"))
    rows = dealt.join(given, KEY)
    edited = F.expr("concat(substring(text, 1, cast(length(text) - length(text) div 3 as int)), g.head)")
    same = lambda f: F.when(wide_hash(f) == F.col("g.own.digest"), f == canonical(F.col("text"))).otherwise(F.lit(False))
    seen = let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), let(canonical(e), lambda f: F.struct(wide_hash(f).alias("digest"), same(f).alias("same"))).alias("form")))
    doc_id = F.when(~F.col("k0"), F.bitwise_not("k1")).alias("doc_id")
    # the few uneven digests are looked up by key: a digest that a third of all texts share stays dealt over its rows
    shared = small.groupBy("own.digest").agg(F.sum("times").alias("times")).where("times > 1").select("digest")
    doubled = small.select(*KEY, F.col("own.digest").alias("digest")).join(shared, "digest", "left_semi")
    uneven = uneven_buckets(dealt.join(doubled, KEY).select("digest", canonical(F.col("text")).alias("form")))
    marked = doubled.join(uneven, "digest", "left_semi").select(*KEY, F.lit(True).alias("uneven"))
    rows = rows.select(*KEY, doc_id, F.length("text").cast("long").alias("n_chars"), seen.alias("e"), F.col("g.own.digest").alias("digest"), F.col("g.own.suffix").alias("suffix"), (F.col("g.own") == F.col("g.follow")).cast("double").alias("near_next"))
    rows = rows.join(marked, KEY, "left")
    return rows.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), named().alias("fingerprint"), F.col("e.form.digest").alias("edited_fingerprint"), F.col("e.form.same").cast("double").alias("near_edited"), "near_next")
