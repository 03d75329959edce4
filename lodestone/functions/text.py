"""Text expressions: hashing, simple tokenizers, truncation, padding, sentence and paragraph chunks, model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col, let

#: Characters that are tokens of their own.
PUNCTUATION = r""",.!?;:"'()\[\]{}"""
LIMB = 4294967296


def text_hash(text: Column | str) -> Column:
    """SHA-256 of the text in lower case, trimmed, its white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " ")), 256)


def simple_tokens(text: Column | str, special: bool = False) -> Column:
    """Runs without white space, punctuation marks apart; [CLS] and [SEP] around them if asked for."""
    t = F.regexp_extract_all(col(text), F.lit(rf"([{PUNCTUATION}]|[^\s{PUNCTUATION}]+)"), F.lit(1))
    return F.concat(F.array(F.lit("[CLS]")), t, F.array(F.lit("[SEP]"))) if special else t


def basic_tokens(text: Column | str, lowercase: bool = True) -> Column:
    """Lower-cased runs; every punctuation or symbol character is a token."""
    t = F.lower(col(text)) if lowercase else col(text)
    return F.regexp_extract_all(t, F.lit(r"([\p{P}\p{S}]|[^\s\p{P}\p{S}]+)"), F.lit(1))


def djb2_id(token: Column | str, buckets: int = 100_000) -> Column:
    """djb2 over the UTF-8 bytes, 64 bits wrapping, modulo buckets. Two 32-bit limbs keep clear of overflow errors."""
    # conv reads at most 64 bits, so a byte is read from its two hexadecimal digits
    digits = F.hex(F.encode(col(token), "utf-8"))
    at = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(5381).cast("long").alias("lo"))
    count = (F.length(digits) / 2).cast("int")

    def step(s: Column, i: Column) -> Column:
        low = s["lo"] * 33 + at(i)
        return F.struct((F.expr("1L") * (s["hi"] * 33 + F.floor(low / LIMB)) % LIMB).alias("hi"), (low % LIMB).alias("lo"))

    done = F.aggregate(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), start, step)
    return let(done, lambda s: ((s["hi"] % buckets) * (LIMB % buckets) + s["lo"]) % buckets)


def truncate(tokens: Column | str, length: int, how: str = "end") -> Column:
    """At most `length` tokens: the first (end), the last (start), or half from each side (middle); none raises on longer input."""
    t, n = col(tokens), F.size(col(tokens))
    head = length // 2
    cut = {
        "end": lambda: F.slice(t, F.lit(1), F.lit(length)),
        "start": lambda: F.slice(t, n - length + 1, F.lit(length)),
        "middle": lambda: F.concat(F.slice(t, F.lit(1), F.lit(head)), F.slice(t, n - (length - head) + 1, F.lit(length - head))),
        "none": lambda: F.when(F.raise_error(F.lit(f"input is longer than {length} tokens")).isNull(), t),
    }[how]()
    return F.when(n > length, cut).otherwise(t)


def pad(ids: Column | str, length: Column | int, pad_id: int = 0) -> Column:
    """Struct of ids padded to length and their mask."""
    t = col(ids)
    more = F.greatest(F.lit(0), (F.lit(length) if isinstance(length, int) else length) - F.size(t))
    return F.struct(F.concat(t, F.array_repeat(F.lit(pad_id).cast("int"), more)).alias("ids"), F.concat(F.transform(t, lambda x: F.lit(1)), F.array_repeat(F.lit(0), more)).alias("mask"))


def sentences(text: Column | str) -> Column:
    """Pieces up to and with each . ! or ?, trimmed of blanks, empty ones left out."""
    parts = F.regexp_extract_all(col(text), F.lit(r"([^.!?]*[.!?]|[^.!?]+)"), F.lit(1))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), "\n\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def windowed(parts: Column, count: int, keep: int, sep: str, least: int) -> Column:
    """Chunks of `count` parts that share `keep` with the one before. What is left after the last full chunk (kept parts and later ones) is a chunk
    of its own if it has `least` characters or is the only one, else it is joined to the last chunk."""
    stride = count - keep

    def build(p: Column) -> Column:
        n = F.size(p)
        full = F.when(n >= count, F.floor((n - count) / stride).cast("int") + 1).otherwise(F.lit(0))
        chunks = F.when(full > 0, F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.array_join(F.slice(p, i * stride + 1, F.lit(count)), sep))).otherwise(F.array().cast("array<string>"))
        rest = F.array_join(F.slice(p, full * stride + 1, F.greatest(n - full * stride, F.lit(0))), sep)
        tail = F.when(rest == "", chunks).when((F.length(rest) >= least) | (full == 0), F.concat(chunks, F.array(rest))).otherwise(F.concat(F.slice(chunks, F.lit(1), full - 1), F.array(F.concat(F.element_at(chunks, -1), F.lit(sep), rest))))
        return F.when(n > 0, tail)

    return let(parts, build)


def chunk_sentences(text: Column | str, count: int, overlap: int = 50, least: int = 10) -> Column:
    """Chunks of `count` sentences; overlap characters stand for max(1, overlap / 50) sentences. A text without any is its own chunk."""
    t = col(text)
    keep = min(max(1, overlap // 50), count - 1)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.coalesce(windowed(sentences(t), count, keep, " ", least), F.array(t)))


def chunk_paragraphs(text: Column | str, count: int, overlap: int = 50, least: int = 10) -> Column:
    t = col(text)
    keep = 1 if overlap > 0 else 0
    chunks = pairs_of_paragraphs(paragraphs(t), least) if count == 1 and keep else windowed(paragraphs(t), count, keep, "\n\n", least)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.coalesce(chunks, F.array(t)))


def pairs_of_paragraphs(parts: Column, least: int) -> Column:
    """What chunks of one paragraph that keep one come to: the first, each two that follow one another, and the last as the tail."""

    def build(p: Column) -> Column:
        n, last = F.size(p), F.element_at(p, -1)
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.get(p, i), F.lit("\n\n"), F.get(p, i + 1)))).otherwise(F.array().cast("array<string>"))
        chunks = F.concat(F.slice(p, F.lit(1), F.lit(1)), pairs)
        joined = F.concat(F.slice(chunks, F.lit(1), n - 1), F.array(F.concat(F.element_at(chunks, -1), F.lit("\n\n"), last)))
        return F.when(n > 0, F.when(F.length(last) >= least, F.concat(chunks, F.array(last))).otherwise(joined))

    return let(parts, build)


def parse_model_id(text: Column | str) -> Column:
    """Struct of provider, name, variant and version of provider/name[-variant]@version."""
    t = col(text)
    full = F.regexp_extract(t, r"^[^/]*/(.*)@[^@]*$", 1)
    return F.struct(F.regexp_extract(t, r"^([^/]*)/", 1).alias("provider"), F.when(full.contains("-"), F.regexp_extract(full, r"^(.*)-[^-]*$", 1)).otherwise(full).alias("name"), F.when(full.contains("-"), F.regexp_extract(full, r"-([^-]*)$", 1)).alias("variant"), F.regexp_extract(t, r"@([^@]*)$", 1).alias("version"))


def format_model_id(provider: Column, name: Column, variant: Column, version: Column) -> Column:
    return F.concat(provider, F.lit("/"), name, F.when(variant.isNotNull(), F.concat(F.lit("-"), variant)).otherwise(F.lit("")), F.lit("@"), version)


def duration(seconds: Column) -> Column:
    """Duration for people: microseconds, milliseconds or seconds with one digit after the point."""
    return F.when(seconds < 0.001, F.format_string("%.1fµs", seconds * 1e6)).when(seconds < 1, F.format_string("%.1fms", seconds * 1e3)).otherwise(F.format_string("%.1fs", seconds))
