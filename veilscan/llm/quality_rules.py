"""Quality rules: counts of words, symbols and repeats, and the divergence from a language's own histograms. Native only.

Two histograms of each document, of character classes and of common words, are compared with those of its language by
the Jensen-Shannon distance (base 2: 0 for equal histograms, 1 for disjoint ones). The references are the sums over all
documents of the language that pass the base rules and are long enough. Short documents are not compared.
All of it is computed within a row; only the references, one row for each language, are gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, materialize, own, own_name, table

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]+"
POINTS, DIGITS, UPPER = ".,;:!?'\"()/_-", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Also end a common word, besides spaces.
POINTS_AS_GAPS = ".,;:!?"
#: A window's place in its text takes so many bits: the most that an array can hold.
PLACE_BITS = 31
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents of fewer words are neither compared nor part of a reference.
COMPARE_WORDS = 100
#: A document whose distance is over either of these is not kept.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.2, 0.23
#: Very common words of each language; the frequencies are those of the corpus.
COMMON_WORDS: Mapping[str, Sequence[str]] = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "on", "are"),
    "fr": ("de", "la", "le", "les", "et", "des", "en", "un", "une", "que", "qui", "dans"),
    "de": ("der", "die", "und", "in", "das", "von", "zu", "den", "mit", "ist", "nicht", "ein"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "por", "un", "con"),
}
CLASSES = ("letters", "upper", "digits", "spaces", "points", "symbols", "other_bytes")
#: References up to so many languages are broadcast; more are joined by shuffling.
BROADCAST_LANGUAGES = 10_000


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def one_of(chars: str) -> str:
    """A pattern for runs of these characters."""
    return "[" + "".join(c if c.isalnum() else "\\" + c for c in chars) + "]+"


def window_places(words: str, packed: str, bits: int) -> Column:
    """Places, in order, of the 3-word windows that occur twice or more.

    `packed` is sorted and holds, for each window, the high bits of its hash and its place in the low `bits`: equal
    windows are neighbours. Whole 64-bit hashes decide. Where a window lies between others that merely share its high
    bits, which is rare, all of the text's windows are looked through for its twin.
    """
    mask = (1 << bits) - 1
    p = F.col(packed)
    place = lambda x: x.bitwiseAND(mask).cast("int")
    hashed = lambda i: F.xxhash64(F.col(words)[i], F.col(words)[i + 1], F.col(words)[i + 2])
    near = lambda x, y: x.bitwiseAND(~mask) == y.bitwiseAND(~mask)
    same = lambda x, y: hashed(place(x)) == hashed(place(y))
    last = F.size(packed) - 1

    def recurs(x: Column, i: Column) -> Column:
        before, after = F.when(i > 0, p[i - 1]), F.when(i < last, p[i + 1])
        close = lambda y: F.coalesce(near(x, y), F.lit(False))
        twin = F.when(close(before), same(x, before)).otherwise(False) | F.when(close(after), same(x, after)).otherwise(False)
        return F.when(close(before) | close(after), twin | F.exists(p, lambda y: near(x, y) & (x != y) & same(x, y))).otherwise(False)

    seen = F.filter(p, recurs)
    return F.sort_array(F.transform(seen, place))


def document_features(docs: DataFrame, text: str = "text", lang: str = "lang", words: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """`docs` without its text, with the counts and the two histograms of each row.

    A null text counts as empty. No word is compared across documents and nothing is shuffled. Sorting the windows of a
    text takes n log n in its words. Columns of the same names in `docs` are replaced.
    """
    kept = kept_columns(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_counts", "word_counts", text)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{lang}`").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumns({"_w": F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), "_lines": lines, "_l": F.split(F.lower("_t"), rf"[\x20\x09-\x0D{POINTS_AS_GAPS}]+")})
    n = F.size("_w")
    pack = lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2]).bitwiseAND(~((1 << PLACE_BITS) - 1)).bitwiseOR(i.cast("long"))
    common = reduce(lambda rest, one: F.when(F.col("lang") == one, F.filter("_l", lambda w: w.isin(*words[one]))).otherwise(rest), words, F.lit(None).cast("array<string>"))
    # Cutting out what is rare is the cheapest way to count it.
    removed = {name: F.char_length(F.regexp_replace("_t", chars, "")).cast("long").alias(name) for name, chars in (("_symbols", one_of(SYMBOLS)), ("_points", one_of(POINTS)), ("_digits", "[0-9]+"), ("_upper", "[A-Z]+"))}
    removed = {"_spaces": F.char_length(without(F.col("_t"), SPACES)).cast("long").alias("_spaces")} | removed
    size, octets = F.char_length("_t").cast("long"), F.octet_length("_t").cast("long")
    df = df.select(
        "row", "lang", "_w", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), pack))).alias("_p"), common.alias("_common"), size.alias("_chars"), octets.alias("_octets"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), (F.size("_l") - F.size(F.array_remove("_l", ""))).alias("_gaps"), F.size("_l").alias("_plain"),
        *removed.values(),
    )
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("_p",)], F.when(F.size("_p") > 1, window_places("_w", "_p", PLACE_BITS)).alias("_d"))
    covered = F.when(F.size("_d") > 0, F.aggregate("_d", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])).otherwise(0)
    spaces, symbols, points, digits, upper = (F.col("_chars") - F.col(c) for c in removed)
    letters = F.col("_chars") - spaces - symbols - points - digits - upper
    class_counts = F.array(letters, upper, digits, spaces, points, symbols, F.col("_octets") - F.col("_chars"))
    tally = lambda one: F.array(*[(F.size("_common") - F.size(F.array_remove("_common", w))).cast("long") for w in words[one]], (F.col("_plain") - F.col("_gaps") - F.size("_common")).cast("long"))
    word_counts = reduce(lambda rest, one: F.when(F.col("lang") == one, tally(one)).otherwise(rest), words, F.lit(None).cast("array<bigint>"))
    df = df.select("row.*", n.cast("long").alias("n_words"), F.col("_spaces").alias("word_chars"), symbols.alias("n_symbols"), "n_dup_lines", covered.cast("long").alias("n_repeat_words"), class_counts.alias("class_counts"), word_counts.alias("word_counts"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts of equal length; null if either is null or all zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    share = lambda x: F.transform(x, lambda v: v / total(x))
    both = F.zip_with(share(p), share(q), lambda a, b: 0.5 * term(a, (a + b) / 2) + 0.5 * term(b, (a + b) / 2))
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), total(both))))


def language_references(features: DataFrame, lang: str = "lang") -> DataFrame:
    """The summed histograms, a row for each language: its name and both of them, in columns of the operator's own."""
    used = features.where(~F.col("base_failed") & (F.col("n_words") >= COMPARE_WORDS) & F.col(lang).isNotNull())
    most = max(len(w) for w in COMMON_WORDS.values()) + 1
    sums = [F.sum(F.get("class_counts", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("word_counts", F.lit(i))).alias(f"w{i}") for i in range(most)]
    seen = lambda c, n: F.filter(F.array(*[F.col(f"{c}{i}") for i in range(n)]), lambda x: x.isNotNull())
    return used.groupBy(F.col(f"`{lang}`").alias(own_name("lang"))).agg(*sums).select(own_name("lang"), seen("c", len(CLASSES)).alias(own_name("class")), seen("w", most).alias(own_name("word")))


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` without its text, with the counts, base_failed, both distances and kept.

    Null and empty texts have no words and fail the base rules. A document of fewer than COMPARE_WORDS words, or of a
    null or unknown language, or of one without any reference, is kept if it passes the base rules. Its distances are
    null where nothing is compared. Repeated rows are judged each, and an empty table stays empty. Columns that are named
    like an output are replaced, whatever their case; names that differ in case only are refused (ValueError).
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in kept_columns(docs, "class_distance", "word_distance", "kept")])
    features = materialize(document_features(docs, text, lang), "quality-features")
    references = materialize(language_references(features, lang), "quality-references")
    if references.count() <= BROADCAST_LANGUAGES:
        references = F.broadcast(references)
    joined = features.join(references, F.col(f"`{lang}`") == own("lang"), "left")
    long_enough = F.col("n_words") >= COMPARE_WORDS
    # Both histograms of a row come from its own language's lists, so their lengths agree.
    joined = joined.withColumn("class_distance", F.when(long_enough, divergence(F.col("class_counts"), own("class"))))
    joined = joined.withColumn("word_distance", F.when(long_enough, divergence(F.col("word_counts"), own("word"))))
    odd = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return joined.withColumn("kept", ~F.col("base_failed") & ~odd).drop(*map(own_name, ("lang", "class", "word")))


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base_failed, distances and kept of every row of `documents`. Null and empty texts have no words and fail,
    repeated rows are judged each, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 9).alias("class_distance"), F.round("word_distance", 9).alias("word_distance"))
