"""Quality rules by distribution divergence, in DataFrame functions only.

Per document, two histograms are compared with references of its language by Jensen-Shannon
distance (base 2, 0 to 1): character classes, and the language's commonest words (all other
words together are one more bin). References are counted over all documents that pass the
base rules. A test applies only to texts long enough for it (minimum-length guards).

Defined cases: a null or word-less text has zero counts and fails the base rule; a null
language is a language of its own; rows that repeat an id are judged one by one; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankline.llm.common import WORD_BREAK, row_key, small_join, table, whole_key, without

# Runs of one class, removed one after the other so that each scan is of what is left.
CLASSES = [("lower", r"[a-z]+"), ("space", WORD_BREAK), ("upper", r"[A-Z]+"), ("digit", r"[0-9]+"),
           ("point", r"[.,;:!?'\"()\-]+"), ("symbol", r"[#*$%&|<>]+"), ("letter", r"\p{L}+"), ("other", None)]
COMMON_WORDS = 24
COMMON_LENGTH = 6  # letters of a common word at most
MIN_CHARS, MIN_WORDS = 250, 100
MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE = 0.25, 0.33


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters, as an array that may hold one empty string at an end."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), " ")


def common_words(docs: DataFrame, k: int = COMMON_WORDS, longest: int = COMMON_LENGTH) -> DataFrame:
    """(lang, vocab): each language's ``k`` commonest words, ties to the smaller word."""
    words = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(plain_words(F.coalesce("text", F.lit("")))).alias("w"))
    counts = words.where((F.length("w") > 0) & (F.length("w") <= longest)).groupBy("lang", "w").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    top = counts.withColumn("r", rank).where(F.col("r") <= k)
    return top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("vocab"))


def measures(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Base counts and both histograms of every row."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", row_key()[1], text.alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    d = small_join(d, vocab, ["lang"], "left")
    rest, sizes = F.col("text"), [F.length("text")]
    for i, (_, runs) in enumerate(CLASSES[:-1]):
        d = d.withColumn(f"t{i}", F.regexp_replace(rest, runs, ""))
        rest = F.col(f"t{i}")
        sizes.append(F.length(rest))
    chars = F.array(*[sizes[i] - sizes[i + 1] for i in range(len(CLASSES) - 1)], sizes[-1])
    d = d.select("doc_id", "__th", "lang", "text", "vocab", chars.cast("array<long>").alias("chars"))
    d = d.withColumn("w", F.array_remove(F.split("text", WORD_BREAK), "")).withColumn("n_words", F.size("w").cast("long"))
    w, n = F.col("w"), F.col("n_words").cast("int")

    def joined(a: Column, b: Column) -> Column:  # hashes of runs, each with the run that follows it
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    d = d.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    d = d.withColumn("h2", joined(F.col("h1"), F.slice("h1", F.lit(2), n)))
    d = d.withColumn("h4", joined(F.col("h2"), F.slice("h2", F.lit(3), n)))
    windows = F.slice(joined(F.col("h4"), F.slice("h1", F.lit(5), n)), F.lit(1), n - 4)
    d = d.withColumn("h", F.when(n >= 6, windows))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(repeats, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("s")
    twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
    d = d.withColumn("at", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda e: e["i"]))))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    d = d.withColumn("lines", lines).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    d = d.withColumn("plain", F.array_remove(plain_words(F.col("text")), ""))
    known = F.transform(F.filter("plain", lambda x: F.length(x) <= COMMON_LENGTH), lambda x: F.array_position("vocab", x).cast("int"))
    d = d.withColumn("known", F.sort_array(F.array_remove(F.coalesce(known, F.array().cast("array<int>")), 0)))
    ends = F.transform("known", lambda x, i: F.struct(x.alias("k"), (i + 1).alias("upto"), F.coalesce(F.get("known", i + 1), F.lit(0)).alias("next")))
    d = d.withColumn("ends", F.filter(ends, lambda e: e["k"] != e["next"]))
    d = d.withColumn("bins", F.transform("ends", lambda e: e["k"]))
    at_bin = F.transform(F.sequence(F.lit(1), F.coalesce(F.size("vocab"), F.lit(0)) + 1), lambda k: F.array_position("bins", k).cast("int"))
    counts = F.transform(at_bin, lambda j: F.when(j == 0, F.lit(0)).otherwise(
        F.get("ends", j - 1)["upto"] - F.when(j > 1, F.get("ends", j - 2)["upto"]).otherwise(F.lit(0))))
    return d.select(
        "doc_id", "__th", "lang", "n_words", F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_chars"),
        F.get("chars", F.lit(5)).alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "chars", F.when(F.size("vocab") > 0, F.concat(F.slice(counts, F.lit(1), F.size("vocab")), F.array(F.size("plain") - F.size("known")))).cast("array<long>").alias("common"),
    ).withColumn("word_chars", F.col("n_chars") - F.get("chars", F.lit(1))) \
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def references(measured: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_common): summed histograms of the rows that pass the base rules."""
    def total(name: str, size: int) -> Column:
        return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)])

    return measured.where(~F.col("base_failed")).groupBy("lang").agg(
        total("chars", len(CLASSES)).alias("ref_chars"), total("common", COMMON_WORDS + 1).alias("ref_common"))


def divergence(counts: Column, ref: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if one of them counts nothing."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0)).cast("double"))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    both = F.zip_with(counts, ref, lambda x, y: F.struct(
        (F.coalesce(x, F.lit(0)) / F.nullif(total(counts), F.lit(0.0))).alias("p"), (F.coalesce(y, F.lit(0)) / F.nullif(total(ref), F.lit(0.0))).alias("q")))
    js = F.aggregate(both, F.lit(0.0), lambda s, e: s + part(e["p"], e["q"]) / 2 + part(e["q"], e["p"]) / 2)
    ok = (total(counts) > 0) & (total(ref) > 0)
    return F.when(ok, F.sqrt(F.greatest(js, F.lit(0.0))))


def judge(docs: DataFrame, max_chars: float = MAX_CHARS_DISTANCE, max_words: float = MAX_WORDS_DISTANCE) -> DataFrame:
    """Counts, distances and verdict of every row of ``docs`` (doc_id, text, lang)."""
    return _judged(docs, max_chars, max_words).drop("lang")


def _judged(docs: DataFrame, max_chars: float = MAX_CHARS_DISTANCE, max_words: float = MAX_WORDS_DISTANCE) -> DataFrame:
    vocab = table(common_words(docs), "vocab")
    measured = table(measures(docs, vocab), "measured")
    refs = table(references(measured), "references")
    d = small_join(measured, refs, ["lang"], "left")
    d = d.withColumn("js_chars", F.when(F.col("word_chars") >= MIN_CHARS, divergence(F.col("chars"), F.col("ref_chars")))) \
        .withColumn("js_words", F.when(F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x) >= MIN_WORDS, divergence(F.col("common"), F.col("ref_common"))))
    far = (F.coalesce("js_chars", F.lit(0.0)) > max_chars) | (F.coalesce("js_words", F.lit(0.0)) > max_words)
    return d.select("doc_id", "__th", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ~far).alias("kept"), "js_chars", "js_words")


def filtered(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    key = whole_key()
    gone = _judged(docs).where(~F.col("kept")).select(key[0], "__th", key[2], F.col("lang").alias("__lang"))  # the verdict depends on text and language
    return without(docs, table(gone, "dropped"), __lang=F.coalesce("lang", F.lit("")))
