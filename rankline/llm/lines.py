"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared as word sequences (lower case, white space collapsed). Two lines are near
duplicates if they are equal, or if both have at least ``MIN_WORDS`` words and one word
changed, added or left out turns one into the other (of 5 words, 4 are then alike). A line goes if
an earlier line, in order of (doc_id, line number), is its duplicate.

1. Equal lines are one class with its first place, by a grouped minimum.
2. An edit leaves the first or the last half of the shorter line untouched. Only classes
   that share such a half with another class go on; no pair is lost.
3. Each such class emits its deletion variants as hashed keys: for every position, what is
   before and after the word there, and before and after the gap there. All lines with one
   key are within one edit of each other, so a grouped minimum of first places, never a
   pair list, gives each line its earliest neighbour.
4. The word edit distance to that neighbour is verified on the words themselves.

Defined cases: lines without a word are never dropped; a null text keeps its null; a null
doc_id comes after all others; among rows of one id with different texts a hash of the text
decides, and rows that repeat id and text keep or lose the same lines; further columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankline.llm.common import BROADCAST_ROWS, free_names, own_columns, row_key, table

MIN_WORDS = 5
LAST = (1 << 63) - 1  # the place of rows without an id


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line that has a word: doc, __th (names the row's text), line, norm, its
    two hashes and word count."""
    text = F.regexp_replace(F.lower("text"), r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")
    d = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), row_key()[1], F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    d = d.select("doc", "__th", "line", F.trim("raw").alias("norm")).where("norm <> ''")
    return d.select("doc", "__th", "line", "norm", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"),
                    (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).alias("n"))


def _halves(n: Column) -> Column:
    """Keys of the first and the last n // 2 words and, for an even n, of one word less on
    each side (the half of a partner that is one word shorter)."""
    def part(q: Column) -> Column:  # q words from the left or, if negative, from the right
        return F.xxhash64(q, F.call_function("substring_index", F.col("norm"), F.lit(" "), q))

    def both(q: Column) -> list[Column]:
        return [part(q), part(-q)]

    half = F.floor(n / 2).cast("int")
    return F.when(n < MIN_WORDS, F.array().cast("array<long>")).when(n % 2 == 0, F.array(*both(half), *both(half - 1))).otherwise(F.array(*both(half)))


def classes(lines: DataFrame) -> DataFrame:
    """(h1, h2, first, n, keys): one row per distinct line, with its first place and count."""
    return lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line", "__th")).alias("first"), F.count("*").alias("n"), F.any_value("keys").alias("keys"))


def variants(words: DataFrame) -> DataFrame:
    """(first, key): the deletion variants of every line of ``words`` (first, w); a class is
    named by its first place."""
    tokens = words.select("first", F.size("w").alias("n"), F.posexplode("w").alias("i", "x"))
    tokens = tokens.select("first", "n", "i", F.xxhash64("x", "i").alias("ahead"), F.xxhash64("x", F.col("n") - F.col("i")).alias("behind"))
    line = Window.partitionBy("first")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    left = tokens.select("first", "n", "i", F.coalesce(F.bit_xor("ahead").over(upto), nothing).alias("before"), "ahead", "behind",
                         F.bit_xor("behind").over(line).bitwiseXOR(F.coalesce(F.bit_xor("behind").over(upto), nothing)).alias("from"))
    keys = F.array(F.xxhash64("before", F.col("from").bitwiseXOR(F.col("behind"))), F.xxhash64("before", "from"))
    at_end = F.array(F.xxhash64(F.col("before").bitwiseXOR(F.col("ahead")), nothing))
    keys = F.when(F.col("i") == F.col("n") - 1, F.concat(keys, at_end)).otherwise(keys)
    return left.select("first", F.explode(keys).alias("key"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one word changed, added or left out turns ``a`` into ``b`` (word arrays)."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True).cast("int")
    rest = F.least(F.size(a), F.size(b)) + 1

    def tail(w: Column, start: Column) -> Column:
        return F.slice(w, start, rest)

    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    changed = tail(a, at + 1) == tail(b, at + 1)
    added = tail(longer, at + 1) == tail(shorter, at)
    return F.when(at == 0, F.lit(True)).when(F.size(a) == F.size(b), changed).when(F.abs(F.size(a) - F.size(b)) == 1, added).otherwise(F.lit(False))


def near_classes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(first, best): classes with an earlier class within one edit, and its first place."""
    keys = found.select("first", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    near = table(keys.join(shared, "key").select("first").distinct(), "near")
    homes = table(near.select(F.col("first.doc").alias("__id")).distinct(), "homes")
    some = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("__id"), "doc_id", "text")
    if homes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # else all lines are joined, which needs no more shuffles
        some = some.join(F.broadcast(homes), "__id", "left_semi")
    lines = lines_of(some).select(F.struct("doc", "line", "__th").alias("first"), "norm").join(near, "first")
    words = table(lines.groupBy("first").agg(F.split(F.any_value("norm"), " ").alias("w")), "words")
    keyed = variants(words)
    low = keyed.groupBy("key").agg(F.min("first").alias("best"), F.count("*").alias("n")).where("n > 1")
    hits = keyed.join(low.select("key", "best"), "key").where("best < first")
    best = table(hits.groupBy("first").agg(F.min("best").alias("best")), "best")
    other = words.select(F.col("first").alias("best"), F.col("w").alias("v"))
    return words.join(best, "first").join(other, "best").where(within_one_edit(F.col("w"), F.col("v"))).select("first", "best")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc, __th, line, kept_doc, kept_line) of every line that goes, with the earlier line."""
    lines = table(lines_of(docs).select("doc", "__th", "line", "h1", "h2", _halves(F.col("n")).alias("keys")), "lines")
    found = table(classes(lines), "classes")
    near = table(near_classes(docs, found), "near_classes")
    verdict = found.select("h1", "h2", "first", "n").join(near, "first", "left").where("n > 1 or best is not null")
    verdict = verdict.select("h1", "h2", F.coalesce("best", "first").alias("kept"))
    out = lines.drop("keys").join(verdict, ["h1", "h2"]).where("struct(doc, line, __th) > kept")
    return out.select("doc", "__th", "line", F.nullif(F.col("kept.doc"), F.lit(LAST)).alias("kept_doc"), F.col("kept.line").alias("kept_line"))


def deduplicated(docs: DataFrame, gone: str = "__gone", kept_in: str = "__kept_in") -> DataFrame:
    """``docs`` with the remaining lines as text (and n_chars, where there is one, counted
    anew), and with the columns ``gone`` (line numbers) and ``kept_in`` (doc_ids of the earlier
    lines), names that ``docs`` must not have; both are null where no line goes."""
    lost = table(dropped_lines(docs), "gone").groupBy("doc", "__th").agg(
        F.sort_array(F.collect_set("line")).alias("gone"), F.sort_array(F.collect_set("kept_doc")).alias("kept_in"))
    key, th, ends, parts = free_names(docs, "__id", "__th", "__ends", "__parts")
    lost = lost.select(F.col("doc").alias(key), F.col("__th").alias(th), F.col("gone").alias(gone), F.col("kept_in").alias(kept_in))
    keyed = docs.withColumns({key: F.coalesce("doc_id", F.lit(LAST)), th: row_key()[1]})
    d = keyed.join(lost, [key, th], "left")
    split = F.split("text", "\n")
    d = d.withColumns({ends: F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(split))), parts: split})
    runs = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(
        parts, F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1))
    text = F.when(F.col(gone).isNotNull(), F.array_join(F.flatten(runs), "\n")).otherwise(F.col("text"))
    d = d.withColumn("text", text)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*own_columns(docs), gone, kept_in)


def filtered(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining lines as text, and no further columns."""
    return deduplicated(docs, *free_names(docs, "__gone", "__kept_in")).select(*own_columns(docs))
