"""Line-first quality rules, in DataFrame operations only; every row is judged on its own, so nothing is exchanged.

Each line is tested for punctuation, navigation and boilerplate; lines that fail are taken out, and a document that loses
too many of its words with them is rejected.  Whole-text measures (words, symbols, repeats) come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line ends like a sentence: closing quotes and brackets may follow the mark.
SENTENCE_END = r"[.!?…。！？:;][\"'”’»)\]]*$"
#: Separators of menus; so many of them, or one between every few words, make a line navigation.
SEPARATORS = r"[|›»•·>]"
MENU_WORDS_PER_SEPARATOR = 4
#: Symbols per word beyond which a line is no prose.
LINE_SYMBOLS = 0.3
BOILERPLATE = (
    "javascript", "cookie policy", "use of cookies", "uses cookies", "privacy policy", "terms of use", "terms of service", "lorem ipsum",
    "click here", "read more", "sign in", "log in", "skip to content", "all rights reserved", "subscribe to our", "share this",
)
#: A document that keeps less than this share of its words is rejected.
LEAST_KEPT = 0.5


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def with_repeated_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the number of words covered by windows of three words that occur twice or more in the array ``words``.

    Windows are compared by a 64-bit hash; sorted by (hash, place), equal ones are neighbours, and the covered words
    follow from the steps between the places of repeated windows.  One step per column, so that each is computed once.
    """
    three = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_hashes", F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), three)).otherwise(none))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_pairs", F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # A pair that differs from the one before and from the one after is a window of its own.
    before = F.concat(F.array(F.lit(None)), F.slice("_pairs", 1, F.size("_pairs") - 1))
    df = df.withColumn("_same", F.when(F.col("_pairs").isNotNull(), F.zip_with("_pairs", before, lambda x, y: x["h"].eqNullSafe(y["h"]))))
    after = F.concat(F.slice("_same", 2, F.size("_same")), F.array(F.lit(False)))
    df = df.withColumn("_either", F.when(F.col("_same").isNotNull(), F.zip_with("_same", after, lambda x, y: x | y)))
    chosen = F.filter(F.zip_with("_pairs", "_either", lambda p, e: F.when(e, p["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_places", F.when(F.col("_either").isNotNull(), F.sort_array(chosen)))
    gaps = F.zip_with("_places", F.slice("_places", 2, F.size("_places")), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    covered = F.when(F.col("_places").isNotNull(), F.aggregate(gaps, F.lit(0), lambda s, g: s + g)).otherwise(0).cast("long")
    return df.withColumn(name, covered).drop("_hashes", "_pairs", "_same", "_either", "_places")


def bad_line(line: Column) -> Column:
    """Does a line with a word fail one of the rules?"""
    low = F.lower(line)
    trimmed = F.regexp_replace(line, r"[\x20\x09-\x0D]+$", "")
    n = F.size(_words(line))
    menu = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = (menu >= 2) & (menu * MENU_WORDS_PER_SEPARATOR >= n)
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    punctuation = ~trimmed.rlike(SENTENCE_END) | (symbols > LINE_SYMBOLS * n)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    return punctuation | navigation | boilerplate


def features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_words, cleaned (the text without failed lines), base_failed, kept.

    A null text has no words and fails, as an empty one does.  A document of fewer than 50 words fails; so does one with
    over half of its words in repeated windows.  Rows that repeat a key are judged each on its own; a null key stays null.
    An empty table gives an empty result.  Other columns are not read.
    """
    one = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = one.withColumns({"_words": _words(F.col("_text")), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))})
    good = with_repeated_words(split, "_words", "_repeats").withColumn("_good", F.filter("_lines", lambda x: ~bad_line(x)))
    cleaned = F.array_join("_good", "\n")
    n = F.size("_words").cast("long")
    measured = good.select(
        F.col("_key").alias(key), n.alias("n_words"), F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_repeats").alias("n_repeat_words"), F.regexp_count(cleaned, F.lit(WORD)).cast("long").alias("n_kept_words"), cleaned.alias("cleaned"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_kept_words") >= LEAST_KEPT * F.col("n_words")))
