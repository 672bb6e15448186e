"""Line-first quality rules, native: judge and clean lines, then reject documents that lose too much text.

Each line with a word meets the punctuation, navigation and boilerplate rules; lines that fail any of them are
removed. Navigation is told by form, in any language: a run of at least ``menu_run`` lines of at most ``menu_words`` words,
none of which ends like a sentence, or a line parted by bars. Short lists of set phrases and menu words add to it for
lines that stand alone. A document is then rejected if the removed lines hold more than ``max_lost`` of its word characters. The
document-level base counts (symbols, repeated lines, repeated word windows) come with the verdict.

Everything is a column expression over one row, so there is no shuffle and no state between rows. Repeated word
windows are found through 64-bit window hashes, sorted only in documents that have a repeat at all.

Defined cases: a null or empty text has no words and fails the base rule; white-space-only lines are neither judged
nor counted; repeated rows are judged alike; an empty table gives no rows; other columns pass through, but for those
that bear the name of an output, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisweave.llm.common import SPACE_RUN, read_table, unused, words

SYMBOLS = "[#*$%&|<>]"

#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = [
    "accept all cookies",
    "all rights reserved",
    "click here to",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "powered by",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
    "we use cookies",
]

#: A line that has no other words than these is navigation.
NAVIGATION = ["about", "back", "contact", "faq", "help", "home", "login", "logout", "menu", "next", "previous", "register", "search", "share", "sitemap", "top"]

WINDOW = 8


def repeated_words(tokens: Column, n_tokens: Column) -> Column:
    """How many tokens lie in windows of ``WINDOW`` tokens that occur twice or more. ``tokens`` must be a plain column."""
    hashes = F.transform(F.sequence(F.lit(0), n_tokens - WINDOW), lambda i: F.xxhash64(*(tokens[i + k] for k in range(WINDOW))))
    return F.when(n_tokens >= WINDOW, hashes)


def _same(ordered: Column, k: Column, x: Column) -> Column:
    return F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))


def _bound(value: Column, rule) -> Column:
    """``rule`` over ``value``, which is evaluated once."""
    return F.exists(F.array(value), rule)


def failing_line(line: Column, max_menu_words: int = 12, max_phrase_words: int = 40) -> Column:
    """Whether a line with words fails the punctuation rule, or by itself the navigation or boilerplate rule.

    A menu has ``max_menu_words`` words at most; a set phrase makes boilerplate of a line up to ``max_phrase_words``, since a
    longer one is a paragraph that has the phrase in it. The cheap tests come first.
    """
    symbols, shouts = F.regexp_count(line, F.lit(SYMBOLS)), F.regexp_count(line, F.lit("!!"))
    bars = F.regexp_count(line, F.lit("(?<=\\s)[|>»·•](?=\\s)"))
    n_words = F.size(words(line))
    punctuation = line.rlike(SYMBOLS) & (symbols * 100 > F.char_length(line) * 8) | line.contains("!!") & (shouts >= 3) & (shouts * 5 > n_words)
    separators = line.rlike("\\s[|>»·•]\\s") & (bars >= 2) & (bars * 8 > n_words)
    plain = F.lower(F.regexp_replace(line, "[^A-Za-z ]+", " "))
    listed = F.regexp_count(plain, F.lit("\\b(" + "|".join(NAVIGATION) + ")\\b"))
    menu = (n_words <= max_menu_words) & (listed > 0) & (listed == n_words)
    boilerplate = _bound(F.lower(line), lambda low: reduce(lambda a, b: a | b, (low.contains(p) for p in BOILERPLATE))) & (n_words <= max_phrase_words)
    return punctuation | separators | menu | boilerplate


def menu_like(line: Column, menu_words: int) -> Column:
    """A line of at most ``menu_words`` words that does not end like a sentence, a heading's colon or a list's comma."""
    return line.rlike(f"^\\s*\\S+(\\s+\\S+){{0,{menu_words - 1}}}\\s*$") & ~line.rlike("[.!?:;,…。！？：；，)\"'»”’]\\s*$")


def in_run(flags: Column, k: Column, run: int) -> Column:
    """Whether ``run`` neighbouring flags around k, itself among them, are set. ``flags`` must be a plain column."""
    at = lambda j: F.coalesce(F.get(flags, k + j), F.lit(False))
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (at(j) for j in range(start, start + run))) for start in range(1 - run, 1)))


OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "kept")


def judge(docs: DataFrame, text_col: str = "text", min_words: int = 20, max_repeat_pct: int = 30, max_lost: float = 0.4, menu_words: int = 3, menu_run: int = 4, max_menu_words: int = 12, max_phrase_words: int = 40) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned, kept."""
    rest = [c for c in docs.columns if c not in (*OUTPUTS, text_col)]
    row = unused([text_col], "row")
    # The other columns wait in a struct, so that no name below can meet theirs.
    docs = docs.select(F.struct(*rest).alias(row), text_col) if rest else docs.select(text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.withColumn("_words", words(text)).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    hashed = (
        lines.withColumn("_n", F.size("_words"))
        .withColumn("_hashes", repeated_words(F.col("_words"), F.col("_n")))
        .withColumn("_menu", F.when(F.size("_lines") >= menu_run, F.transform("_lines", lambda x: menu_like(x, menu_words))))
        .withColumn("_bad", F.transform("_lines", lambda x: failing_line(x, max_menu_words, max_phrase_words)))
        .withColumn("_bad", F.when(F.exists("_menu", lambda x: x), F.transform("_bad", lambda x, k: x | in_run(F.col("_menu"), k, menu_run))).otherwise(F.col("_bad")))
        .drop("_menu")
        .withColumn("_word_chars", F.char_length(F.array_join("_words", "")))
        .drop("_words")
        .withColumn("_ordered", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .drop("_hashes")
        # Each of these is a column of its own: inside a lambda it would be evaluated once an element.
        .withColumn("_twice", F.filter("_ordered", lambda x, k: _same(F.col("_ordered"), k - 1, x) | _same(F.col("_ordered"), k + 1, x)))
        .drop("_ordered")
        .withColumn("_repeats", F.sort_array(F.transform("_twice", lambda x: x["i"])))
        .drop("_twice")
    )
    at = F.col("_repeats")
    counted = (
        hashed.withColumn("n_words", F.col("_n").cast("long"))
        .withColumn("word_chars", F.col("_word_chars").cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    )
    lost = F.char_length(F.regexp_replace(F.array_join(F.filter("_lines", lambda x, k: F.get(F.col("_bad"), k)), " "), SPACE_RUN, ""))
    out = (
        counted.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
        .withColumn("cleaned", F.when(F.exists("_bad", lambda x: x), F.array_join(F.filter("_lines", lambda x, k: ~F.get(F.col("_bad"), k)), "\n")).otherwise(text))
        .withColumn("kept", ~F.col("base_failed") & (F.when(F.exists("_bad", lambda x: x), lost).otherwise(F.lit(0)) <= max_lost * F.col("word_chars")))
        .drop("_n", "_bad", "_lines", "_word_chars", "_repeats")
    )
    return out.select(*([f"{row}.*"] if rest else []), text_col, *OUTPUTS)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

