"""Line-first quality rules: failing lines go first, then documents that lost too much.

A line fails if it is navigation (few words with menu phrases or separators),
boilerplate (legal and technical notices) or badly punctuated (no mark at its
end, or more marks than letters allow). A document is rejected by the base rule
or if failing lines held more than ``most_lost`` of its word characters.

Nulls and empty texts have no words and fail the base rule. Every input row
gives one row, so repeated rows are judged alike. Only the two named columns are
read; others do no harm whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, let, space_words, trimmed

MENU = (r"^(?:home|menu|log ?in|sign (?:in|up)|next|previous|read more|click here|share|subscribe|back to top"
        r"|skip to (?:main )?content|contact us|about us)(?:$|[^A-Za-z].*)")
SEPARATED = r"[|»›•][^|»›•]*[|»›•]"
NOTICES = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
           "enable javascript", "this work is licensed under", "lorem ipsum")
ENDINGS = ".!?…。！？।:;,)]}\"'’”»"
MARKS = r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
MENU_WORDS = 12
MENU_CHARS = 120
MOST_MARKS = 0.25
MOST_LOST = 0.5


def _count(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, ""))


def line_passes(line: Column) -> Column:
    """True for blank lines and for lines that no rule strikes."""
    def noticed(low):
        found = F.contains(low, F.lit(NOTICES[0]))
        for phrase in NOTICES[1:]:
            found = found | F.contains(low, F.lit(phrase))
        return found

    def judged(t):
        short = (F.length(t) <= MENU_CHARS) & (F.size(F.split(t, SPACE_RUN)) <= MENU_WORDS)
        menu = short & (F.lower(t).rlike(MENU) | t.rlike(SEPARATED))
        letters = F.length(F.regexp_replace(t, SPACE_RUN, ""))
        ended = F.instr(F.lit(ENDINGS), F.substring(t, -1, 1)) > 0
        return (t == "") | ~(~ended | menu | (_count(t, MARKS) > MOST_MARKS * letters) | let(F.lower(t), noticed))
    return let(trimmed(line), judged)


def clean_lines(text: Column) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(F.split(text, "\n"), line_passes), "\n")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows found at least twice in the text, each word counted once."""
    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(grams):
        by_hash = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(by_hash, lambda s: F.filter(s, lambda x, j: F.coalesce(
            (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]),
            F.get(s, j - 1)["g"] == x["g"], F.get(s, j + 1)["g"] == x["g"], F.lit(False))))
        spots = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(spots))

    some = let(words, lambda w: let(windows(w), lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g))))
    return F.when(F.size(words) < 6, F.when(F.size(words) < 4, 0).otherwise(some)).otherwise(some).cast("long")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  most_lost: float = MOST_LOST) -> DataFrame:
    """One row per input row: counts, base rule, line losses, verdict and the cleaned text."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("id", "text", space_words(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    worded = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "id", "text", F.size("words").cast("long").alias("n_words"),
        _count(F.col("text"), SPACE_RUN).cast("long").alias("word_chars"),
        _count(F.col("text"), r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.filter("lines", line_passes).alias("good"))
    d = d.select("*", F.array_join("good", "\n").alias("clean_text"),
                 (F.col("n_lines") - F.size("good")).alias("n_lines_removed"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.col("word_chars") - _count(F.col("clean_text"), SPACE_RUN)
    return d.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "n_lines", F.col("n_lines_removed").cast("long").alias("n_lines_removed"),
        F.when(F.col("n_lines_removed") == 0, 0).otherwise(lost).cast("long").alias("lost_chars"), "clean_text").withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") <= most_lost * F.col("word_chars")))
