"""Quality rules that judge lines first, then the document by what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import word_count, words

#: Fixed limits of the base verdict: least words, and most percent of words in repeated windows of three.
LEAST_WORDS, WINDOW_WORDS, MOST_REPEATED = 50, 3, 50
#: A line of at least this many words must end as a sentence does, or hold a sentence that has ended; shorter ones may be headings.
SENTENCE_WORDS = 5
#: Percent of a line's characters that symbols may make, percent that capitals may make, and separators a line of text may hold.
MOST_SYMBOLS, MOST_CAPITALS, MOST_SEPARATORS = 10, 50, 2
#: Lines of boilerplate are shorter than this many characters.
BOILERPLATE_CHARS = 200
#: Percent of the text's characters that failing lines may take away.
MOST_LOST = 50

WORD_CHAR, OTHER_BLANKS = r"[^\x20\x09-\x0D]", r"[\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
ENDS = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*\z"
ENDED = r"[.!?…。！？][\x20\x09-\x0D]"
SEPARATORS = r"[|»›•]|::|>>"
BOILERPLATE = (r"(?i)\b(lorem ipsum|javascript|cookie policy|use cookies|privacy policy|terms of (use|service)|all rights reserved"
               r"|sign (in|up)|log ?in|subscribe|read more|click here|share (this|on)|back to top|next page|previous page)\b")


def word_chars(text: Column) -> Column:
    """Characters that are not white space."""
    close = F.replace(text, F.lit(" "), F.lit(""))
    return F.length(close) - F.regexp_count(close, F.lit(OTHER_BLANKS))


def line_fails(line: Column) -> Column:
    """True for a line, not blank, that breaks a punctuation, navigation, boilerplate, symbol or capital rule.

    In each rule the test that few lines pass comes first, so most lines are read once for each rule.
    """
    long_enough = word_count(line) >= SENTENCE_WORDS
    unended = ~line.rlike(ENDS) & ~line.rlike(ENDED) & long_enough
    navigation = F.regexp_count(line, F.lit(SEPARATORS)) > MOST_SEPARATORS
    boilerplate = (F.length(line) < BOILERPLATE_CHARS) & line.rlike(BOILERPLATE)
    symbols = line.rlike(SYMBOLS) & (100 * F.regexp_count(line, F.lit(SYMBOLS)) > MOST_SYMBOLS * word_chars(line))
    capitals = (100 * F.regexp_count(line, F.lit(r"\p{Lu}")) > MOST_CAPITALS * word_chars(line)) & long_enough
    return unended | navigation | boilerplate | symbols | capitals


def _alike(found: Column) -> Column:
    """Places of windows whose hash another window has: every repeated window, and a few more. One long holds hash and place, so sorting is cheap."""
    return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(found) - WINDOW_WORDS), lambda i: F.shiftleft(
        F.xxhash64(*[F.get(found, i + k) for k in range(WINDOW_WORDS)]), 32).bitwiseOR(i.cast("long"))))


def _repeated(found: Column, ordered: Column) -> Column:
    """Windows at those places, sorted with their places."""
    same = lambda x, i: F.shiftright(x, 32).eqNullSafe(F.shiftright(F.get(ordered, i), 32))
    places = F.transform(F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    return F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *[F.get(found, i + k) for k in range(WINDOW_WORDS)]).alias("w"), i.alias("at"))))


def _covered(windows: Column) -> Column:
    """Places of windows that are equal to a neighbour in sorted order."""
    same = lambda a, i: a["w"].eqNullSafe(F.get(windows, i)["w"])
    return F.sort_array(F.transform(F.filter(windows, lambda a, i: same(a, i - 1) | same(a, i + 1)), lambda a: a["at"]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text, one row per document, and its lines as ``_lines``."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    split = raw.withColumns({"_words": words(F.col("_text")), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD_CHAR))})
    # Sorting hashes leaves few windows, and only those are compared as words; each repeated place covers three words, less what the next covers.
    placed = (split.withColumn("_hashes", F.when(F.size("_words") >= WINDOW_WORDS, _alike(F.col("_words"))))
              .withColumn("_windows", _repeated(F.col("_words"), F.col("_hashes"))).withColumn("_places", _covered(F.col("_windows"))))
    steps = F.transform(F.col("_places"), lambda p, i: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(F.col("_places"), i + 1) - p, F.lit(WINDOW_WORDS))))
    return placed.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), word_chars(F.col("_text")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"), "_lines")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict and verdict of every document.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lost_chars (characters of words in failing lines) and
    clean_text (the lines that pass). A document is kept if the base does not
    fail and failing lines take at most half of its characters. Each document is
    judged alone, so nothing is shuffled. A null text has no words and fails;
    repeated rows are judged each; other columns are not read.
    """
    counted = measure(docs, id_col, text_col).withColumn("_failed", F.transform("_lines", line_fails))
    bad = F.filter("_lines", lambda x, i: F.get(F.col("_failed"), i))
    lost = F.aggregate(bad, F.lit(0), lambda a, x: a + word_chars(x)).cast("long")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = counted.withColumns({"lost_chars": lost, "base_failed": base, "clean_text": F.array_join(F.filter("_lines", lambda x, i: ~F.get(F.col("_failed"), i)), "\n")})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars"))).alias("kept"), "lost_chars", "clean_text")
