"""Row-local text functions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A word is a run of letters, digits and underscores; a sentence ends
# at a run of . ! ?; a paragraph ends at a blank line.
WORD_PATTERN = r"[\p{L}\p{N}_]+"
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
SENTENCE_BREAK = r"[.!?]+"
PARAGRAPH_BREAK = r"(?U)\n\s*\n"
STRIP_PATTERN = r"(?U)^\s+|\s+$"


def strip_space(text: Column) -> Column:
    """Remove all leading and trailing Unicode whitespace (SQL trim only knows blanks)."""
    return F.regexp_replace(text, STRIP_PATTERN, "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("bigint")


def _pieces(text: Column, pattern: str) -> Column:
    parts = F.split(text, pattern)
    filled = F.filter(parts, lambda p: F.rlike(p, F.lit(r"(?U)\S")))
    return F.greatest(F.lit(1), F.size(filled)).cast("bigint")


def sentence_count(text: Column) -> Column:
    return _pieces(text, SENTENCE_BREAK)


def paragraph_count(text: Column) -> Column:
    return _pieces(strip_space(text), PARAGRAPH_BREAK)


def mean_word_length(text: Column) -> Column:
    """Letters in words over number of words; 0 for a text without words."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "")).cast("double")
    n = word_count(text)
    return F.when(n > 0, letters / n).otherwise(F.lit(0.0))


def char_count(text: Column) -> Column:
    return F.length(text).cast("bigint")


def surface_columns(text: Column) -> dict[str, Column]:
    """The five surface features of a text."""
    return {
        "surface_word_count": word_count(text).cast("double"),
        "surface_char_count": char_count(text).cast("double"),
        "surface_sentence_count": sentence_count(text).cast("double"),
        "surface_paragraph_count": paragraph_count(text).cast("double"),
        "surface_mean_word_length": mean_word_length(text),
    }


def terms(text: Column) -> Column:
    """Lower-case words of two or more characters, followed by their adjacent pairs."""
    unigrams = F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))
    return unigrams


def bigrams(unigrams: Column) -> Column:
    n = F.size(unigrams)
    pairs = F.zip_with(
        F.slice(unigrams, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(unigrams, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def running_offsets(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array, inside one row.

    A plain fold copies its growing result at every step (quadratic).  Folding blocks of
    about sqrt(n) elements keeps the copies at n^1.5, which matters for very long texts.
    """
    zero = F.array().cast("array<bigint>")

    def prefix(arr: Column, base: Column) -> Column:
        return F.aggregate(
            arr,
            F.struct(base.cast("bigint").alias("at"), zero.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x).cast("bigint").alias("at"),
                F.concat(acc["out"], F.array(acc["at"])).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, x: (a + x).cast("bigint"))

    n = F.size(lengths)
    width = F.greatest(F.lit(16), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), width)
    blocks = F.transform(starts, lambda i: F.slice(lengths, i, width))
    bases = prefix(F.transform(blocks, total), F.lit(0))
    return F.flatten(F.zip_with(blocks, bases, prefix))
