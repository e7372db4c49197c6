"""Expressions over a text column: tokens, numbers, links, lines, cleaning.

Character classes are spelled out because Java's ``\\w`` and ``\\s`` cover ASCII only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that say what a word, a number, a link and a line are.
WORD_CHAR = r"[\p{L}\p{N}_]"
SPACE_CHARS = r"\t-\r\x1c-\x1f \x{85}\p{Z}"
LINE_BREAKS = r"[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]+"
NUMBER = rf"(?<!{WORD_CHAR})(?:\p{{Nd}}{{2,}}|[0-9]+(?:\.[0-9]+)?)(?!{WORD_CHAR})"
DIGIT_RUN = r"\p{Nd}[\p{Nd}.]*"
URL = rf"(?iu)https?://[^{SPACE_CHARS}'\"<>)\]]+"
URL_TAIL = ".,;:)"
CONTROL_CHARS = r"[\x00-\x1f]"
STOCK_SENTENCE = r"(?iu)As an AI language model[^\n.]*[.\n]?"
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
KEYWORDS = (
    "flight", "space", "microgravity", "orbit", "condition", "control", "assay", "organism",
    "transcript", "methyl", "gene", "expression", "rna", "dna",
)


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    """Text without white space, Unicode spaces included, at either end."""
    return F.regexp_replace(text, rf"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+$", "")


def word_tokens(text: Column) -> Column:
    """Distinct lower-case words, one character or more, stop words kept."""
    return F.array_distinct(_all_matches(F.lower(text), f"{WORD_CHAR}+"))


def number_tokens(text: Column) -> Column:
    """Distinct numbers that stand as words: two or more digits, or digits with decimals."""
    return F.array_distinct(_all_matches(text, NUMBER))


def digit_runs(text: Column) -> Column:
    """Distinct longest runs of digits and dots.

    A number is a substring of the text exactly when it is a substring of one of these runs.
    """
    return F.array_distinct(_all_matches(text, DIGIT_RUN))


def substrings(runs: Column, lengths: Sequence[int]) -> Column:
    """Distinct substrings of the given lengths of the strings in an array."""

    def cut(size: int) -> Column:
        def of(run: Column) -> Column:
            starts = F.sequence(F.lit(1), F.length(run) - size + 1)
            return F.transform(starts, lambda start: F.substring(run, start, F.lit(size)))

        return F.flatten(F.transform(F.filter(runs, lambda run: F.length(run) >= size), of))

    per_length = [cut(size) for size in lengths]
    return F.array_distinct(F.concat(*per_length))


def all_words(text: Column) -> Column:
    """Lower-case words of one character or more in text order, repeated ones too."""
    return _all_matches(F.lower(text), f"{WORD_CHAR}+")


def kept_words(words: Column, stop_words: Sequence[str]) -> Column:
    """Of words in text order those that ``kept_tokens`` finds in the text."""
    long = F.filter(words, lambda word: F.length(word) >= 2)
    return F.filter(long, lambda word: ~word.isin(*stop_words)) if stop_words else long


def kept_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-case words of two or more characters in text order, stop words removed."""
    words = _all_matches(F.lower(text), f"{WORD_CHAR}{{2,}}")
    return F.filter(words, lambda word: ~word.isin(*stop_words)) if stop_words else words


def bigrams(tokens: Column) -> Column:
    """Every two tokens that follow each other, joined by a blank."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda first, second: F.concat(first, F.lit(" "), second),
    )


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by their bigrams."""
    return F.concat(tokens, bigrams(tokens))


def extract_urls(text: Column) -> Column:
    """Distinct links in order of first occurrence, closing punctuation cut off."""
    found = _all_matches(text, URL)
    return F.array_distinct(F.transform(found, lambda url: F.rtrim(url, F.lit(URL_TAIL))))


def lines(text: Column) -> Column:
    """Lines without surrounding space; empty ones are left out."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAKS)
    return F.filter(F.transform(parts, strip), lambda line: line != "")


def has_keyword(line: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """Whether a line holds any of the keywords as a substring, ignoring case."""
    lowered = F.lower(line)
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | F.contains(lowered, F.lit(keyword))
    return hit


def clean_answer(text: Column) -> Column:
    """Answer text on one line: no control characters, stock sentence or repeated space."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL_CHARS, " ")
    said = F.regexp_replace(flat, STOCK_SENTENCE, "")
    return strip(F.regexp_replace(said, rf"[{SPACE_CHARS}]{{2,}}", " "))


def head(text: Column, chars: int) -> Column:
    """First characters of a text; characters that could not be decoded are dropped first."""
    return F.substring(F.regexp_replace(text, "�", ""), 1, chars)


def null_missing(value: Column) -> Column:
    """NULL for every spelling of a missing cell, else the value."""
    return F.when(~value.isin(*MISSING_TOKENS), value)
