"""Scalar text expressions over article columns (section C of the inventory).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col


def content_length(c="content") -> Column:
    return F.length(col(c))


def word_count(c="content") -> Column:
    """Whitespace-separated tokens, like ``str.split()``: the number of maximal non-whitespace runs
    (counted in place, no token array is built)."""
    return F.regexp_count(col(c), F.lit(r"\S+"))


def is_valid(word_count_col="word_count", language_col="language", min_words: int = 150,
             languages=("es", "en")) -> Column:
    """More than ``min_words`` words (strict) and a kept language (tested first: it is cheap and short-circuits
    the word count)."""
    return col(language_col).isin(*languages) & (col(word_count_col) > min_words)


def basic_preprocess(c) -> Column:
    """lower case, runs of whitespace -> one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def text_for_embedding(title="title", content="content") -> Column:
    """title + '. ' + content, preprocessed; a null part gives null (plain concat)."""
    return basic_preprocess(F.concat(col(title), F.lit(". "), col(content)))


# RFC-822 dates as feeds write them: "Mon, 01 Jan 2024 10:00:00 +0100".
# The weekday and the offset are required (as the strict parser demands) and the
# offset is dropped without conversion.
RFC822_PATTERN = r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:[+-]\d{2}:?\d{2}|Z)$"


def parse_feed_date(published, updated=None) -> Column:
    """Parse the published date, falling back to updated; unparseable -> null."""
    raw = col(published) if updated is None else F.coalesce(col(published), col(updated))
    core = F.regexp_extract(F.trim(raw), RFC822_PATTERN, 1)
    return F.try_to_timestamp(F.nullif(core, F.lit("")), F.lit("d MMM yyyy HH:mm:ss"))


def truncate_summary(c, n: int = 300) -> Column:
    return F.substring(col(c), 1, n)


def feed_content(content, summary) -> Column:
    """content if non-empty, else summary, else ''."""
    return F.coalesce(F.nullif(col(content), F.lit("")), col(summary), F.lit(""))


def title_case(c) -> Column:
    """``str.title()`` for letter-only words: first letter of each letter run upper, rest lower."""
    # split on letter-run boundaries keeping separators, capitalise each run
    parts = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    def cap(p):
        first = F.substring(p, 1, 1)
        # title case of the sharp s is "Ss" (its upper case "SS" would add a letter)
        head = F.when(first == "\u00df", F.lit("Ss")).otherwise(F.upper(first))
        return F.concat(head, F.lower(F.substring(p, 2, 1 << 30)))
    return F.array_join(F.transform(parts, cap), "")


def regex_contains_ci(c, pattern: str) -> Column:
    """Case-insensitive regex search, null -> false."""
    return F.coalesce(col(c).rlike("(?i)" + pattern), F.lit(False))


HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]


def html_escape(c) -> Column:
    out = col(c)
    for raw, ent in HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(ent))
    return out
