"""Words, bigrams, signatures, times and number-like notes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from replyloom import defaults as D

#: A word character; written as a class because engines disagree on \\w and \\b.
WORD = r"[\p{L}\p{N}_]"
WORD_RUN_2 = r"[\p{L}\p{N}_]{2,}"


def word_list(text: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; null counts as an empty text."""
    return F.size(word_list(F.coalesce(text, F.lit(""))))


def latin_words(text: Column) -> Column:
    """Lower-case words made only of two or more letters a to z."""
    # One pattern for the whole text: a condition on each run would be tried word by word. Java looks behind
    # by code points only if the pattern itself holds one beyond the 16-bit ones, here a letter.
    found = f"(?<!{WORD}|\U0001d41a)([a-z]{{2,}}+)(?!{WORD})"
    return F.regexp_extract_all(F.lower(text), F.lit(found), F.lit(1))


def terms(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_RUN_2})"), F.lit(1))


def spaced_words(text: Column) -> Column:
    """Lower-case runs of word characters, of any length, each followed by one space; null has none."""
    # the letters and digits of ASCII are named first, as most characters are among them
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.regexp_replace(lower, r"[^a-z0-9_\p{L}\p{N}]+", " "), F.lit(" "))


def bigrams(words: Column) -> Column:
    """Adjacent pairs of an array of words, joined by a space."""
    return F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )


def split_signature(text: Column, pattern: str = D.TRAILING_SIGNATURE) -> Column:
    """Struct of the agent signature at the end of a reply (or null) and the text before it."""
    signature = F.regexp_extract(text, pattern, 1)
    found = text.rlike(pattern)
    rest = F.btrim(F.regexp_replace(text, pattern, ""), F.lit(" \t\r\n\f\x0b"))
    return F.struct(
        F.when(found, signature).alias("signature"),
        F.when(found, rest).otherwise(text).alias("rest"),
    )


def profile_signatures(text: Column, pattern: str = D.PROFILE_SIGNATURE) -> Column:
    """All agent signatures found anywhere in a text, as the brand profile counts them."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.trim)


def parse_post_time(text: Column) -> Column:
    """Timestamp of ``Wed Oct 11 06:55:44 +0000 2017``; null where it cannot be read."""
    return F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy"))


def is_bare_numeric(text: Column) -> Column:
    """True for a plain number, or for up to three characters out of digits and ``. , + -``."""
    trimmed = F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    number = trimmed.rlike(r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?$") | (
        trimmed.rlike(r"(?i)^[+-]?(inf|infinity|nan)$")
    )
    return (trimmed != "") & (number | trimmed.rlike(r"^[0-9.,+\- ]{1,3}$"))


def round_half_up(value: Column, digits: int) -> Column:
    """Decimal rounding of a non-negative double, the same in every engine."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
