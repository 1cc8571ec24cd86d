"""Text expressions that stay in the JVM: trimming, folding of case, counting of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every script; Java's \s alone is ASCII.
SPACE = r"[\s\p{Z}]"


def trim_all(c: Column) -> Column:
    """`c` without white space of any script at its ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def fold_case(c: Column) -> Column:
    """`c` with case differences removed; upper first, so that final sigma and sharp s fold as well."""
    return F.lower(F.upper(c))


def letters_digits(c: Column) -> Column:
    """The letters, digits and accents of `c` in sequence, case folded; null counts as empty."""
    return fold_case(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}\p{M}]+", ""))


def word_string(c: Column) -> Column:
    """The words of `c` (longest runs of letters and digits), case folded, joined by single spaces."""
    return F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))


def quote_literal(text: str) -> str:
    """`text` as a Java regular expression that matches just it."""
    return "".join(ch if ch.isalnum() else f"\\x{{{ord(ch):x}}}" for ch in text)
