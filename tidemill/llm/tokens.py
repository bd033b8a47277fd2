"""Sizes of texts in tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word and blank characters of Python's regular expressions, written for Java's and RE2's.
WORD = r"\p{L}\p{N}_"
BLANK = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Runs of word characters, or of characters that are neither word characters nor blanks.
TOKEN = f"[{WORD}]+|[^{WORD}{BLANK}]+"


def token_count(text: Column) -> Column:
    """How many tokens a text has; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")
