"""Regular-expression expressions (Java syntax)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the telephone layout of the reference exercises
PHONE = r"(\d{3})-(\d{3})-(\d{4})"
HYPHEN_WORD = r"[\w]+-[\w]+"


def first_match(s: Column, pattern: str) -> Column:
    """Text of the first match, NULL if there is none."""
    return F.regexp_substr(s, F.lit(pattern))


def match_start(s: Column, pattern: str) -> Column:
    """0-based start of the first match, NULL if there is none."""
    return F.nullif(F.regexp_instr(s, F.lit(pattern)), F.lit(0)) - 1


def find_all(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def group(s: Column, pattern: str, n: int) -> Column:
    """n-th group of the first match, NULL without a match."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, n))


def scan_first(df: DataFrame, path: str, text: str, pattern: str = PHONE, out: str = "hit") -> DataFrame:
    """First match of each file or record that has one."""
    hit = first_match(F.col(text), pattern)
    return df.select(path, hit.alias(out)).where(F.col(out).isNotNull())
