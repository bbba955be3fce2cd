"""String expressions with the rules of everyday scripting strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capitalize(s: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substring(s, F.lit(2), F.length(s))))


def title_words(s: Column) -> Column:
    """Each blank-separated word capitalised; an apostrophe starts no new word."""
    return F.initcap(s)


def piece(s: Column, separator: str, n: int) -> Column:
    """n-th piece (0-based) around a literal separator; NULL beyond the end."""
    return F.get(F.split(s, f"\\Q{separator}\\E"), F.lit(n))


def find(s: Column, needle: str) -> Column:
    """0-based position of the first occurrence, -1 if absent."""
    return F.instr(s, needle) - 1


def count_substring(s: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))
    return (gone / len(needle)).cast("int")


def partition(s: Column, separator: str) -> tuple[Column, Column, Column]:
    """Head, separator, tail; the whole string and two empties if absent."""
    found = F.instr(s, separator) > 0
    head = F.when(found, F.substring_index(s, separator, 1)).otherwise(s)
    tail = F.when(found, F.substring(s, F.length(head) + 1 + len(separator), F.length(s))).otherwise("")
    return head, F.when(found, F.lit(separator)).otherwise(""), tail


def is_alnum(s: Column) -> Column:
    return s.rlike(r"^[\p{L}\p{N}]+$")


def is_alpha(s: Column) -> Column:
    return s.rlike(r"^\p{L}+$")


def is_space(s: Column) -> Column:
    return s.rlike(r"^[\s\x{85}\p{Z}]+$")


def is_lower(s: Column) -> Column:
    """At least one cased character, none of them upper case."""
    return s.rlike(r"\p{Ll}") & ~s.rlike(r"[\p{Lu}\p{Lt}]")


def is_upper(s: Column) -> Column:
    return s.rlike(r"\p{Lu}") & ~s.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(s: Column) -> Column:
    """Upper case only at the start of a run of letters, lower case only after one."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return (
        s.rlike(r"[\p{Lu}\p{Lt}]")
        & ~s.rlike(rf"(^|[^{cased}])\p{{Ll}}")
        & ~s.rlike(rf"[{cased}][\p{{Lu}}\p{{Lt}}]")
    )


def upper_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\p{Lu}"))


def lower_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\p{Ll}"))


def remove_prefix(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), F.substring(s, F.lit(len(prefix) + 1), F.length(s))).otherwise(s)


def remove_suffix(s: Column, suffix: str) -> Column:
    return F.when(s.endswith(suffix), F.left(s, F.length(s) - len(suffix))).otherwise(s)


def pad_right(s: Column, width: int, fill: str = " ") -> Column:
    """Left-aligned; never cuts."""
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, fill))


def pad_left(s: Column, width: int, fill: str = " ") -> Column:
    """Right-aligned; never cuts."""
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def pad_centre(s: Column, width: int, fill: str = " ") -> Column:
    """Centred; the spare fill character of an odd gap goes to the right."""
    gap = F.greatest(F.lit(width) - F.length(s), F.lit(0))
    left = F.floor(gap / 2).cast("int")
    return F.concat(F.repeat(F.lit(fill), left), s, F.repeat(F.lit(fill), gap - left))


def count_term(s: Column, term: str) -> Column:
    """Blank-separated words equal to ``term``, ignoring case."""
    return F.size(F.filter(F.split(F.lower(s), r"\s+"), lambda w: w == term.lower()))


def email_host(s: Column) -> Column:
    """Text behind the last ``@``."""
    return F.substring_index(s, "@", -1)


def full_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", first, last)
