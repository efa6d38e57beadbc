"""Name and text expressions, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings by which a field says that nothing is known (fixed values, compared in lower case without outer spaces).
UNKNOWN_VALUES = ["n/a", "na", "none", "null", "nil", "unknown", "not known", "not available", "tbd", "todo", "xxx", "(empty)", "empty", "see above"]


def normalize_name(c: Column | str) -> Column:
    """Key form of a name: parentheses dropped, lower case, ``[a-z0-9]`` kept, the rest single spaces."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.lower(F.regexp_replace(c, r"\([^)]*\)", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]", " "), " +", " "))


def normalize_text(c: Column | str) -> Column:
    """Display form: lower case, hyphens and parenthesised words kept; NULL gives ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9-]", " "), " +", " ")), F.lit(""))


def is_known(c: Column | str) -> Column:
    """Whether a value says something: not null, not blank, not only punctuation, not one of UNKNOWN_VALUES."""
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(F.trim(c))
    return F.coalesce(low.rlike(r"[\p{L}\p{N}]") & ~low.isin(UNKNOWN_VALUES), F.lit(False))


def content_hash(c: Column | str) -> Column:
    return F.sha2(c, 256)
