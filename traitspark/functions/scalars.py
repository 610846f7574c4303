"""Scalar column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def neg_log10(col) -> Column:
    """``-log10(p)``."""
    return -F.log10(_c(col))


def first_present(*cols) -> Column:
    """Value of the first column that is not missing (twin score columns)."""
    return F.coalesce(*[_c(c) for c in cols])


def rare_to_other(col, keep: Sequence[str], other: str = "Other") -> Column:
    """Keep listed categories and missing values, everything else becomes ``other``."""
    c = _c(col)
    return F.when(c.isNull() | c.isin(*keep), c).otherwise(F.lit(other))


def within_domain(col, low, high) -> Column:
    """Values outside ``[low, high]`` become missing."""
    c = _c(col)
    return F.when(c.between(low, high), c)


def split_fixed(col, sep: str, names: Sequence[str]) -> list[Column]:
    """``len(names)`` parts of a delimited text, missing where absent; the last keeps all that is left."""
    parts = F.split(_c(col), re.escape(sep), len(names))
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def split_parts(col, sep: str) -> Column:
    """All parts of a delimited text as a table function: ``pos`` from 0 and ``col``; a missing text gives one row."""
    return F.posexplode_outer(F.split(_c(col), re.escape(sep)))


def ratio(a, b) -> Column:
    """``a / b``; missing where ``b`` is zero, as for the scores of a constant truth."""
    return _c(a) / F.nullif(_c(b), F.lit(0.0))


def trait_key(col) -> Column:
    """Trait key as a file name: brackets and slashes become ``_``."""
    return F.regexp_replace(_c(col), "[()/]", "_")


def null_tokens(col, tokens: Sequence[str]) -> Column:
    """Missing-value tokens become null."""
    c = _c(col)
    return F.when(~c.isin(*tokens), c)


def file_label(col) -> Column:
    """Model name in the form used for file names: blanks become ``_``."""
    return F.regexp_replace(_c(col), " ", "_")


def indicator_label(column: str, value: str, chromosome_column: str = "Chromosome") -> str:
    """Name of an indicator column; chromosome levels are title-cased without prefix."""
    return str(value).title() if column == chromosome_column else f"{column}_{value}"


def allele_length_end(start, a1, a2) -> Column:
    """End position of a variant from its start and allele lengths."""
    return _c(start) + F.length(_c(a1)) - F.length(_c(a2))


def log_space(low: float, high: float, n: int) -> list[float]:
    """``n`` points evenly spaced in the exponent, ``10**low .. 10**high``."""
    return [10.0 ** e for e in lin_space(low, high, n)]


def lin_space(low: float, high: float, n: int) -> list[float]:
    """``n`` evenly spaced points from ``low`` to ``high``."""
    if n == 1:
        return [float(low)]
    return [low + (high - low) * i / (n - 1) for i in range(n)]
