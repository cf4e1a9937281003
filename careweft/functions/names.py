"""Identifier cleaning and quoting; names are metadata, so plain Python."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweft.functions.predicates import as_column

# Opening and closing quote of an identifier per dialect.
QUOTES = {"tsql": ("[", "]"), "mysql": ("`", "`"), "duckdb": ('"', '"'), "spark": ("`", "`")}


def clean_name(name: str) -> str:
    """Separators become one underscore; every other non-word character goes."""
    return re.sub(r"\W+", "", re.sub(r"[- _]+", "_", name))


def clean_columns(df: DataFrame) -> DataFrame:
    """Clean all column names in one projection; two equal results are an error."""
    names = [clean_name(c) for c in df.columns]
    twice = [n for n, k in Counter(n.lower() for n in names).items() if k > 1]
    if twice:
        raise ValueError(f"column names collide after cleaning: {sorted(twice)}")
    return df.toDF(*names)


def quote_name(name: str, dialect: str = "spark") -> str:
    opening, closing = QUOTES[dialect]
    return opening + name.replace(closing, closing * 2) + closing


def quoted(column: Column | str) -> Column:
    """Backtick-quoted name as a column expression."""
    return F.concat(F.lit("`"), F.replace(as_column(column), F.lit("`"), F.lit("``")), F.lit("`"))


def qualified_name(*parts: Column | str) -> Column:
    """One to three quoted name parts joined by dots; null parts are left out."""
    return F.concat_ws(".", *[quoted(p) for p in parts])
