"""Row predicates built from column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_not_null(columns: Iterable[Column | str]) -> Column:
    """True when at least one of the columns holds a value."""
    return reduce(lambda a, b: a | b, [as_column(c).isNotNull() for c in columns])


def date_range(column: Column | str, start, end_exclusive) -> Column:
    """Half-open range: a timestamp late on the last day is not lost."""
    c = as_column(column)
    return (c >= F.lit(start)) & (c < F.lit(end_exclusive))


def like_regex(pattern: str) -> str:
    """A LIKE pattern with `%`, `_`, `[set]` and `[^set]` as a regular expression."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if close > 0:
            body = pattern[i + 1 : close]
            negated, body = body.startswith("^"), body.removeprefix("^")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", body)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = close
        else:
            out.append({"%": ".*", "_": "."}.get(ch) or re.escape(ch))
        i += 1
    return "".join(out)


def contains_text(column: Column | str, text: str) -> Column:
    """Case-insensitive `%text%`, where `text` may hold LIKE wildcards."""
    c, text = F.lower(as_column(column)), text.lower()
    if "[" in text:
        return c.rlike(f"(?s){like_regex(text)}")
    if "%" in text or "_" in text:
        escaped = text.replace("\\", "\\\\")
        return c.like(f"%{escaped}%")
    return c.contains(text)


def name_like(name: str, pattern: str) -> bool:
    """LIKE, ignoring case, for a table or column name known on the driver."""
    return re.fullmatch(like_regex(pattern.lower()), name.lower(), flags=re.DOTALL) is not None


def starts_with_any(column: Column | str, prefixes: Iterable[str]) -> Column:
    """Case-insensitive prefix test against a list of prefixes."""
    low = F.lower(as_column(column))
    tests = [low.startswith(p.lower()) for p in prefixes]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def flag_label(column: Column | str, label: str) -> Column:
    """1 becomes the label, all else null."""
    return F.when(as_column(column) == 1, F.lit(label))


def country_scope(column: Column | str) -> Column:
    """'US' or missing is domestic, any other country code foreign."""
    c = as_column(column)
    return F.when(c.isNull() | (c == "US"), F.lit("Domestic")).otherwise(F.lit("Foreign"))
