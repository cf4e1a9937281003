"""Text column functions: chunks, tab stops, SQL literals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careweft.functions.predicates import as_column
from careweft.functions.times import stamp_text


def last_position(text: Column, part: str) -> Column:
    """1-based position of the last occurrence of `part`, 0 when absent."""
    found = F.instr(F.reverse(text), part[::-1])
    return F.when(found == 0, F.lit(0)).otherwise(F.length(text) - found - len(part) + 2)


def text_pieces(text: Column | str, size: int = 4000, line_break: str = "\n") -> Column:
    """Cut a long text into an array of pieces that join back to the text.

    While more than `size` characters remain, a piece ends with the last line
    break inside the first `size` characters, or after `size + 1` characters
    where there is none. Written as one pattern with these three cases in
    order, the text is walked once.
    """
    rest = rf".{{1,{size}}}\z"
    to_break = rf".{{0,{size - len(line_break)}}}{re.escape(line_break)}"
    hard = rf".{{{size + 1}}}"
    pattern = f"(?s){rest}|{to_break}|{hard}"
    return F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(0))


def chunk_text(
    df: DataFrame,
    text: str,
    size: int = 4000,
    line_break: str = "\n",
    number: str = "chunk_no",
    out: str = "chunk",
) -> DataFrame:
    """One row per piece of a long text, numbered from 1; empty texts give no row."""
    keep = [c for c in df.columns if c != text]
    pieces = df.filter(F.length(text) > 0).select(
        *keep, F.posexplode(text_pieces(text, size, line_break)).alias("_pos", out)
    )
    return pieces.select(*keep, (F.col("_pos") + 1).alias(number), out)


def module_banner(name: str, created: str, modified: str) -> Column:
    """Header lines printed before a definition: name and 24-hour times."""
    return F.concat(
        F.lit("--\tModule:\t"), F.col(name),
        F.lit("\n--\tCreated:\t"), F.coalesce(stamp_text(created), F.lit("")),
        F.lit("\n--\tModified:\t"), F.coalesce(stamp_text(modified), F.lit("")),
        F.lit("\n"),
    )


def expand_tabs(
    text: Column | str,
    width: int = 4,
    keep_first_line: bool = False,
    normalise_crlf: bool = False,
) -> Column:
    """Replace tabs by blanks up to the next tab stop, line by line.

    Every CR and every LF ends a line and the result uses LF, so CRLF gives an
    extra empty line unless `normalise_crlf` is set. A tab always ends on a
    multiple of `width`, so each pad depends on its own part alone and no fold
    is needed. `keep_first_line` leaves the first line as it is.
    """
    text = as_column(text)
    if normalise_crlf:
        text = F.replace(text, F.lit("\r\n"), F.lit("\n"))

    def expand(line: Column) -> Column:
        return F.when(F.contains(line, F.lit("\t")), padded_line(line)).otherwise(line)

    def padded_line(line: Column) -> Column:
        parts = F.split(line, "\t", -1)
        padded = F.transform(
            parts,
            lambda part, i: F.when(
                i < F.size(parts) - 1,
                F.concat(part, F.repeat(F.lit(" "), F.lit(width) - F.length(part) % width)),
            ).otherwise(part),
        )
        return F.array_join(padded, "")

    lines = F.split(text, "[\r\n]", -1)
    if keep_first_line:
        done = F.transform(lines, lambda line, i: F.when(i == 0, line).otherwise(expand(line)))
    else:
        done = F.transform(lines, expand)
    return F.array_join(done, "\n")


def sql_literal(column: Column | str, kind: T.DataType) -> Column:
    """A value as SQL text: numbers bare, text and times quoted, others null."""
    c = as_column(column)

    def wrapped(inner: Column) -> Column:
        return F.concat(F.lit("'"), inner, F.lit("'"))

    if isinstance(kind, T.NumericType):
        text = c.cast("string")
    elif isinstance(kind, T.StringType):
        text = wrapped(F.replace(c, F.lit("'"), F.lit("''")))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = wrapped(stamp_text(c))
    elif isinstance(kind, T.DateType):
        text = wrapped(F.date_format(c, "yyyy-MM-dd"))
    elif type(kind).__name__ == "TimeType":
        text = wrapped(F.substring(c.cast("string"), 1, 8))
    elif isinstance(kind, T.BooleanType):
        text = c.cast("string")
    else:
        text = F.lit(None).cast("string")
    return F.coalesce(text, F.lit("null"))


def row_literal(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row as a parenthesised tuple of SQL literals."""
    names = columns or df.columns
    parts = [sql_literal(n, df.schema[n].dataType) for n in names]
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))
