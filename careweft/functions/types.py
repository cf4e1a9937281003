"""Type names as text, for catalog searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careweft.functions.predicates import as_column

# Type families that show precision, scale or length.
WITH_PRECISION = ["float", "decimal", "numeric"]
WITH_SCALE = ["decimal", "numeric"]
WITH_LENGTH = ["binary", "varbinary", "image", "char", "nchar", "varchar", "nvarchar", "xml"]


def render_data_type(
    name: Column | str,
    base: Column | str,
    precision: Column | str,
    scale: Column | str,
    length: Column | str,
) -> Column:
    """`name(precision, scale, length)` by family of the base type; length -1 is max."""
    name, base = as_column(name), as_column(base)
    precision, scale, length = as_column(precision), as_column(scale), as_column(length)
    sized = base.isin(WITH_PRECISION + WITH_LENGTH) & (
        (precision != 0) | (scale != 0) | (length != 0)
    )
    inner = F.concat_ws(
        ", ",
        F.when(base.isin(WITH_PRECISION), precision.cast("string")),
        F.when(base.isin(WITH_SCALE), scale.cast("string")),
        F.when(length == -1, F.lit("max")).when(base.isin(WITH_LENGTH), length.cast("string")),
    )
    return F.concat(
        name,
        F.when(sized, F.lit("(")).otherwise(F.lit("")),
        inner,
        F.when(sized, F.lit(")")).otherwise(F.lit("")),
    )


def type_parts(kind: T.DataType) -> tuple[str, int, int, int]:
    """Type name, precision, scale and length of a Spark type (strings are max)."""
    if isinstance(kind, T.DecimalType):
        return "decimal", kind.precision, kind.scale, 0
    if isinstance(kind, (T.VarcharType, T.CharType)):
        return ("varchar" if isinstance(kind, T.VarcharType) else "char"), 0, 0, kind.length
    return kind.simpleString(), 0, 0, 0
