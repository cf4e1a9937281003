"""One profile row per column of a table."""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careweft.functions.names import quote_name

# Values longer than this are grouped by their digest.
DIGEST_OVER = 64


def value_text(name: str, kind: T.DataType) -> Column:
    """A column value as text; equal values give equal text."""
    c = F.col(quote_name(name))
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
    return c.cast("string")


def _scale(kind: T.DataType) -> int | None:
    """Decimal places of whole and decimal numbers."""
    if isinstance(kind, T.DecimalType):
        return kind.scale
    return 0 if isinstance(kind, T.IntegralType) else None


def _with_point(unscaled: str, scale: str) -> Column:
    """Text of a number from its digits and its decimal places."""
    plain = F.abs(unscaled).cast("string")
    digits = F.lpad(plain, F.greatest(F.length(plain), F.col(scale) + 1), "0")
    whole = F.left(digits, F.length(digits) - F.col(scale))
    rest = F.when(F.col(scale) > 0, F.concat(F.lit("."), F.right(digits, F.col(scale)))).otherwise("")
    return F.concat(F.when(F.col(unscaled) < 0, "-").otherwise(""), whole, rest)


# A double is a whole number times a power of two; those in one limb of so many powers are added up together.
LIMB = 32


def _limb_of(number: Column) -> tuple[Column, Column]:
    """The limb of a finite double, and how often it holds 2**(LIMB * limb): a whole number of at most 87 bits."""
    low = F.floor(F.log2(F.abs(number))) - 54  # at or below the last bit; the logarithm may be off by one
    limb = F.floor(low / LIMB)
    half = F.floor(low / 2)
    # In two steps, as neither power alone may be a double.
    whole = number * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - low)
    shifted = whole.cast("long").cast("decimal(20,0)") * F.pow(F.lit(2.0), low - limb * LIMB).cast("long").cast("decimal(10,0)")
    usable = number.isNotNull() & (number != 0) & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(usable, limb.cast("int")), F.when(usable, shifted)


@F.pandas_udf(T.DoubleType())
def _exact_mean(limbs: pd.Series, counts: pd.Series) -> pd.Series:
    """The double nearest to the sum of limbs by the count; a row per column."""

    def mean(parts, n) -> float | None:
        if parts is None or n is None or pd.isna(n) or not n:
            return None
        total = sum((int(p["sum"]) * Fraction(2) ** (LIMB * int(p["limb"])) for p in parts), Fraction(0)) / int(n)
        try:
            return float(total)
        except OverflowError:
            return math.copysign(math.inf, total)

    return pd.Series([mean(p, n) for p, n in zip(limbs, counts)], dtype="float64")


def profile_table(df: DataFrame) -> DataFrame:
    """Counts, extremes, frequencies and lengths of every column, in one scan.

    Rows are turned to (column, value) pairs and counted twice: per pair, then
    per column. Both steps combine map-side, so neither a frequent value nor a
    column gathers in one task. Long values travel as a 256-bit digest with
    their length. Null is a value for the frequencies and the unique count, not
    for the distinct count. Minimum, maximum and average are for numbers only, as
    doubles; whole and decimal numbers also have their exact extremes as text,
    compared by their digits. Averages are those of exact sums, so they do not depend on
    how rows are partitioned: doubles are added up as whole numbers, by limbs of their exponents.
    """
    fields = df.schema.fields
    pairs = [
        F.struct(F.lit(i).alias("ordinal"), value_text(f.name, f.dataType).alias("text"))
        for i, f in enumerate(fields, start=1)
    ]
    numeric = [i for i, f in enumerate(fields, 1) if isinstance(f.dataType, T.NumericType)]
    texts = [i for i, f in enumerate(fields, 1) if isinstance(f.dataType, T.StringType)]

    values = (
        df.select(F.explode(F.array(*pairs)).alias("p"))
        .select(
            "p.ordinal",
            F.when(F.length("p.text") > DIGEST_OVER, F.sha2("p.text", 256))
            .otherwise(F.col("p.text"))
            .alias("value"),
            F.length("p.text").alias("length"),
        )
        .groupBy("ordinal", "value", "length")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "number", F.when(F.col("ordinal").isin(numeric), F.col("value").try_cast("double"))
        )
    )
    n, value, length, number = (F.col(c) for c in ("n", "value", "length", "number"))
    exact = [i for i, f in enumerate(fields, 1) if _scale(f.dataType) is not None]
    unscaled = F.when(F.col("ordinal").isin(exact), F.replace("value", F.lit("."), F.lit("")).try_cast("decimal(38,0)"))
    is_empty = value.isNull() | (F.col("ordinal").isin(texts) & (value == ""))
    limb, part = _limb_of(number)
    # A row per column and limb: a few for each column.
    limbs = values.withColumns({"limb": limb, "part": part}).groupBy("ordinal", "limb").agg(
        F.sum(n).alias("total_count"),
        F.count(value).alias("distinct_count"),
        F.count_if(n == 1).alias("unique_count"),
        F.sum(F.when(value.isNull(), n).otherwise(0)).alias("null_count"),
        F.sum(F.when(is_empty, n).otherwise(0)).alias("empty_count"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
        F.min(unscaled).alias("lowest"),
        F.max(unscaled).alias("highest"),
        F.sum(F.col("part") * n.cast("decimal(18,0)")).cast("string").alias("sum"),
        F.sum(F.when(number.isNotNull(), n)).alias("numbers"),
        # Values without a sum: NaN and the infinities.
        F.sum(F.when(F.isnan(number) | (F.abs(number) == float("inf")), number)).alias("odd"),
        F.max(n).alias("mode_frequency"),
        F.min(n).alias("anti_mode_frequency"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.sum(length * n).alias("lengths"),
        F.sum(F.when(length.isNotNull(), n)).alias("with_length"),
    )
    added = ["total_count", "distinct_count", "unique_count", "null_count", "empty_count"]
    united = limbs.groupBy("ordinal").agg(
        *[F.sum(c).alias(c) for c in added],
        *[F.min(c).alias(c) for c in ("min_value", "lowest", "anti_mode_frequency", "min_length")],
        *[F.max(c).alias(c) for c in ("max_value", "highest", "mode_frequency", "max_length")],
        F.collect_list(F.when(F.col("limb").isNotNull(), F.struct("limb", "sum"))).alias("limbs"),
        F.sum("numbers").alias("numbers"),
        F.sum("odd").alias("odd"),
        (F.sum("lengths") / F.sum("with_length")).alias("average_length"),
    )
    average = F.coalesce("odd", _exact_mean("limbs", "numbers")).alias("average")
    stats = united.select(
        "ordinal", *added, "min_value", "max_value", "lowest", "highest", average,
        "mode_frequency", "anti_mode_frequency", "min_length", "max_length", "average_length",
    )
    names = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), _scale(f.dataType)) for i, f in enumerate(fields, 1)],
        "ordinal_position int, column_name string, data_type string, scale int",
    )
    # `stats` has at most one row per column.
    joined = names.join(F.broadcast(stats), F.col("ordinal_position") == F.col("ordinal"), "left")
    counts = ["total_count", "distinct_count", "unique_count", "null_count", "empty_count"]
    return joined.select(
        "column_name",
        "ordinal_position",
        "data_type",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        *[c for c in stats.columns if c not in [*counts, "ordinal", "lowest", "highest"]],
        _with_point("lowest", "scale").alias("min_text"),
        _with_point("highest", "scale").alias("max_text"),
    )
