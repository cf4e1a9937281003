"""Local rows as a table, and filters by a list of keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from careweft.operators.skew import SMALL_ROWS, lookup_join
from careweft.sources.tables import replace_table

# Places of the bitmap that sifts facts.
SIFT_PLACES = 1 << 26


def values_df(
    spark: SparkSession,
    rows: Iterable[Sequence],
    schema: StructType | str,
    distinct: bool = False,
    include_empty_rows: bool = False,
    into: str | None = None,
) -> DataFrame:
    """Rows given by the caller as a table; rows of nulls only are dropped.

    No rows give an empty table with the schema. `into` saves the result under
    that name, replacing an older table.
    """
    df = spark.createDataFrame(list(rows), schema)
    if distinct:
        df = df.distinct()
    if not include_empty_rows:
        df = df.dropna(how="all")
    return replace_table(df, into) if into else df


def sift(facts: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Fact rows whose key may be in the list: all that are, and few others.

    Hashes of the keys set bits of a bitmap of 2**26 places, whatever the number of keys: at most 2,048
    rows of 4,096 bytes, 8 MB, which are broadcast. Facts meet their row of it where they are, before any
    shuffle. A list of 500,000 keys lets one in 130 of the other facts pass, one of 50 million every second.
    """
    place = F.pmod(F.xxhash64(*[F.col(c) for c in on]), F.lit(SIFT_PLACES)) + 1
    numbered = keys.select(place.alias("_place")).select(
        F.bitmap_bucket_number("_place").alias("_row"), F.bitmap_bit_position("_place").alias("_bit")
    )
    bitmap = numbered.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    placed = facts.withColumns({"_at": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = placed.join(F.broadcast(bitmap), F.col("_at") == F.col("_row"))
    return met.filter(F.bit_get(byte.cast("long"), F.col("_bit").cast("int") % 8) == 1).select(*facts.columns)


def in_population(
    facts: DataFrame, population: DataFrame, on: Sequence[str], small: int = SMALL_ROWS
) -> DataFrame:
    """Fact rows whose key is in the population list.

    The list is counted, up to `small` rows and one. Up to `small` it is broadcast and the facts
    stay in place. For a longer one, facts are sifted by a bitmap of its keys where they are; what is left is
    joined, with large keys taken apart.
    """
    keys = population.select(*on).dropna().distinct()
    if keys.limit(small + 1).count() <= small:
        return facts.join(F.broadcast(keys), list(on), "left_semi")
    return lookup_join(sift(facts, keys, on), keys, on, "left_semi")
