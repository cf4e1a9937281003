"""Chain assignment: cut an ordered sequence where each start names its length.

The first row starts episode 1 and takes its own `count` of rows, the next row
starts episode 2 with its own count, and so on. The start rows depend on each
other, which no plain window expresses.

Both ways below jump along "row + count" with doubled steps, in as many rounds as the logarithm of the
length: the m-th start is found from the jumps that the bits of m name.

* Chains of ordinary length are an array per chain; every round looks up one array in itself.
* Long chains are cut in ranges. A range says, for every row of its beginning at which an episode that came
  before may end, where the first start behind the range is and how many starts come before that: a table of
  jumps from range to range. Joins of this table with itself double the jumps, and the starts reached from the
  first row are marked. Then all ranges are numbered at the same time. No task sees more than a range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careweft.operators.ordered import AUTO, CHUNK
from careweft.operators.skew import CHUNK_ROWS, HotKeys, hot_keys, ordered_ranges
from careweft.session import cut_lineage

# Rows of one chain that are folded in memory.
CHAIN_ROWS = 50_000
UNLIMITED = 2**40


def assign_episode_chain(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    count: str,
    episode: str = "episode",
    position: str = "episode_seq",
    end: str = "episode_end",
    floor: int = CHAIN_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """Add episode number, row number in the episode and 1/0 end flag.

    `seq` orders the rows of a chain without ties. A count below 1 acts as 1; a
    null count never closes the episode. There is no cap on episodes.
    """
    keys = list(keys)
    if hot is AUTO:
        hot = hot_keys(df, keys, floor)
    if hot is None:
        return _fold(df, keys, seq, count, episode, position, end)
    short = _fold(hot.cold_part(df), keys, seq, count, episode, position, end)
    long = _ranges(
        hot.hot_part(df), keys, seq, count, episode, position, end, hot.rows, chunk_rows
    )
    return short.unionByName(long)


def _length(count: Column) -> Column:
    # `greatest` passes over nulls, so these are taken out first.
    return F.when(count.isNull(), F.lit(UNLIMITED).cast("long")).otherwise(
        F.greatest(count.cast("long"), F.lit(1).cast("long"))
    )


def _starts(rows: Column, count: str) -> Column:
    """Places (from 0) of the rows that start an episode, ascending."""
    n = F.size(rows).cast("long")
    levels = F.greatest(F.ceil(F.log2(n)), F.lit(0)).cast("int")
    # Behind the last row the jump stays where it is.
    after = F.concat(F.transform(rows, lambda r, i: F.least(i + _length(r[count]), n)), F.array(n))

    def doubled(jumps: Column, _: Column) -> Column:
        last = F.element_at(jumps, -1)
        return F.concat(jumps, F.array(F.transform(last, lambda x: F.get(last, x.cast("int")))))

    def reached(jumps: Column) -> Column:
        def nth(m: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(0), levels),
                F.lit(0).cast("long"),
                lambda at, bit: F.when(F.bit_get(m, bit) == 1, F.get(F.get(jumps, bit), at.cast("int"))).otherwise(at),
            )

        # The number of the last start: the longest way of doubled jumps that stays inside.
        last = F.aggregate(
            F.sequence(levels, F.lit(0), F.lit(-1)),
            F.struct(F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("at")),
            lambda way, bit: F.when(
                F.get(F.get(jumps, bit), way["at"].cast("int")) < n,
                F.struct(
                    (way["m"] + F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("m"),
                    F.get(F.get(jumps, bit), way["at"].cast("int")).alias("at"),
                ),
            ).otherwise(way),
            lambda way: way["m"],
        )
        return F.transform(F.sequence(F.lit(0).cast("long"), last), nth)

    all_jumps = F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), F.array(after), doubled)
    # An array of one binds the jumps; an optimiser would put their expression where they are used.
    return F.get(F.transform(F.array(all_jumps), reached), F.lit(0))


def _fold(
    df: DataFrame, keys: list[str], seq: str, count: str, episode: str, position: str, end: str
) -> DataFrame:
    others = [c for c in df.columns if c not in keys and c != seq]
    packed = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(seq, *others))).alias("_rows")
    )
    rows = F.col("_rows")
    starts = packed.withColumn("_starts", F.transform(_starts(rows, count), lambda at: at + 1))
    stop = F.size("_rows") + 1

    def rows_of(first: Column, i: Column) -> Column:
        upto = F.coalesce(F.get(F.col("_starts"), i + 1), stop.cast("long"))
        return F.slice(rows, first.cast("int"), (upto - first).cast("int"))

    episodes = starts.select(
        *keys, F.posexplode(F.transform("_starts", rows_of)).alias("_episode", "_members")
    )
    members = episodes.select(
        *keys,
        "_episode",
        F.size("_members").alias("_size"),
        F.posexplode("_members").alias("_pos", "_row"),
    )
    columns = {c: F.col("_row")[c].alias(c) for c in df.columns if c not in keys}
    return members.select(
        *[columns.get(c, F.col(c)) for c in df.columns],
        (F.col("_episode") + 1).cast("long").alias(episode),
        (F.col("_pos") + 1).cast("long").alias(position),
        F.when(F.col("_pos") + 1 == F.col("_size"), F.lit(1)).otherwise(F.lit(0)).alias(end),
    )


def _ranges(
    df: DataFrame,
    keys: list[str],
    seq: str,
    count: str,
    episode: str,
    position: str,
    end: str,
    rows: int,
    chunk_rows: int,
) -> DataFrame:
    cut, _ = ordered_ranges(df, keys, [F.col(seq)], rows, chunk_rows, CHUNK)
    narrow = cut.select(*keys, CHUNK, F.col(seq).alias("_seq"), _length(F.col(count)).alias("_len"))
    # No open episode can have more rows to come than the largest finite count.
    widest = narrow.filter(F.col("_len") < UNLIMITED).agg(F.max("_len").alias("m")).first()["m"]
    widest = int(widest or 1)
    key_fields = [df.schema[k] for k in keys]
    long = T.LongType()
    jump_columns = ["at", "to", "started", "last"]

    def jumps(pdf: pd.DataFrame) -> pd.DataFrame:
        """From each of the first rows: the first start behind the range, starts until then, the last of them."""
        length = pdf.sort_values("_seq")["_len"].to_numpy()
        n = len(length)
        to, started, last = (np.zeros(n, dtype=np.int64) for _ in range(3))
        for i in range(n - 1, -1, -1):
            after = i + int(length[i])
            if after >= n:
                to[i], started[i], last[i] = after, 1, i
            else:
                to[i], started[i], last[i] = to[after], started[after] + 1, last[after]
        m = min(n, widest)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * m for k in [*keys, CHUNK]})
        return out.assign(at=np.arange(m), to=to[:m], started=started[:m], last=last[:m])

    jump_type = T.StructType(
        [*key_fields, T.StructField(CHUNK, T.IntegerType()), *[T.StructField(c, long) for c in jump_columns]]
    )
    in_key = Window.partitionBy(*keys).orderBy(CHUNK)
    before = in_key.rowsBetween(Window.unboundedPreceding, -1)
    # A row per range.
    ranges = cut_lineage(
        narrow.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("rows")).withColumns(
            {
                "base": F.coalesce(F.sum("rows").over(before), F.lit(0)),
                "number": F.row_number().over(in_key),
                "is_last": F.lead(F.lit(1)).over(in_key).isNull(),
            }
        )
    )
    found = _matched(narrow.groupBy(*keys, CHUNK).applyInPandas(jumps, jump_type), ranges, [*keys, CHUNK], ["base"])
    # From here on places are counted from the first row of the chain.
    found = cut_lineage(found.withColumns({c: F.col(c) + F.col("base") for c in ("at", "to", "last")}))
    rounds = int(ranges.agg(F.max("number")).first()[0]).bit_length()
    step = found.select(*keys, "at", "to", "started")
    marked = found.filter(F.col("at") == 0).select(*keys, "at", F.lit(0).cast("long").alias("done"))
    for i in range(rounds):
        next_ = _matched(marked, step, [*keys, "at"], ["to", "started"], "inner").select(
            *keys, F.col("to").alias("at"), (F.col("done") + F.col("started")).alias("done")
        )
        marked = cut_lineage(marked.unionByName(next_))
        if i + 1 < rounds:
            second = step.select(*keys, F.col("at").alias("to"), F.col("to").alias("_to"), F.col("started").alias("_started"))
            both = _matched(step, second, [*keys, "to"], ["_to", "_started"], "inner")
            step = cut_lineage(
                both.select(*keys, "at", F.col("_to").alias("to"), (F.col("started") + F.col("_started")).alias("started"))
            )
    # What an open episode brings into each range: from the latest range that was entered by a start.
    entered = _matched(marked, found, [*keys, "at"], [CHUNK, "to", "started", "last"], "inner")
    entered = entered.select(*keys, CHUNK, F.struct("to", (F.col("done") + F.col("started")).alias("done"), "last").alias("carry"))
    latest = F.last("carry", ignorenulls=True).over(before)
    carried = _matched(ranges, entered, [*keys, CHUNK], ["carry"]).withColumn("carry", latest)
    carried = carried.select(
        *keys, CHUNK, "base", "is_last", F.coalesce("carry.to", F.lit(0)).alias("entry"),
        F.coalesce("carry.done", F.lit(0)).alias("done"), F.coalesce("carry.last", F.lit(0)).alias("open"),
    )

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        length = pdf["_len"].to_numpy()
        n, base = len(length), int(pdf["base"].iloc[0])
        is_start = np.zeros(n, dtype=np.int64)
        at = int(pdf["entry"].iloc[0]) - base
        while at < n:
            is_start[at] = 1
            at += int(length[at])
        index = np.arange(n)
        first = np.maximum.accumulate(np.where(is_start == 1, index, -1))
        inside = np.where(first >= 0, index - first + 1, index + base - int(pdf["open"].iloc[0]) + 1)
        closes = at == n or bool(pdf["is_last"].iloc[0])
        out = pdf[[*keys, "_seq"]].copy()
        out[episode] = int(pdf["done"].iloc[0]) + np.cumsum(is_start)
        out[position] = inside
        out[end] = np.append(is_start[1:], 1 if closes else 0).astype(np.int32)
        return out

    number_type = T.StructType(
        [
            *key_fields,
            T.StructField("_seq", df.schema[seq].dataType),
            T.StructField(episode, long),
            T.StructField(position, long),
            T.StructField(end, T.IntegerType()),
        ]
    )
    numbered = (
        _matched(narrow, carried, [*keys, CHUNK], ["base", "is_last", "entry", "done", "open"])
        .groupBy(*keys, CHUNK)
        .applyInPandas(number, number_type)
    )
    labelled = _matched(cut.withColumn("_seq", F.col(seq)), numbered, [*keys, "_seq"], [episode, position, end])
    return labelled.select(*df.columns, episode, position, end)


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str], take: Sequence[str], how: str = "left") -> DataFrame:
    """Columns of the right side's row with the same keys; null keys match."""
    named = right.select(*[F.col(k).alias(f"_m_{i}") for i, k in enumerate(on)], *take)
    tests = [F.col(k).eqNullSafe(F.col(f"_m_{i}")) for i, k in enumerate(on)]
    return left.join(named, reduce(lambda a, b: a & b, tests), how).drop(*[f"_m_{i}" for i in range(len(on))])
