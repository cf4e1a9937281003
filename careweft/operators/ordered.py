"""Previous-row and running values per key, also for keys of any size.

For ordinary keys these are plain windows over (key). A hot key is cut in
ordered ranges; windows then run per (key, range), each range is summarised in
one row, and the summaries (one per key and range) carry values across the
range ends. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careweft.functions.predicates import as_column
from careweft.operators.skew import (
    AUTO,
    CHUNK_ROWS,
    HOT_ROWS,
    SMALL_ROWS,
    HotKeys,
    hot_keys,
    ordered_ranges,
)

CHUNK = "_chunk"
WHOLE = -1  # range number of keys that are not cut


class OrderedKeys:
    """Rows in a total order per key. Methods return a new, extended value."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[Column | str],
        floor: int = HOT_ROWS,
        chunk_rows: int = CHUNK_ROWS,
        hot: HotKeys | None | object = AUTO,
    ):
        self.keys = list(keys)
        self.order = [as_column(o) for o in order]
        self.hot = hot_keys(df, keys, floor) if hot is AUTO else hot
        self.summaries = 0
        if self.hot is None:
            self._df = df
        else:
            rows = max(self.hot.rows, chunk_rows)
            large = df if self.hot.alone else self.hot.hot_part(df)
            cut, parts = ordered_ranges(large, keys, self.order, rows, chunk_rows, CHUNK)
            if self.hot.alone:
                self._df = cut
            else:
                whole = self.hot.cold_part(df).withColumn(CHUNK, F.lit(WHOLE))
                self._df = whole.unionByName(cut)
            # Ranges are contiguous, so a range end adds at most one more summary.
            self.summaries = parts + self.hot.rows // max(floor, 1) + 1

    def _with(self, df: DataFrame) -> OrderedKeys:
        other = object.__new__(OrderedKeys)
        other.__dict__.update(self.__dict__)
        other._df = df
        return other

    @property
    def frame(self) -> DataFrame:
        return self._df if self.hot is None else self._df.drop(CHUNK)

    def select(self, *columns: Column | str) -> OrderedKeys:
        """Project rows; the keys and order columns must stay."""
        extra = [] if self.hot is None else [CHUNK]
        return self._with(self._df.select(*columns, *extra))

    def with_columns(self, columns: Mapping[str, Column]) -> OrderedKeys:
        return self._with(self._df.withColumns(dict(columns)))

    def _window(self):
        parts = self.keys if self.hot is None else [*self.keys, CHUNK]
        return Window.partitionBy(*parts).orderBy(*self.order)

    def _attach(self, carry: DataFrame, names: Sequence[str]) -> DataFrame:
        """Join one carry row per (key, range) to the rows of that range."""
        right = carry.select(
            *[F.col(k).alias(f"_c_{i}") for i, k in enumerate(self.keys)],
            F.col(CHUNK).alias("_c_chunk"),
            *names,
        )
        if self.summaries <= SMALL_ROWS:
            right = F.broadcast(right)
        match = F.col(CHUNK) == F.col("_c_chunk")
        for i, k in enumerate(self.keys):
            match = match & F.col(k).eqNullSafe(F.col(f"_c_{i}"))
        return self._df.join(right, match, "left").drop(
            "_c_chunk", *[f"_c_{i}" for i in range(len(self.keys))]
        )

    def _ranges(self) -> DataFrame:
        return self._df.filter(F.col(CHUNK) != WHOLE)

    def previous(self, columns: Mapping[str, Column | str], flag: str | None = None) -> OrderedKeys:
        """Values of the row before; `flag` tells whether there is one."""
        values = F.struct(*[as_column(c).alias(n) for n, c in columns.items()])
        w = self._window()
        if self.hot is None:
            out = self._df.withColumn("_prev", F.lag(values).over(w))
        else:
            last = self._ranges().withColumn("_next", F.lead(F.lit(1)).over(w))
            by_range = Window.partitionBy(*self.keys).orderBy(CHUNK)
            tails = (
                last.filter(F.col("_next").isNull())
                .select(*self.keys, CHUNK, values.alias("_carry"))
                .withColumn("_carry", F.lag("_carry").over(by_range))
                .filter(F.col("_carry").isNotNull())
            )
            inside = self._with(
                self._df.withColumns(
                    {"_lag": F.lag(values).over(w), "_row": F.row_number().over(w)}
                )
            )
            out = inside._attach(tails, ["_carry"])
            out = out.withColumn(
                "_prev", F.when(F.col("_row") == 1, F.col("_carry")).otherwise(F.col("_lag"))
            ).drop("_lag", "_row", "_carry")
        new = {n: F.col("_prev")[n] for n in columns}
        if flag:
            new[flag] = F.col("_prev").isNotNull()
        return self._with(out.withColumns(new).drop("_prev"))

    def running(
        self,
        sums: Mapping[str, Column | str] | None = None,
        latest: Mapping[str, Column] | None = None,
    ) -> OrderedKeys:
        """Running values up to and including the row.

        `sums` are running sums. `latest` are running maxima; given a struct
        that starts with a rising row number and is null on unmarked rows, this
        is the latest marked row.
        """
        sums = {n: as_column(c) for n, c in (sums or {}).items()}
        latest = dict(latest or {})
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = {n: F.sum(c).over(w) for n, c in sums.items()}
        inside.update({n: F.max(c).over(w) for n, c in latest.items()})
        if self.hot is None:
            return self._with(self._df.withColumns(inside))

        totals = self._ranges().groupBy(*self.keys, CHUNK).agg(
            *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
            *[F.max(c).alias(f"_t_{n}") for n, c in latest.items()],
        )
        before = (
            Window.partitionBy(*self.keys)
            .orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        names = [f"_t_{n}" for n in (*sums, *latest)]
        carry = totals.withColumns(
            {
                **{f"_t_{n}": F.sum(f"_t_{n}").over(before) for n in sums},
                **{f"_t_{n}": F.max(f"_t_{n}").over(before) for n in latest},
            }
        )
        within = self._df.withColumns(inside)
        out = self._with(within)._attach(carry, names)
        merged = {}
        for n in sums:
            here, base = F.col(n), F.col(f"_t_{n}")
            both = F.when(here.isNull(), base).when(base.isNull(), here).otherwise(here + base)
            merged[n] = both.cast(within.schema[n].dataType)
        for n in latest:
            merged[n] = F.greatest(F.col(n), F.col(f"_t_{n}"))
        return self._with(out.withColumns(merged).drop(*names))


def add_group_index(
    df: DataFrame,
    sort: Sequence[Column | str],
    group_by: Sequence[str],
    name: str,
    base: int = 1,
    step: int = 1,
    tie_breaker: Sequence[Column | str] = (),
    floor: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """Number the rows of each group from `base` by `step`, in sort order.

    Column order: group columns, all others, the index. Types are kept. A sort
    that leaves ties makes the index arbitrary among them; name a tie breaker.
    """
    rows = OrderedKeys(df, group_by, [*sort, *tie_breaker], floor, chunk_rows, hot)
    numbered = rows.running(sums={"_rn": F.lit(1).cast("long")}).frame
    others = [c for c in df.columns if c not in set(group_by)]
    index = F.lit(base) + (F.col("_rn") - 1) * F.lit(step)
    return numbered.select(*group_by, *others, index.cast("long").alias(name))
