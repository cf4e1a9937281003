"""Numbered column groups and role-tagged column groups to rows, in one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweft.functions.names import quote_name
from careweft.functions.predicates import any_not_null, as_column


def unpivot_slots(
    df: DataFrame,
    id_cols: Sequence[str],
    fields: Mapping[str, str],
    n: int,
    slot: str = "slot",
    text_slot: bool = False,
    keep_if: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame:
    """k fields in n numbered columns each become rows with a slot number.

    `fields` maps an output column to a pattern such as `"code_{i}"`. A slot is
    kept when any of its fields holds a value. One scan feeds one generator; a
    union of n projections would scan n times. Empty slots are dropped inside
    the array, before rows are made.

    `keep_if` reproduces filters that look at another slot: it maps a field to
    slots which test that field of slot 1 in place of their own.
    """
    keep_if = keep_if or {}
    # One SQL expression: building it from single column objects takes longer
    # than running it on a small table.
    slots = []
    for i in range(1, n + 1):
        number = f"'{i}'" if text_slot else str(i)
        values = [f"{quote_name(p.format(i=i))} AS {quote_name(f)}" for f, p in fields.items()]
        tested = [
            quote_name(p.format(i=1 if i in keep_if.get(f, ()) else i)) for f, p in fields.items()
        ]
        filled = " OR ".join(f"{c} IS NOT NULL" for c in tested)
        row = ", ".join([f"{number} AS {quote_name(slot)}", *values])
        slots.append(f"CASE WHEN {filled} THEN struct({row}) END")
    rows = df.selectExpr(
        *[quote_name(c) for c in id_cols], f"inline(array_compact(array({', '.join(slots)})))"
    )
    return rows.select(*id_cols, slot, *fields)


def unpivot_roles(
    df: DataFrame,
    id_cols: Sequence[str],
    roles: Sequence[tuple[Mapping[str, Column | str | None], Sequence[Column | str]]],
) -> DataFrame:
    """Several projections of one table, stacked in one scan.

    Each role is (output columns, columns tested for a value). None stands for
    a null text.
    """
    names = list(roles[0][0])
    branches = []
    for columns, tested in roles:
        if list(columns) != names:
            raise ValueError("all roles need the same output columns in the same order")
        values = [
            (F.lit(None) if c is None else as_column(c)).cast("string").alias(n)
            for n, c in columns.items()
        ]
        branches.append(F.when(any_not_null(tested), F.struct(*values)))
    return df.select(*id_cols, F.explode(F.array_compact(F.array(*branches))).alias("_r")).select(
        *id_cols, *[f"_r.{n}" for n in names]
    )


def keep_any_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows in which all the columns are null."""
    return df.filter(any_not_null([F.col(f"`{c}`") for c in columns]))
