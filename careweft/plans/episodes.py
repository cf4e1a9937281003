"""Claims to stays to episodes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweft.functions.predicates import as_column
from careweft.operators.chains import CHAIN_ROWS, assign_episode_chain
from careweft.operators.ordered import AUTO, OrderedKeys
from careweft.operators.skew import CHUNK_ROWS, HOT_ROWS, HotKeys, hot_keys
from careweft.session import cut_lineage

BETWEEN_DATES = ";\n"


@dataclass(frozen=True)
class ClaimColumns:
    """Names of the claim columns; `seq` numbers the claims of a key without gaps."""

    key: str = "mbi"
    provider: str = "provider"
    seq: str = "seq"
    from_dt: str = "from_dt"
    thru_dt: str = "thru_dt"
    days: str = "days"
    amount: str = "pmt"


def service_days(from_dt: Column | str, thru_dt: Column | str) -> Column:
    """Days from first to last service date, both counted."""
    return F.datediff(as_column(thru_dt), as_column(from_dt)) + 1


def stay_flag(
    df: DataFrame,
    key: str,
    order: Sequence[Column | str],
    is_type: Column,
    provider: str,
    from_dt: str,
    thru_dt: str,
    gap_days: int = 5,
    out: str = "stay_flag",
    floor: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """1 where a stay begins, 0 where it goes on, null where the claim is no stay.

    A claim goes on with a stay when the claim right before it (of any type) is
    of the type too, has the same provider and ended at most `gap_days` earlier.
    """
    rows = OrderedKeys(df.withColumn("_is", is_type), [key], order, floor, chunk_rows, hot)
    rows = rows.previous(
        {"_was": "_is", "_provider": provider, "_thru": thru_dt}, flag="_has"
    )
    this = F.coalesce(F.col("_is"), F.lit(False))
    has = F.col("_has") & F.col(key).isNotNull()
    goes_on = (
        has
        & F.coalesce(F.col("_was"), F.lit(False))
        & this
        & (F.col(provider) == F.col("_provider"))
        & (F.datediff(from_dt, "_thru") <= gap_days)
    )
    flag = F.when(goes_on, F.lit(0)).when(this, F.lit(1))
    return rows.frame.withColumn(out, flag).drop("_is", "_was", "_provider", "_thru", "_has")


def _anchored(rows: OrderedKeys, c: ClaimColumns, gap: int) -> OrderedKeys:
    rows = rows.previous({"_seq": c.seq, "_provider": c.provider, "_thru": c.thru_dt})
    follows = (
        (F.col("_seq") == F.col(c.seq) - 1)
        & (F.col("_provider") == F.col(c.provider))
        & (F.col("_thru") >= F.date_add(c.from_dt, -gap))
        & F.col(c.key).isNotNull()
    )
    anchor = F.when(F.coalesce(follows, F.lit(False)), F.lit(0)).otherwise(F.lit(1))
    return rows.with_columns({"is_anchor": anchor})


def chain_anchors(
    df: DataFrame,
    columns: ClaimColumns = ClaimColumns(),
    gap: int = 61,
    floor: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """Claims without a predecessor: no claim numbered one less of the same key
    and provider that ended within `gap` days before this one began."""
    rows = OrderedKeys(df, [columns.key], [columns.seq], floor, chunk_rows, hot)
    found = _anchored(rows, columns, gap).frame
    return found.filter(F.col("is_anchor") == 1).select(*df.columns)


def assign_stays(
    df: DataFrame,
    columns: ClaimColumns = ClaimColumns(),
    gap: int = 61,
    floor: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """Add the stay number of the key, the anchor's dates and provider, and the
    claim's place in the stay."""
    c = columns
    rows = _anchored(OrderedKeys(df, [c.key], [c.seq], floor, chunk_rows, hot), c, gap)
    rows = rows.running(sums={"stay_id": F.col("is_anchor").cast("long"), "_row": F.lit(1)})
    anchor = F.struct(
        F.col("_row").alias("row"),
        F.col(c.from_dt).alias("from_dt"),
        F.col(c.thru_dt).alias("thru_dt"),
        F.col(c.provider).alias("provider"),
    )
    rows = rows.running(latest={"_anchor": F.when(F.col("is_anchor") == 1, anchor)})
    return rows.frame.select(
        *df.columns,
        "is_anchor",
        "stay_id",
        (F.col("_row") - F.col("_anchor.row") + 1).alias("stay_pos"),
        F.col("_anchor.from_dt").alias("stay_from_dt"),
        F.col("_anchor.thru_dt").alias("stay_thru_dt"),
        F.col("_anchor.provider").alias("stay_provider"),
    )


def episode_claim_counts(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    days: str,
    limit: int = 60,
    out: str = "claim_count",
    floor: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """How many claims an episode starting here holds, this one included.

    Claims are taken while their running days stay within `limit`; a claim that
    is longer on its own still counts. Each claim puts two marks on the axis of
    running days: where it ends, and how far an episode starting with it may
    reach. The number of ends up to the second mark is a running sum, so no
    claim looks at a range of others. Negative days count as none. Where a
    claim without days is met, the total is unknown from there on and the
    episode is never closed: the count is null.
    """
    day = F.greatest(F.coalesce(F.col(days).cast("long"), F.lit(0)), F.lit(0).cast("long"))
    missing = F.col(days).isNull().cast("long")
    rows = OrderedKeys(df, keys, [seq], floor, chunk_rows, hot).running(
        sums={"_row": F.lit(1), "_end": day, "_missing": missing}
    )
    marks = rows.frame.withColumn(
        "_mark",
        F.explode(
            F.array(
                F.struct(F.col("_end").alias("at"), F.lit(0).alias("kind")),
                F.struct((F.col("_end") - day + limit).alias("at"), F.lit(1).alias("kind")),
            )
        ),
    ).withColumns({"_at": F.col("_mark.at"), "_kind": F.col("_mark.kind")})
    is_end = 1 - F.col("_kind")
    axis = OrderedKeys(
        marks, keys, ["_at", "_kind", "_row"], floor, chunk_rows, rows.hot
    ).running(
        sums={"_ends": is_end, "_ends_missing": is_end * missing}
    )
    taken = F.greatest(F.col("_ends") - F.col("_row") + 1, F.lit(1))
    unknown = F.col("_ends_missing") - (F.col("_missing") - missing) > 0
    return (
        axis.frame.filter(F.col("_kind") == 1)
        .withColumn(out, F.when(~unknown, taken.cast("long")))
        .select(*df.columns, out)
    )


def build_episodes(
    df: DataFrame,
    columns: ClaimColumns = ClaimColumns(),
    limit: int = 60,
    gap: int = 61,
    floor: int = HOT_ROWS,
    chain_floor: int = CHAIN_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    large: HotKeys | None | object = AUTO,
) -> DataFrame:
    """Walk the claims of each stay and cut them in episodes of `limit` days.

    A claim that would push the running service days over the limit starts a
    recertification episode; totals restart there. One row per claim with the
    running values of its episode; `service_dates` adds the list of dates so far. All steps
    share one shuffle by key unless a key is too large for a task. `large`: keys above `chain_floor`, if known.
    """
    large = hot_keys(df, [columns.key], chain_floor) if large is AUTO else large
    return _episode_rows(df, columns, limit, gap, floor, chain_floor, chunk_rows, large)


def _episode_rows(
    df: DataFrame,
    c: ClaimColumns,
    limit: int,
    gap: int,
    floor: int,
    chain_floor: int,
    chunk_rows: int,
    large: HotKeys | None,
) -> DataFrame:
    # A stay belongs to one key, so without large keys there are no large stays.
    very_large = None if large is None else AUTO
    stays = assign_stays(df, c, gap, floor, chunk_rows, very_large)
    if large is not None:
        stays = cut_lineage(stays)
    stay = [c.key, "stay_id"]
    counted = episode_claim_counts(
        stays, stay, "stay_pos", c.days, limit, "_count", floor, chunk_rows, very_large
    )
    chain = assign_episode_chain(
        counted, stay, "stay_pos", "_count", "stay_seq", "epsd_seq", "epsd_end",
        chain_floor, chunk_rows, very_large,
    )
    if large is not None:
        chain = cut_lineage(chain)
    first = F.struct(
        F.col(c.from_dt).alias("from_dt"),
        F.col(c.thru_dt).alias("thru_dt"),
        F.col(c.provider).alias("provider"),
    )
    episode = [*stay, "stay_seq"]
    dates = F.concat_ws(
        " - ", F.date_format(c.from_dt, "yyyy-MM-dd"), F.date_format(c.thru_dt, "yyyy-MM-dd")
    )
    rows = OrderedKeys(chain, episode, ["epsd_seq"], floor, chunk_rows, very_large).running(
        sums={
            "_days": F.col(c.days).cast("long"),
            "_amount": F.col(c.amount),
            "_no_days": F.col(c.days).isNull().cast("long"),
            "_no_amount": F.col(c.amount).isNull().cast("long"),
            "_dates_end": F.length(dates) + F.lit(len(BETWEEN_DATES)).cast("long"),
        },
        latest={"_first": F.when(F.col("epsd_seq") == 1, first)},
    )
    return rows.frame.select(
        *df.columns,
        "is_anchor",
        "stay_id",
        "stay_pos",
        "stay_from_dt",
        "stay_thru_dt",
        "stay_provider",
        F.year("stay_from_dt").alias("stay_year"),
        "stay_seq",
        "epsd_seq",
        F.when(F.col("stay_seq") == 1, F.lit("Initial"))
        .otherwise(F.lit("Recertification"))
        .alias("epsd_type"),
        F.col("_first.from_dt").alias("epsd_from_dt"),
        F.col("_first.thru_dt").alias("epsd_first_thru_dt"),
        F.col("_first.provider").alias("epsd_provider"),
        F.col(c.thru_dt).alias("epsd_thru_dt"),
        dates.alias("epsd_dates"),
        (F.col("_dates_end") - len(BETWEEN_DATES)).alias("epsd_dates_end"),
        F.when(F.col("_no_days") == 0, F.col("_days")).alias("epsd_days"),
        F.when(F.col("_no_amount") == 0, F.col("_amount")).alias("epsd_amount"),
        F.col("epsd_seq").alias("epsd_claim_count"),
        "epsd_end",
    )


def _dates_text(rows: Column) -> Column:
    """Service dates of rows (`epsd_seq`, `epsd_dates`) in order, each once."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["epsd_dates"]), BETWEEN_DATES)


def service_dates(
    rows: DataFrame, columns: ClaimColumns = ClaimColumns(), out: str = "epsd_service_dates"
) -> DataFrame:
    """Add the service dates of the episode up to each row, to rows of `build_episodes`.

    The text of an episode is built once; a row takes as much of it as its
    `epsd_dates_end` says. Asked for all rows, this is as long as all prefixes together:
    filter the rows of the result, or take `episode_table` for one text per episode.
    """
    episode = [columns.key, "stay_id", "stay_seq"]
    others = [c for c in rows.columns if c not in episode]
    first = F.struct(*[F.col(c).alias(c) for c in ("epsd_seq", *[o for o in others if o != "epsd_seq"])])
    packed = rows.groupBy(*episode).agg(F.collect_list(first).alias("_rows"))
    texts = packed.withColumn("_text", _dates_text(F.transform("_rows", lambda r: F.struct(r["epsd_seq"], r["epsd_dates"]))))
    listed = texts.select(*episode, "_text", F.explode("_rows").alias("_row"))
    prefix = F.substring(F.col("_text"), F.lit(1), F.col("_row.epsd_dates_end").cast("int"))
    columns_ = [F.col(c) if c in episode else F.col("_row")[c].alias(c) for c in rows.columns]
    return listed.select(*columns_, prefix.alias(out))


def episodes_only(
    rows: DataFrame,
    columns: ClaimColumns = ClaimColumns(),
    floor: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    hot: HotKeys | None | object = AUTO,
    dates: bool = True,
) -> DataFrame:
    """One row per episode from the rows of `build_episodes`, with the end of
    the stay and a 1/0 flag on its last episode. `dates`: with all service dates of the
    episode, which have to be gathered from its rows."""
    last = F.struct(F.col("stay_pos"), F.col(columns.thru_dt).alias("thru_dt"))
    ends = OrderedKeys(
        rows, [columns.key, "stay_id"], [F.col("stay_pos").desc()], floor, chunk_rows, hot
    ).running(latest={"_last": last})
    stay_end = (F.col("_last.stay_pos") == F.col("stay_pos")).cast("int")
    if not dates:
        closed = ends.frame.filter(F.col("epsd_end") == 1)
        closed = closed.withColumns({"stay_end": stay_end, "stay_end_dt": F.col("_last.thru_dt")})
        return closed.drop("_last", "epsd_dates", "epsd_dates_end")
    # The last row of each episode and the text of all its dates, in one pass.
    last_row = F.max_by(F.struct(*[F.col(c) for c in ends.frame.columns]), F.col("epsd_seq"))
    episode = [columns.key, "stay_id", "stay_seq"]
    closed = ends.frame.groupBy(*episode).agg(
        last_row.alias("_end"), F.collect_list(F.struct("epsd_seq", "epsd_dates")).alias("_dates")
    )
    return (
        closed.select("_end.*", _dates_text(F.col("_dates")).alias("epsd_service_dates"))
        .withColumns({"stay_end": stay_end, "stay_end_dt": F.col("_last.thru_dt")})
        .drop("_last", "epsd_dates", "epsd_dates_end")
    )


def episode_table(
    df: DataFrame,
    columns: ClaimColumns = ClaimColumns(),
    limit: int = 60,
    gap: int = 61,
    floor: int = HOT_ROWS,
    chain_floor: int = CHAIN_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    large: HotKeys | None | object = AUTO,
    dates: bool = True,
) -> DataFrame:
    """Claims to one row per episode. Large keys are looked for once, in the
    claims, and not again in what is computed from them."""
    large = hot_keys(df, [columns.key], chain_floor) if large is AUTO else large
    rows = _episode_rows(df, columns, limit, gap, floor, chain_floor, chunk_rows, large)
    if large is not None:
        rows = cut_lineage(rows)
    return episodes_only(rows, columns, floor, chunk_rows, None if large is None else AUTO, dates)


def first_row_values(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    values: Sequence[str],
    prefix: str = "first_",
    floor: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """Values of the row numbered 1 on every row of its key: a self join to one
    anchor row, done as a running value."""
    anchor = F.when(F.col(seq) == 1, F.struct(*[F.col(v).alias(v) for v in values]))
    rows = OrderedKeys(df, keys, [seq], floor, chunk_rows, hot).running(latest={"_a": anchor})
    return rows.frame.filter(F.col("_a").isNotNull()).select(
        *df.columns, *[F.col("_a")[v].alias(f"{prefix}{v}") for v in values]
    )


def episode_chain_step(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    count: str,
    step: int,
    episode: str = "episode",
    end: str = "episode_end",
    floor: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """One iteration of chain assignment: number episode `step`, mark the first
    row of the next.

    Step 1 starts from unnumbered rows. Later steps group the rows that are
    still open together with the start row left by the step before. The library
    uses `assign_episode_chain`, which needs no iteration.
    """
    if step == 1:
        rows = first_row_values(df, keys, seq, [count], "_first_", floor, chunk_rows, hot)
        last = F.col(f"_first_{count}")
        return (
            rows.withColumn(
                episode, F.when(F.col(seq) <= last, 1).when(F.col(seq) == last + 1, 2)
            )
            .withColumn(end, F.when(F.col(seq) == last, 1).when(F.col(seq) < last, 0))
            .drop(f"_first_{count}")
        )
    opened = df.withColumn("_open", F.coalesce(F.col(episode), F.lit(step)) == step)
    first = F.struct((-F.col(seq)).alias("o"), F.col(seq).alias("s"), F.col(count).alias("n"))
    # A part of a key is no larger than the key: without large keys there is none here.
    parts = None if hot is None else AUTO
    rows = OrderedKeys(opened, [*keys, "_open"], [seq], floor, chunk_rows, parts).running(
        latest={"_f": first}
    )
    last = F.col("_f.s") + F.col("_f.n") - 1
    number = (
        F.when(F.col(episode).isNotNull(), F.col(episode))
        .when(F.col(seq) <= last, step)
        .when(F.col(seq) == last + 1, step + 1)
    )
    flag = (
        F.when(F.col(end).isNotNull(), F.col(end))
        .when(F.col(seq) == last, 1)
        .when(F.col(seq) < last, 0)
    )
    return rows.frame.withColumns({"_e": number, "_x": flag}).select(
        *[c for c in df.columns if c not in (episode, end)],
        F.col("_e").alias(episode),
        F.col("_x").alias(end),
    )
