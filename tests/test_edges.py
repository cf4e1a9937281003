"""Boundary days, nulls, ties and empty inputs."""

import datetime as dt
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from careweft.functions.predicates import (
    contains_text,
    country_scope,
    date_range,
    flag_label,
    name_like,
)
from careweft.operators.intervals import events_in_window
from careweft.operators.slots import unpivot_roles, unpivot_slots
from careweft.operators.versions import latest_per_key
from careweft.plans import episodes as ep
from careweft.plans import metrics
from careweft.plans.profile import profile_table

DAY = dt.date(2024, 3, 1)
CLAIM = (
    "mbi int, provider string, seq int, from_dt date, thru_dt date, days int, claim_id int"
)


def day(n):
    return DAY + dt.timedelta(days=n)


def chain(spark, rows):
    """rows: (seq, provider, from offset, thru offset)."""
    data = [
        (1, p, s, None if f is None else day(f), None if t is None else day(t),
         None if f is None or t is None else t - f + 1, s)
        for s, p, f, t in rows
    ]
    return spark.createDataFrame(data, CLAIM).withColumn("pmt", F.lit(1).cast("decimal(18,2)"))


def column(df, name, by="seq"):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.mark.parametrize("gap, flag", [(0, 0), (5, 0), (6, 1)])
def test_stay_gap(spark, gap, flag):
    df = chain(spark, [(1, "A", 0, 3), (2, "A", 3 + gap, 9 + gap)])
    out = ep.stay_flag(df, "mbi", ["seq"], F.lit(True), "provider", "from_dt", "thru_dt")
    assert column(out, "stay_flag") == [1, flag]


def test_stay_flag_types(spark):
    df = chain(spark, [(1, "A", 0, 1), (2, "A", 2, 3), (3, "A", 4, 5), (4, "B", 6, 7)])
    snf = F.col("seq") != 2  # an unrelated claim in between starts a new stay
    out = ep.stay_flag(df, "mbi", ["seq"], snf, "provider", "from_dt", "thru_dt")
    assert column(out, "stay_flag") == [1, None, 1, 1]
    first_other = ep.stay_flag(
        df, "mbi", ["seq"], F.col("seq") > 1, "provider", "from_dt", "thru_dt"
    )
    assert column(first_other, "stay_flag") == [None, 1, 0, 1]


@pytest.mark.parametrize("gap, anchors", [(61, [1]), (62, [1, 2])])
def test_chain_gap(spark, gap, anchors):
    df = chain(spark, [(1, "A", 0, 0), (2, "A", gap, gap)])
    assert column(ep.chain_anchors(df), "seq") == anchors


def test_anchor_cases(spark):
    df = chain(
        spark,
        [(1, "A", 0, 1), (2, "B", 2, 3), (4, "B", 4, 5), (5, "B", None, 6), (6, "B", 7, None),
         (7, "B", 8, 9)],
    )
    # Other provider, a missing number, no begin, no end before.
    assert column(ep.chain_anchors(df), "seq") == [1, 2, 4, 5, 7]


def test_null_key_is_never_chained(spark):
    df = chain(spark, [(1, "A", 0, 1), (2, "A", 2, 3)]).withColumn("mbi", F.lit(None).cast("int"))
    assert column(ep.chain_anchors(df), "seq") == [1, 2]


@pytest.mark.parametrize(
    "days, sequence",
    [
        ([30, 30], [1, 1]),
        ([30, 31], [1, 2]),
        ([61, 1], [1, 2]),
        ([61, 61, 60], [1, 2, 3]),
        ([60, 0, 1], [1, 1, 2]),
        ([61, 0], [1, 2]),
    ],
)
def test_day_limit(spark, days, sequence):
    df = chain(spark, [(i, "A", i, i) for i in range(1, len(days) + 1)])
    given = F.element_at(F.array(*[F.lit(d) for d in days]), F.col("seq"))
    built = ep.build_episodes(df.withColumn("days", given))
    assert column(built, "stay_seq") == sequence


def test_missing_days_keep_the_episode_open(spark):
    df = chain(spark, [(i, "A", i, i) for i in range(1, 5)])
    df = df.withColumn("days", F.when(F.col("seq") != 2, F.lit(40)))
    built = ep.build_episodes(df)
    assert column(built, "stay_seq") == [1, 1, 1, 1]
    assert column(built, "epsd_days") == [40, None, None, None]


def test_service_dates_and_types(spark):
    df = chain(spark, [(1, "A", 0, 29), (2, "A", 30, 59), (3, "A", 60, 60)])
    built = ep.build_episodes(df)
    assert "epsd_service_dates" not in built.columns  # a row keeps the end of its list only
    rows = ep.service_dates(built).orderBy("seq").collect()
    assert rows[1]["epsd_service_dates"] == (
        "2024-03-01 - 2024-03-30;\n2024-03-31 - 2024-04-29"
    )
    assert [r["epsd_type"] for r in rows] == ["Initial", "Initial", "Recertification"]
    assert [r["epsd_end"] for r in rows] == [0, 1, 1]
    assert rows[2]["epsd_service_dates"] == "2024-04-30 - 2024-04-30"
    table = ep.episode_table(df).orderBy("stay_seq").collect()
    assert [r["epsd_service_dates"] for r in table] == [rows[1]["epsd_service_dates"], rows[2]["epsd_service_dates"]]


def test_service_dates_of_missing_dates_and_many_claims(spark):
    df = chain(spark, [(i, "A", 0, 0) for i in range(1, 301)]).withColumns(
        {"days": F.lit(0), "thru_dt": F.when(F.col("seq") != 2, F.col("thru_dt"))}
    )
    whole = [r["epsd_service_dates"] for r in ep.service_dates(ep.build_episodes(df)).orderBy("seq").collect()]
    own = [r["epsd_dates"] for r in ep.build_episodes(df).orderBy("seq").collect()]
    state, start = [], 0
    for i, text in enumerate(own):
        start = i if i in (0, 2) else start  # a claim without an end date breaks the chain
        state.append(";\n".join(own[start : i + 1]))
    assert whole == state


def test_empty_claims(spark):
    empty = chain(spark, [(1, "A", 0, 1)]).filter("seq > 1")
    assert ep.build_episodes(empty).count() == 0
    assert ep.episodes_only(ep.build_episodes(empty)).count() == 0


STAY = "mbi int, stay_id int, stay_beg_dt date, stay_end_dt date"


def events(spark, offsets, key=1):
    rows = [(key, day(o), day(o), 10 + i) for i, o in enumerate(offsets)]
    df = spark.createDataFrame(rows, "mbi int, from_dt date, thru_dt date, n int")
    return df.withColumn("pmt", F.col("n").cast("decimal(18,2)"))


@pytest.mark.parametrize("offset, hit", [(-31, 0), (-30, 1), (0, 1), (1, 0)])
def test_event_before(spark, offset, hit):
    stays = spark.createDataFrame([(1, 1, day(0), day(9))], STAY)
    found = metrics.stays_with_event_before(
        stays, events(spark, [offset]), "mbi", "stay_id", "stay_beg_dt", "thru_dt"
    )
    assert found.count() == hit


@pytest.mark.parametrize(
    "anchor, lo, hi, offset, hit",
    [("stay_beg_dt", 0, 60, -1, 0), ("stay_beg_dt", 0, 60, 0, 1), ("stay_beg_dt", 0, 60, 60, 1),
     ("stay_beg_dt", 0, 60, 61, 0), ("stay_end_dt", 2, 32, 10, 0), ("stay_end_dt", 2, 32, 11, 1),
     ("stay_end_dt", 2, 32, 41, 1), ("stay_end_dt", 2, 32, 42, 0)],
)
def test_window_bounds(spark, anchor, lo, hi, offset, hit):
    stays = spark.createDataFrame([(1, 1, day(0), day(9))], STAY)
    sums = metrics.stay_window_sum(
        stays, events(spark, [offset]), "mbi", "stay_id", anchor, "from_dt", "pmt", lo, hi
    )
    assert sums.count() == hit


def test_windows_against_pairs(spark):
    """Many keys, days and repeats, against every pair."""
    stays = [(k, i, day(3 * i - k), day(4 * i)) for k in range(3) for i in range(-9, 20)]
    evs = [(k, day(7 * i % 90 - 30), day(7 * i % 90 - 28), i) for k in range(3) for i in range(60)]
    s = spark.createDataFrame(stays, STAY)
    e = spark.createDataFrame(evs, "mbi int, from_dt date, thru_dt date, pmt int")
    for lo, hi in [(-30, 0), (0, 60), (2, 32), (0, 0), (-3, 3)]:
        got = {
            (r["mbi"], r["stay_id"]): (r["n"], r["total"])
            for r in events_in_window(
                s, e, "mbi", "stay_beg_dt", "from_dt", lo, hi, {"total": "pmt"}, "n"
            ).collect()
        }
        for k, i, begin, _ in stays:
            hits = [
                p for kk, f, _, p in evs
                if kk == k and begin + dt.timedelta(lo) <= f <= begin + dt.timedelta(hi)
            ]
            assert got[(k, i)] == ((len(hits), sum(hits)) if hits else (None, None))


def test_metrics_gates(spark):
    eps = spark.createDataFrame(
        [(1, 1, 0, day(0), day(9), day(0), 1), (1, 1, 1, day(0), day(9), day(5), 1),
         (2, 1, 1, day(0), day(9), day(0), 1), (3, 1, 1, day(0), day(9), day(0), 0)],
        "mbi int, stay_id int, stay_end int, stay_beg_dt date, stay_end_dt date,"
        " epsd_beg_dt date, discharged_home int",
    )
    ip = events(spark, [-5, 20, 100]).unionByName(events(spark, [20], key=2))
    ip = ip.unionByName(events(spark, [-1, 12], key=3))
    none = events(spark, [500])
    out = {(r["mbi"], r["stay_end"]): r for r in metrics.episode_metrics(eps, ip, none).collect()}
    early = out[(1, 0)]
    assert [early[c] for c in early.asDict() if "inpatient" in c or "readm" in c] == [0] * 5
    one = out[(1, 1)]
    assert (one["inpatient_cost_60d_after_start"], one["inpatient_60d_after_start"]) == (11, 1)
    assert (one["readmission_cost_2_32d_after_end"], one["readmission_2_32d_after_end"]) == (11, 1)
    assert one["emergency_cost_60d_after_start"] is None and one["emergency_60d_after_start"] == 0
    two = out[(2, 1)]  # no stay before: cost 0, flag by the stay after
    assert (two["readmission_cost_2_32d_after_end"], two["readmission_2_32d_after_end"]) == (0, 1)
    three = out[(3, 1)]  # not sent home
    assert (three["readmission_cost_2_32d_after_end"], three["readmission_2_32d_after_end"]) == (
        0, 0,
    )
    filled = metrics.episode_metrics(eps, ip, none, fill=0, labels={"episode_year": "Year"})
    assert {r["emergency_cost_60d_after_start"] for r in filled.collect()} == {0}
    assert "Year" in filled.columns


def test_latest_keeps_ties(spark):
    df = spark.createDataFrame(
        [(1, 2, "a"), (1, 2, "b"), (1, 1, "c"), (2, None, "d"), (None, 5, "e"), (None, 4, "f")],
        "k int, v int, t string",
    )
    assert sorted(r["t"] for r in latest_per_key(df, ["k"], "v").collect()) == ["a", "b", "e"]


def test_slots_keep_own_and_published(spark):
    df = spark.createDataFrame(
        [(1, "c1", "g1", None, None), (2, None, None, None, "g2")],
        "id int, code_1 string, grp_1 string, code_2 string, grp_2 string",
    )
    fields = {"code": "code_{i}", "grp": "grp_{i}"}
    own = unpivot_slots(df, ["id"], fields, 2)
    assert sorted(map(tuple, own.collect())) == [(1, 1, "c1", "g1"), (2, 2, None, "g2")]
    published = unpivot_slots(df, ["id"], fields, 2, text_slot=True, keep_if={"grp": [2]})
    assert sorted(map(str, published.collect())) == [
        "Row(id=1, slot='1', code='c1', grp='g1')", "Row(id=1, slot='2', code=None, grp=None)",
    ]


def test_roles_must_agree(spark):
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    with pytest.raises(ValueError):
        unpivot_roles(df, ["id"], [({"a": "x"}, ["x"]), ({"b": "x"}, ["x"])])


def test_small_predicates(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 12, 31, 0, 0, 1), "US", 1), (dt.datetime(2025, 1, 1), "FR", 0),
         (dt.datetime(2024, 1, 1), None, None)],
        "t timestamp_ntz, c string, f int",
    )
    start, end = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)
    assert df.filter(date_range("t", start, end)).count() == 2
    assert [r[0] for r in df.select(country_scope("c")).collect()] == [
        "Domestic", "Foreign", "Domestic",
    ]
    assert [r[0] for r in df.select(flag_label("f", "Transfer")).collect()] == [
        "Transfer", None, None,
    ]


@pytest.mark.parametrize(
    "pattern, hits",
    [("b", 3), ("A_C", 2), ("a%d", 1), ("[xy]", 1), ("[^a-z]", 3), ("\\", 1), ("50%", 1),
     ("a.c", 0)],
)
def test_contains_text(spark, pattern, hits):
    df = spark.createDataFrame([("abc",), ("aBc\nd",), ("x\\y",), ("50% b",)], "t string")
    assert df.filter(contains_text("t", pattern)).count() == hits


def test_name_like():
    assert name_like("Customer", "cust%") and name_like("a_b", "a_b") and name_like("axb", "a_b")
    assert not name_like("customer", "cust") and name_like("T9", "t[0-9]")


def test_profile_nulls_and_blanks(spark):
    df = spark.createDataFrame(
        [("", 1.5, None), ("", -0.0, None), (None, 0.0, None), ("x" * 100, None, None),
         ("x" * 99 + "y", 1.5, None)],
        "t string, n double, z int",
    )
    t, n, z = profile_table(df).orderBy("ordinal_position").collect()
    assert (t["total_count"], t["distinct_count"], t["unique_count"]) == (5, 3, 3)
    assert (t["null_count"], t["empty_count"], t["mode_frequency"]) == (1, 3, 2)
    assert (t["anti_mode_frequency"], t["max_length"], t["min_value"]) == (1, 100, None)
    assert (n["distinct_count"], n["unique_count"], n["null_count"]) == (2, 1, 1)
    assert (n["min_value"], n["max_value"], n["average"]) == (0.0, 1.5, 0.75)
    assert (z["distinct_count"], z["unique_count"], z["mode_frequency"]) == (0, 0, 5)
    assert z["average"] is None and z["data_type"] == "int"


@pytest.mark.parametrize(
    "values",
    [
        [0.1, 0.2, 0.3, 1e16, -1e16, 3.3, 1e-300, 5e-324, 123456.789, -0.7],
        [1e308, 1e308, -1e308, 1.7976931348623157e308, 1.0, 2.5, 0.0, -0.0, 7e-5, 9e200],
        [2.0**k for k in range(-1074, 1000, 231)] + [float(2**53 + 2)],
    ],
)
def test_averages_do_not_depend_on_partitions(spark, values):
    rows = [(v, i) for i, v in enumerate(values * 700)]
    whole = spark.createDataFrame(rows, "v double, i int")
    want = sum(map(Fraction, values)) / len(values)
    for parts in (1, 7, 200):
        shuffled = whole.repartition(parts, F.xxhash64("i"))
        (got,) = profile_table(shuffled.select("v")).select("average").collect()
        assert got["average"] == float(want)


def test_averages_of_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan, inf, None, 1), (1.0, 2.0, None, 2**62), (None, 3.0, None, 2**62)], "a double, b double, c double, d long")
    a, b, c, d = (r["average"] for r in profile_table(df).orderBy("ordinal_position").collect())
    assert a != a and b == inf and c is None
    assert d == float(Fraction(2**63 + 1, 3))


def test_profile_of_nothing(spark):
    df = spark.createDataFrame([], "a int, b string")
    a, b = profile_table(df).orderBy("ordinal_position").collect()
    assert (a["total_count"], a["null_count"], a["mode_frequency"]) == (0, 0, None)
    assert b["column_name"] == "b"
