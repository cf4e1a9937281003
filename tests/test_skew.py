"""Split processing of large keys gives what plain windows give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from careweft.operators.chains import assign_episode_chain
from careweft.operators.ordered import OrderedKeys, add_group_index
from careweft.operators import skew
from careweft.operators.skew import hot_keys, lookup_join
from careweft.operators.versions import latest_per_key
from careweft.plans import episodes as ep

FLOOR, CHUNK = 25, 20
NEVER = 10**12


def rows_of(df):
    names = sorted(df.columns)
    return sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))


@pytest.fixture(scope="module")
def claims(spark):
    """Key 1 (and the null key) hold more than a third of the rows."""
    rng = random.Random(5)
    rows = []
    claim = 0
    for key, n in [(1, 300), (None, 60), *[(k, rng.randint(1, 12)) for k in range(2, 40)]]:
        day = dt.date(2020, 1, 1)
        for seq in range(1, n + 1):
            claim += 1
            day += dt.timedelta(days=rng.choice([0, 1, 3, 9, 30, 61, 62, 75]))
            length = rng.choice([1, 1, 2, 7, 20, 30, 60, 61])
            days = None if rng.random() < 0.03 else rng.choice([0, length])
            thru = day + dt.timedelta(days=length - 1)
            rows.append(
                (key, "A" if rng.random() < 0.97 else "B", seq, day, thru, days, float(claim),
                 claim, rng.random() < 0.7)
            )
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows,
        "mbi int, provider string, seq int, from_dt date, thru_dt date, days int, price double,"
        " claim_id int, is_snf boolean",
    )
    return df.withColumn("pmt", F.col("price").cast("decimal(18,2)")).drop("price").cache()


def both(spark, call):
    plain = call(floor=NEVER, chunk_rows=CHUNK)
    split = call(floor=FLOOR, chunk_rows=CHUNK)
    assert sorted(plain.columns) == sorted(split.columns)
    assert [f.dataType for f in plain.select(sorted(plain.columns)).schema] == [
        f.dataType for f in split.select(sorted(plain.columns)).schema
    ]
    want, got = rows_of(plain), rows_of(split)
    assert len(want) > 0
    assert want == got


def test_hot_keys_are_found(claims):
    hot = hot_keys(claims, ["mbi"], FLOOR)
    assert {r["mbi"]: r["_n"] for r in hot.table.collect()} == {1: 300, None: 60}
    assert hot.rows == 360 and hot.small
    assert hot.hot_part(claims).count() == 360
    assert hot.cold_part(claims).count() == claims.count() - 360


def test_no_hot_keys(claims):
    assert hot_keys(claims, ["mbi"], 300) is None
    assert hot_keys(claims, ["mbi"], NEVER) is None


def test_ranges_split_a_key(claims):
    rows = OrderedKeys(claims, ["mbi"], ["seq"], FLOOR, CHUNK)
    per_range = rows._ranges().groupBy("_chunk").count().collect()
    assert len(per_range) > 10
    assert max(r["count"] for r in per_range) < 60


def test_previous(spark, claims):
    both(
        spark,
        lambda **k: OrderedKeys(claims, ["mbi"], ["seq"], **k)
        .previous({"was": "claim_id", "thru": "thru_dt"}, flag="has")
        .frame,
    )


def test_previous_descending(spark, claims):
    both(
        spark,
        lambda **k: OrderedKeys(claims, ["mbi"], [F.col("seq").desc()], **k)
        .previous({"after": "claim_id"})
        .frame,
    )


def test_running(spark, claims):
    mark = F.when(F.col("provider") == "B", F.struct("seq", "claim_id"))
    both(
        spark,
        lambda **k: OrderedKeys(claims, ["mbi"], ["from_dt", "seq"], **k)
        .running(sums={"n": F.lit(1), "d": "days", "p": "pmt"}, latest={"m": mark})
        .frame,
    )


def test_group_index(spark, claims):
    both(
        spark,
        lambda **k: add_group_index(
            claims, [F.col("from_dt").desc()], ["mbi"], "i", 10, 5, ["claim_id"], **k
        ),
    )


def test_latest_per_key(spark, claims):
    tied = claims.withColumn("version", F.floor(F.col("seq") / 7))
    tied = tied.withColumn("version", F.when(F.col("seq") % 5 != 0, F.col("version")))
    call = lambda floor: latest_per_key(tied, ["mbi"], "version", floor)
    want, got = rows_of(call(NEVER)), rows_of(call(FLOOR))
    assert want == got
    assert len(want) > 40


def test_stay_flag(spark, claims):
    both(
        spark,
        lambda **k: ep.stay_flag(
            claims, "mbi", ["from_dt", "claim_id"], F.col("is_snf"), "provider", "from_dt",
            "thru_dt", **k
        ),
    )


def test_stays_and_anchors(spark, claims):
    both(spark, lambda **k: ep.chain_anchors(claims, **k))
    both(spark, lambda **k: ep.assign_stays(claims, **k))


def test_claim_counts(spark, claims):
    both(spark, lambda **k: ep.episode_claim_counts(claims, ["mbi"], "seq", "days", **k))


def test_first_row_values(spark, claims):
    both(spark, lambda **k: ep.first_row_values(claims, ["mbi"], "seq", ["claim_id"], **k))


def test_chain_step(spark, claims):
    counted = ep.episode_claim_counts(claims, ["mbi"], "seq", "days").select(
        "mbi", "seq", "claim_count"
    )

    def steps(**k):
        one = ep.episode_chain_step(counted, ["mbi"], "seq", "claim_count", 1, **k)
        return ep.episode_chain_step(one, ["mbi"], "seq", "claim_count", 2, **k)

    both(spark, steps)


@pytest.mark.parametrize("chunk", [1, 7, 20, 1000])
def test_episode_chain(spark, claims, chunk):
    rng = random.Random(chunk)
    rows = [(r["mbi"], r["seq"]) for r in claims.select("mbi", "seq").collect()]
    counts = [rng.choice([1, 2, 3, 5, 30, 0]) for _ in rows]
    df = spark.createDataFrame(
        [(m, s, None if rng.random() < 0.002 else c) for (m, s), c in zip(rows, counts)],
        "mbi int, seq int, ct int",
    )
    plain = assign_episode_chain(df, ["mbi"], "seq", "ct", floor=NEVER)
    split = assign_episode_chain(df, ["mbi"], "seq", "ct", floor=FLOOR, chunk_rows=chunk)
    assert rows_of(plain) == rows_of(split)
    # Brute force over the rows of one key.
    key = sorted((r["seq"], r["ct"]) for r in df.filter("mbi = 1").collect())
    want, episode, left = [], 0, 0
    for seq, ct in key:
        if left == 0:
            episode, left, place = episode + 1, 10**9 if ct is None else max(ct, 1), 0
        left, place = left - 1, place + 1
        want.append((seq, episode, place))
    got = sorted(
        (r["seq"], r["episode"], r["episode_seq"]) for r in split.filter("mbi = 1").collect()
    )
    assert got == want


@pytest.mark.parametrize("counts", [[1], [2, 1], [500], [None], [3, 0, 7], [1] * 30 + [90]])
def test_episode_chain_of_regular_counts(spark, counts):
    """Starts at every row, and episodes over several ranges."""
    n = 260
    rows = [(None, i, counts[i % len(counts)]) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "mbi int, seq int, ct int")
    want, left, episode, place = [], 0, 0, 0
    for _, seq, ct in rows:
        if left == 0:
            episode, left, place = episode + 1, 10**9 if ct is None else max(ct, 1), 0
        left, place = left - 1, place + 1
        want.append((seq, episode, place, 1 if left == 0 or seq == n else 0))
    for options in ({"floor": NEVER}, {"floor": 25, "chunk_rows": 40}):
        got = assign_episode_chain(df, ["mbi"], "seq", "ct", **options).collect()
        assert sorted((r["seq"], r["episode"], r["episode_seq"], r["episode_end"]) for r in got) == want


def brute_episodes(rows, limit=60, gap=61):
    """The recursive rule, row by row."""
    out = {}
    for key in {r["mbi"] for r in rows}:
        prev = None
        for r in sorted((r for r in rows if r["mbi"] == key), key=lambda r: r["seq"]):
            chained = (
                prev is not None
                and key is not None
                and prev["provider"] == r["provider"]
                and prev["thru_dt"] >= r["from_dt"] - dt.timedelta(days=gap)
            )
            if not chained:
                state = dict(stay=r["seq"], epsd=1, n=1, days=r["days"], pmt=r["pmt"])
            else:
                total = (
                    None
                    if state["days"] is None or r["days"] is None
                    else state["days"] + r["days"]
                )
                if total is not None and total > limit:
                    state = {
                        **state, "epsd": state["epsd"] + 1, "n": 1, "days": r["days"],
                        "pmt": r["pmt"],
                    }
                else:
                    state = {
                        **state, "n": state["n"] + 1, "days": total, "pmt": state["pmt"] + r["pmt"]
                    }
            out[r["claim_id"]] = (state["epsd"], state["n"], state["days"], state["pmt"])
            prev = r
    return out


@pytest.mark.parametrize("floor", [NEVER, FLOOR])
def test_build_episodes_is_the_recursive_rule(spark, claims, floor):
    built = ep.build_episodes(claims, floor=floor, chain_floor=floor, chunk_rows=CHUNK)
    got = {
        r["claim_id"]: (r["stay_seq"], r["epsd_seq"], r["epsd_days"], r["epsd_amount"])
        for r in built.collect()
    }
    assert got == brute_episodes(claims.collect())


def test_build_episodes_split(spark, claims):
    both(
        spark,
        lambda floor, chunk_rows: ep.build_episodes(
            claims, floor=floor, chain_floor=floor, chunk_rows=chunk_rows
        ),
    )


def test_long_stay_without_breaks(spark):
    """One stay of 400 one-day claims: episode phases carry over every range."""
    start = dt.date(2020, 1, 1)
    df = spark.createDataFrame(
        [(1, "A", i, start + dt.timedelta(i), start + dt.timedelta(i), 1, i) for i in range(1, 401)],
        "mbi int, provider string, seq int, from_dt date, thru_dt date, days int, claim_id int",
    ).withColumn("pmt", F.lit(1).cast("decimal(18,2)"))
    built = ep.build_episodes(df, floor=50, chain_floor=50, chunk_rows=33)
    sizes = {
        r["stay_seq"]: r["n"]
        for r in built.groupBy("stay_seq").agg(F.max("epsd_seq").alias("n")).collect()
    }
    assert sizes == {1: 60, 2: 60, 3: 60, 4: 60, 5: 60, 6: 60, 7: 40}
    ends = built.filter("epsd_end = 1").orderBy("seq")
    assert [r["seq"] for r in ends.collect()] == [60, 120, 180, 240, 300, 360, 400]


def test_episodes_only(spark, claims):
    rows = ep.build_episodes(claims)
    both(spark, lambda **k: ep.episodes_only(rows, **k))
    want = rows_of(ep.episodes_only(rows))
    for floor in (NEVER, FLOOR):
        table = ep.episode_table(claims, floor=floor, chain_floor=floor, chunk_rows=CHUNK)
        assert rows_of(table) == want
        plain = ep.episode_table(claims, floor=floor, chain_floor=floor, chunk_rows=CHUNK, dates=False)
        assert rows_of(plain) == rows_of(table.drop("epsd_service_dates"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("small", [True, False])
def test_lookup_join(spark, claims, how, small, monkeypatch):
    if not small:
        monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    right = spark.createDataFrame(
        [(1, "one"), (None, "none"), (3, "three"), (99, "no")], "k int, t string"
    )
    call = lambda floor: lookup_join(claims, right, ["mbi"], how, ["k"], floor, salts=4)
    want, got = rows_of(call(NEVER)), rows_of(call(FLOOR))
    assert want == got
    keys = {r["mbi"] for r in call(FLOOR).collect()}
    assert (1 in keys, None in keys) == (how != "left_anti",) * 2


def test_long_list_of_large_keys(spark, claims, monkeypatch):
    """More large keys than may be broadcast: they are kept in a stored table."""
    want = rows_of(ep.assign_stays(claims, floor=NEVER))
    monkeypatch.setattr(skew, "SMALL_ROWS", 1)
    monkeypatch.setattr("careweft.operators.ordered.SMALL_ROWS", 1)
    hot = hot_keys(claims, ["mbi"], FLOOR)
    assert not hot.small and hot.rows == 360
    assert rows_of(ep.assign_stays(claims, floor=FLOOR, chunk_rows=CHUNK)) == want


def test_windows_with_a_large_key(spark, claims, monkeypatch):
    from careweft.operators import intervals
    from careweft.plans import metrics

    eps = ep.episodes_only(ep.build_episodes(claims)).select(
        "mbi", "stay_id", "stay_seq", "stay_end", F.col("stay_from_dt").alias("stay_beg_dt"),
        "stay_end_dt", F.col("epsd_from_dt").alias("epsd_beg_dt"),
        (F.col("claim_id") % 2).alias("discharged_home"),
    )
    ip = claims.select("mbi", "from_dt", "thru_dt", "pmt").filter("is_snf")
    want = rows_of(metrics.episode_metrics(eps, ip, ip))
    real = lookup_join
    monkeypatch.setattr(
        metrics, "lookup_join", lambda *a, **k: real(*a, **{**k, "floor": FLOOR})
    )
    assert rows_of(metrics.episode_metrics(eps, ip, ip)) == want
    assert intervals.lookup_join is real
