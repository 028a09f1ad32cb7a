"""DataFrame forms against the state machines, against exact answers, and hashing against Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ebbtide.functions.hashing import finalize, finalized, hash_key, lane, row_columns, seeding_int
from ebbtide.functions.timegrid import floored, micros
from ebbtide.operators import decay, distinct, frequency, panes, quantiles, windows
from ebbtide.operators.folds import ConservativeCountMin, DecayedSums, RingHyperLogLog, SlidingFive
from ebbtide.params import CountMinParams, DecayParams, DistinctParams, PaneWindow, QuantileParams, ReservoirParams

KEYS = [0, 1, -1, 7, -7, 2**30 - 1, 2**30 + 1, 2**31 - 1, 2**31, 2**32 - 1, 2**32, -(2**31), 2**53 - 1, -(2**53 - 1)]
SCHEMA = "grp string, t long, seq long, value double, key long, weight long"


@pytest.fixture(scope="module")
def rows():
    rng, t, out = random.Random(11), 0, []
    for i in range(1500):
        t += rng.choice([0, 1, 1, 2, 40])
        out.append((rng.choice("aab"), t, i, round(rng.lognormvariate(1, 2), 3) if i % 50 else 0.0, int(rng.paretovariate(0.8)) % 300, rng.randrange(1, 4)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def by_group(rows):
    return {g: [r for r in rows if r[0] == g] for g in {r[0] for r in rows}}


def test_hashing_in_columns_is_hashing_in_python(spark):
    table = spark.createDataFrame([(k,) for k in KEYS], "key long")
    for seed in (0x9E3779B1, 0, 7, 0xFFFFFFFF):
        assert [r[0] for r in table.select(lane(F.col("key"), seed)).collect()] == [hash_key(k, seed) for k in KEYS]
        assert -(2**31) <= seeding_int(seed) < 2**31
    words = [k & 0xFFFFFFFF for k in KEYS]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "x long").select(finalized(F.col("x"))).collect()] == list(map(finalize, words))


def test_integer_panes_and_times(spark):
    got = spark.sql("SELECT explode(array(-7L, -6L, -1L, 0L, 5L, 6L)) AS x").select("x", floored(F.col("x"), 6).alias("f")).collect()
    assert all(r.f == r.x // 6 for r in got)
    ts = spark.sql("SELECT explode(array(TIMESTAMP_NTZ'2024-03-10 02:30:15.123456', TIMESTAMP_NTZ'1969-12-31 23:59:59.5')) AS ts")
    assert [r[0] for r in ts.select(micros(F.col("ts"))).collect()] == [1710037815123456, -500000]


def test_snapshot_is_the_state_machine(df, rows):
    for sub, at in ((None, None), (30, None), (None, 10**6)):
        got = {r.grp: r for r in panes.snapshot(df, PaneWindow(200, 16), at=at, sub=sub).collect()}
        for g, own in by_group(rows).items():
            five = SlidingFive(200, 16)
            for r in own:
                five.add(r[1], r[3])
            if at:
                five.advance(at)
            count, total, mean, least, most = five.read(sub)
            assert got[g]["count"] == count and got[g]["sum"] == pytest.approx(total)
            for name, x in (("mean", mean), ("min", least), ("max", most)):
                assert got[g][name] == pytest.approx(x, nan_ok=True)


def test_a_clock_that_moves_back_is_an_error(df):
    with pytest.raises(Exception, match="move back"):
        panes.snapshot(df, PaneWindow(200, 16), at=5).collect()
    with pytest.raises(ValueError):
        panes.snapshot(df, PaneWindow(200, 16), sub=201)


def test_windows_are_exact(df, rows):
    groups = by_group(rows)
    for r in windows.sliding(df, 50).collect():
        inside = [x for x in groups[r.grp] if r.t - 50 < x[1] <= r.t]
        assert r["count"] == len(inside) and r["sum"] == pytest.approx(math.fsum(x[3] for x in inside))
    for r in windows.last_distinct(df, 100).collect():
        now = groups[r.grp][-1][1]
        assert r["distinct"] == len({x[4] for x in groups[r.grp] if x[1] > now - 100})


def test_decay_is_the_state_machine(df, rows):
    for at in (None, 10**5):
        got = {r.grp: r for r in decay.decayed(df, DecayParams(300.0), at=at).collect()}
        for g, own in by_group(rows).items():
            fd = DecayedSums(DecayParams(300.0))
            for r in own:
                fd.add(r[1], r[3])
            count, total, mean, rate = fd.read(at)
            assert [got[g][c] for c in ("count", "sum", "mean", "rate")] == pytest.approx([count, total, mean, rate], rel=1e-9)


def test_quantiles_are_within_alpha_of_the_exact_ones(df, rows):
    params, qs = QuantileParams(400, 0.02, 16), [0, 0.25, 0.5, 0.9, 1]
    got = {(r.grp, r.q): r for r in quantiles.quantiles(df, params, [*qs, 1.5]).collect()}
    for g, own in by_group(rows).items():
        low = (own[-1][1] - 400) * 16 // 400
        span = sorted(r[3] for r in own if r[1] * 16 // 400 >= low)
        for q in qs:
            true = span[math.floor(q * (len(span) - 1))]
            assert abs(got[g, q].quantile - true) <= 0.02 * true * (1 + 1e-9) and got[g, q]["count"] == len(span)
        assert math.isnan(got[g, 1.5].quantile)


def test_few_bins_fold_or_refuse(df, spark):
    few = quantiles.count(df, QuantileParams(400, 0.02, 16, False, 16)).collect()
    assert all(r.bins <= 16 and r.collapsed for r in few)
    with pytest.raises(Exception, match="more bins"):
        quantiles.count(df, QuantileParams(400, 0.02, 16, True, 16)).collect()
    with pytest.raises(Exception, match="declared range"):
        quantiles.count(df, QuantileParams(400, 0.02, 16, range=(1.0, 2.0))).collect()
    wide = quantiles.count(df, QuantileParams(400, 0.02, 16, range=(1e-4, 1e6))).collect()
    assert not any(r.collapsed for r in wide) and QuantileParams(400, 0.02, 16, range=(1e-4, 1e6)).fits
    with pytest.raises(Exception, match="at least 0"):
        quantiles.count(spark.createDataFrame([("a", 1, 1, -1.0, 1, 1)], SCHEMA), QuantileParams(400)).collect()


def test_plain_cells_are_the_state_machine(df, rows):
    params = CountMinParams(300, 32, 4, 10, conservative=False)
    got = {(r.grp, r.key): r.estimate for r in frequency.estimates(df, df.select("key"), params).collect()}
    true = {(r.grp, r.key): r["count"] for r in frequency.exact(df, params).collect()}
    totals = {r.grp: r.total for r in frequency.totals(df, params).collect()}
    for g, own in by_group(rows).items():
        scm = ConservativeCountMin(params)
        for r in own:
            scm.add(r[1], r[4], r[5])
        assert totals[g] == scm.total()
        for key in {r[4] for r in rows}:
            assert got.get((g, key), 0) == scm.estimate(key) >= true.get((g, key), 0)
    assert row_columns(5, 1, 4, 32) == row_columns(5, 1, 4, 32)


def test_registers_are_those_of_the_rings(df, rows):
    params = DistinctParams(500, 6, 64)
    for sub in (None, 100):
        got = {r.grp: r.estimate for r in distinct.counts(df, params, sub=sub).collect()}
        for g, own in by_group(rows).items():
            ring = RingHyperLogLog(params)
            for r in own:
                ring.add(r[1], r[4])
            assert ring.overflows == 0 and got[g] == ring.count(sub)


def test_the_sample_favours_the_recent_at_the_rate_of_decay(spark):
    n, k, half_life, trials = 300, 8, 40.0, 400
    table = spark.range(trials * n).select((F.col("id") % trials).cast("string").alias("grp"), F.call_function("div", F.col("id"), F.lit(trials)).alias("t"), F.col("id").alias("seq"), F.lit(1.0).alias("value"))
    got = decay.reservoir(table, ReservoirParams(k, half_life)).collect()
    assert len(got) == trials * k
    ages = [n - 1 - r.t for r in got]
    young, older = sum(a < 40 for a in ages), sum(40 <= a < 80 for a in ages)
    assert 1.5 < young / older < 2.5  # 2 for a half-life of 40
    again = decay.reservoir(table.repartition(7), ReservoirParams(k, half_life)).collect()
    assert {(r.grp, r.seq) for r in again} == {(r.grp, r.seq) for r in got}


def test_top_keys_and_empty_tables(df, spark, rows):
    for r in decay.top_keys(df, 3).filter("rank = 1").collect():
        total = {}
        for x in by_group(rows)[r.grp]:
            total[x[4]] = total.get(x[4], 0) + x[5]
        assert r["count"] == max(total.values())
    none = spark.createDataFrame([], SCHEMA)
    for found in (panes.snapshot(none, PaneWindow(10)), windows.sliding(none, 10), decay.decayed(none, DecayParams(1.0)), quantiles.quantiles(none, QuantileParams(10), [0.5]), frequency.totals(none, CountMinParams(10)), distinct.counts(none, DistinctParams(10)), decay.reservoir(none, ReservoirParams(2, 1.0))):
        assert found.collect() == []


def test_pane_sums_are_combined_before_the_shuffle(df):
    plan = panes.snapshot(df, PaneWindow(200, 16))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan
