"""Idle groups, clocks, clearing, counts of the machines, and plans that gather no group."""

import math

import pytest

from ebbtide.operators import distinct, frequency, quantiles, windows
from ebbtide.operators.batch import fold_groups
from ebbtide.operators.folds import Adwin, ConservativeCountMin, DecayedSums, DriftDetector, ExponentialHistogram, HeavyKeeper, RingHyperLogLog, SlidingFive
from ebbtide.params import CUSUM, AdwinParams, CountMinParams, DecayParams, DistinctParams, DriftParams, HeavyKeeperParams, HistogramParams, QuantileParams

SCHEMA = "grp string, t long, seq long, value double, key long, weight long"


@pytest.fixture(scope="module")
def df(spark):
    rows = [("old", 10 + i, i, 1.0, i % 3, 1) for i in range(20)] + [("new", 900 + i, 100 + i, 2.0, i % 5, 2) for i in range(20)] + [(None, 905, 200, 3.0, 1, 4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def test_idle_groups_answer_nothing_and_not_not_at_all(df):
    plain = CountMinParams(100, 64, 4, 10, conservative=False)
    found = {
        "window": {r.grp: (r["count"], r["sum"]) for r in windows.last_window(df, 100, at=950).collect()},
        "distinct": {r.grp: r["distinct"] for r in windows.last_distinct(df, 100, at=950).collect()},
        "hll": {r.grp: r.estimate for r in distinct.counts(df, DistinctParams(100), at=950).collect()},
        "total": {r.grp: r.total for r in frequency.totals(df, plain, at=950).collect()},
        "count": {r.grp: (r["count"], r.zeros, r.bins, r.collapsed) for r in quantiles.count(df, QuantileParams(100), at=950).collect()},
    }
    assert found["window"] == {"old": (0, 0.0), "new": (20, 40.0), None: (1, 3.0)}
    assert found["distinct"] == found["hll"] == {"old": 0, "new": 5, None: 1}
    assert found["total"] == {"old": 0, "new": 40, None: 4} and found["count"]["old"] == (0, 0, 0, False)
    medians = {r.grp: (r.quantile, r["count"]) for r in quantiles.quantiles(df, QuantileParams(100), [0.5], at=950).collect()}
    assert math.isnan(medians["old"][0]) and medians["old"][1] == 0 and medians["new"] == (pytest.approx(2, rel=0.01), 20)


def test_estimates_of_nothing_are_rows(df):
    for conservative in (False, True):
        params = CountMinParams(100, 64, 4, 10, conservative=conservative)
        got = {(r.grp, r.key): r.estimate for r in frequency.estimates(df, df.select("key"), params, at=950).collect()}
        assert set(got) == {(g, k) for g in ("old", "new", None) for k in range(5)}
        assert all(got["old", k] == 0 for k in range(5)) and all(got["new", k] == 8 for k in range(5)) and got[None, 1] == 4 and got[None, 0] == 0


def test_no_clock_moves_back(df):
    for found in (windows.last_window(df, 10, at=500), windows.last_distinct(df, 10, at=500), distinct.counts(df, DistinctParams(10), at=500), frequency.totals(df, CountMinParams(10), at=500), quantiles.count(df, QuantileParams(10), at=500)):
        with pytest.raises(Exception, match="move back"):
            found.collect()


def test_cusum_reads_its_running_mean():
    detector = DriftDetector(DriftParams(CUSUM, 0.0, 100.0, 0.0))
    for x in (1, 2, 3):
        detector.add(x)
    assert detector.read()[:3] == (6.0, 2.0, 3)
    latched = DriftDetector(DriftParams(CUSUM, 0.0, 5.0, 0.0, True))
    assert [latched.add(x) for x in (4, 4, 4, 0)] == [False, True, False, False] and latched.read()[1:] == (3.0, 4, 1.0, 1.0)  # it counts on while latched
    assert not latched.add(-3) and latched.read()[:3] == (0.0, 0.0, 0)  # armed again, from the start
    hinkley = DriftDetector(DriftParams(0, 0.0, 3.0, None, True))
    assert [hinkley.add(x) for x in (0, 0, 9)] == [False, False, True] and hinkley.read() == (0.0, 0.0, 0, 2.0, 1.0)


def test_a_cleared_machine_is_a_new_one():
    machines = [
        (lambda: ExponentialHistogram(HistogramParams(50.0, 0.1)), lambda s, i: s.add(i, 1 + i % 3), lambda s: (s.count(), s.sum(), s.buckets())),
        (lambda: Adwin(AdwinParams()), lambda s, i: s.add(float(i % 7)), lambda s: (s.width(), s.mean(), s.variance(), s.buckets())),
        (lambda: DriftDetector(DriftParams(0, 0.1, 4.0)), lambda s, i: s.add(float(i % 11)), lambda s: repr(s.read())),
        (lambda: HeavyKeeper(HeavyKeeperParams(2, 4, 3)), lambda s, i: s.add(i * i % 13), lambda s: (s.top(), s.size(), s.state)),
        (lambda: ConservativeCountMin(CountMinParams(40, 8, 2, 4)), lambda s, i: s.add(i, i % 9), lambda s: (s.total(), s.estimate(3))),
        (lambda: RingHyperLogLog(DistinctParams(40, 4, 2)), lambda s, i: s.add(i, i * 7919 % 31), lambda s: (s.count(), s.overflows)),
        (lambda: DecayedSums(DecayParams(9.0)), lambda s, i: s.add(i, float(i)), lambda s: s.read()),
        (lambda: SlidingFive(40, 8), lambda s, i: s.add(i, float(i)), lambda s: s.read()),
    ]
    for make, add, read in machines:
        one, other = make(), make()
        for i in range(200):
            add(one, i)
        one.clear()
        for i in range(60):
            add(one, i)
            add(other, i)
        assert read(one) == read(other)


def test_adwin_cuts_where_every_split_is_tried_plainly():
    import random

    rng, machine = random.Random(5), Adwin(AdwinParams(0.1))
    for i in range(1500):
        machine.add(rng.gauss(0, 1) + (3 if i // 400 % 2 else 0))
        c, s, q, low, high = machine.rows[:, : machine.used]
        n, total = c.sum(), s.sum()
        term, var = math.log(2 * math.log(n) / 0.1) if n > 1 else 0, max(q.sum() / n - (total / n) ** 2, 0)
        for k in range(1, machine.used):
            n0, s0 = c[:k].sum(), s[:k].sum()
            inverse = 1 / n0 + 1 / (n - n0)
            limit = math.sqrt(2 * var * term * inverse) + 2 / 3 * (high[1:].max() - low[1:].min()) * term * inverse
            assert abs(s0 / n0 - (total - s0) / (n - n0)) <= limit * (1 + 1e-9)
    assert machine.width() < 600 and machine.params.capacity == 386


def test_key_layouts_do_not_change():
    """Registers and ranks of hashed keys, by the estimates that they lead to."""
    # fixed values: a stream of keys, and the counts of the whole and the sub-window that it must give
    window, p, ring, seed, keys, stride, sub = 4000, 12, 64, 7, 6000, 250, 2000
    want = [1, 1, 250, 250, 491, 491, 753, 753]
    machine, got = RingHyperLogLog(DistinctParams(window, p, ring, seed)), []
    for t in range(751):
        machine.add(t, (t * 2654435761 % 2**32) % keys)
        if t % stride == 0:
            got += [machine.count(), machine.count(sub)]
    assert got == want and machine.overflows == 0


def test_raw_rows_are_not_gathered_by_group(df):
    """Only partial aggregates cross the network by group; rows go by group and span, or stay where they are."""
    for found in (windows.last_window(df, 100), windows.last_distinct(df, 100), distinct.registers(df, DistinctParams(100))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "partial_max" in plan and "BroadcastHashJoin" in plan
    for found in (windows.sliding(df, 50), windows.last_items(df, 5)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "span" in plan and "windowspecdefinition(grp#" in plan and all("span" in x for x in plan.split("windowspecdefinition(")[1:] if "RangeFrame, -49" in x or "RowFrame, -4" in x)


def test_last_items_and_numbers_across_cells(spark):
    rows = [("a", i * 7 % 50, i, float(i), 0, 1) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    got = {r.seq: r.nth for r in windows.numbered(table, cell=9).collect()}
    assert got == {r[2]: i + 1 for i, r in enumerate(order)}
    sums = {r.seq: r["sum"] for r in windows.last_items(table, 6).collect()}
    assert sums == {r[2]: sum(x[3] for x in order[max(0, i - 5) : i + 1]) for i, r in enumerate(order)}


def test_folds_stream_groups_in_order(spark):
    """Many groups in few partitions, more events than a batch holds, null keys a group of their own."""
    table = spark.range(50_000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 7 AS STRING) END AS grp", "id DIV 3 AS t", "50000 - id AS seq", "CAST(id AS DOUBLE) AS value")
    found = fold_groups(table, lambda: [0, None, True], lambda s, e: s.__setitem__(slice(None), [s[0] + 1, (e.t, e.seq), s[2] and (s[1] is None or s[1] < (e.t, e.seq))]), lambda s: [(s[0], s[2])], "n long, ordered boolean").collect()
    assert len(found) == 7 and sum(r.n for r in found) == 50_000 and all(r.ordered for r in found)
