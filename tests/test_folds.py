"""The order-dependent summaries against exact answers, and controls that must fail the same gates."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from ebbtide.operators.folds import Adwin, ConservativeCountMin, DecayedSums, DriftDetector, ExponentialHistogram, HeavyKeeper, Refused, RingHyperLogLog, SlidingFive
from ebbtide.params import CUSUM, PAGE_HINKLEY, AdwinParams, CountMinParams, DecayParams, DistinctParams, DriftParams, HeavyKeeperParams, HistogramParams


@pytest.mark.parametrize("window", [64, 1000])
@pytest.mark.parametrize("epsilon", [0.5, 0.1, 0.01])
def test_histogram_counts_within_epsilon(window, epsilon):
    eh = ExponentialHistogram(HistogramParams(window, epsilon))
    for t in range(1, 3 * window + 200):
        eh.add(t)
        assert abs(eh.count() - min(t, window)) <= epsilon * min(t, window)


def test_histogram_sum_is_off_by_half_the_straddling_bucket():
    rng, window = random.Random(1), 500
    eh, values = ExponentialHistogram(HistogramParams(window, 0.1)), []
    for t in range(1, 3000):
        v = rng.paretovariate(1.2)
        values.append(v)
        eh.add(t, v)
        oldest = eh._oldest()[1]
        assert abs(eh.sum() - sum(values[-window:])) <= oldest[2] / 2 * (1 + 1e-9) + 1e-9


def test_histogram_slides_when_idle_and_keeps_its_state_when_it_refuses():
    eh = ExponentialHistogram(HistogramParams(10.0, 0.1))
    for t in range(10):
        eh.add(t)
    before = (eh.count(), eh.sum(), eh.now)
    for bad in ((5, 1), (20, 0), (20, -1), (20, math.nan), (math.inf, 1), (20, True)):
        with pytest.raises(Refused):
            eh.add(*bad)
        assert (eh.count(), eh.sum(), eh.now) == before
    eh.advance(100)
    assert eh.count() == 0 and eh.sum() == 0


@pytest.mark.parametrize("delta", [0.05, 0.3])
def test_adwin_seldom_cuts_a_stationary_stream(delta):
    rng, adwin = random.Random(3), Adwin(AdwinParams(delta))
    n = 3000
    assert sum(adwin.add(float(rng.random() < 0.5)) for _ in range(n)) <= delta * n


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_adwin_finds_a_shift_and_forgets_what_was_before(offset):
    rng, adwin = random.Random(4), Adwin(AdwinParams(0.002))
    for _ in range(1500):
        adwin.add(offset + rng.gauss(0, 1))
    assert abs(adwin.mean() - offset) < 0.2
    hits = [i for i in range(600) if adwin.add(offset + 3 + rng.gauss(0, 1))]
    assert hits and hits[0] < 100
    assert abs(adwin.mean() - offset - 3) < 0.3 and adwin.width() < 700 and 0.7 < adwin.variance() < 1.4


@pytest.mark.parametrize("half_life", [10, 100, 1000])
def test_decay_is_exact(half_life):
    rng, events, t = random.Random(5), [], 1.7e12
    fd = DecayedSums(DecayParams(half_life))
    for i in range(2000):
        t += 1 + i % 5
        events.append((t, rng.uniform(-1, 2)))
        fd.add(*events[-1])
    rate = math.log(2) / half_life
    count = math.fsum(math.exp(-rate * (t - x)) for x, _ in events)
    total = math.fsum(v * math.exp(-rate * (t - x)) for x, v in events)
    assert fd.read()[0] == pytest.approx(count, rel=1e-9) and fd.read()[1] == pytest.approx(total, rel=1e-9)
    assert fd.read(t + half_life)[0] == pytest.approx(count / 2, rel=1e-9)
    assert fd.read(t + half_life)[2] == fd.read()[2]
    with pytest.raises(Refused):
        fd.read(t - 1)
    assert DecayedSums(DecayParams(5)).read() == (0, 0, 0, 0)


def test_heavy_keeper_finds_the_heavy_and_never_overestimates():
    rng = np.random.default_rng(6)
    keys = np.minimum(rng.zipf(1.3, 40_000), 20_000)
    hk, true = HeavyKeeper(HeavyKeeperParams(5, 4096, 10)), Counter()
    for k in keys.tolist():
        hk.add(k)
        true[k] += 1
    assert {k for k, _ in hk.top()} == {k for k, _ in true.most_common(10)}
    assert all(n <= true[k] for k, n in hk.top()) and hk.estimate(10**9) == 0
    again = HeavyKeeper(HeavyKeeperParams(5, 4096, 10))
    for k in keys.tolist():
        again.add(k)
    assert again.top() == hk.top()


def test_heavy_keeper_refuses_bad_keys_and_weights():
    hk = HeavyKeeper(HeavyKeeperParams())
    for bad in ((2**53, 1), (1.5, 1), ("a", 1), (1, 0), (1, 2**32), (1, 1.5)):
        with pytest.raises(Refused):
            hk.add(*bad)
    assert hk.top() == [] and hk.counts.sum() == 0


def test_ring_registers_count_the_window_and_any_shorter_one():
    params = DistinctParams(4000, 10, 16)
    rng, ring, events = random.Random(7), RingHyperLogLog(params), []
    for t in range(12_000):
        k = rng.randrange(3000)
        events.append(k)
        ring.add(t, k)
        if t % 1500 == 1499:
            for w in (4000, 1000):
                true = len(set(events[-w:]))
                assert abs(ring.count(w) - true) <= 3 * params.standard_error * true
    assert math.isnan(ring.count(0)) and math.isnan(ring.count(4001))
    ring.advance(20_000)
    assert ring.count() == 0
    small = RingHyperLogLog(DistinctParams(4000, 4, 2))
    for t, k in enumerate(events):
        small.add(t, k)
    assert small.degraded()


def test_drift_fires_up_and_down_and_ties_go_up():
    for x, direction in ((3.0, 1), (-3.0, -1)):
        dd = DriftDetector(DriftParams(PAGE_HINKLEY, 0.05, 20.0))
        fired = [i for i, v in enumerate([0.0] * 200 + [x] * 60) if dd.add(v)]
        assert fired and fired[0] > 200 and dd.last_direction == direction
    assert all(map(math.isnan, DriftDetector(DriftParams()).read()[3:]))


def test_latched_drift_fires_once_a_regime():
    stream = [0.0] * 50 + [5.0] * 100 + [0.0] * 100 + [5.0] * 100
    latched = DriftDetector(DriftParams(CUSUM, 0.5, 8.0, 0.0, True))
    assert [i for i, x in enumerate(stream) if latched.add(x)] == [51, 251]
    loose = DriftDetector(DriftParams(CUSUM, 0.5, 8.0, 0.0))
    assert sum(loose.add(x) for x in stream) > 50
    flip = DriftDetector(DriftParams(CUSUM, 0.5, 8.0, 0.0, True))
    assert [flip.add(x) for x in (5.0, 5.0, -50.0)] == [False, True, True] and flip.last_direction == -1


def test_conservative_cells_never_underestimate_and_beat_plain_ones():
    params = {"window": 1000, "w": 64, "d": 3, "panes": 10}
    rng, events = random.Random(8), []
    kinds = [ConservativeCountMin(CountMinParams(**params, conservative=c)) for c in (True, False)]
    for t in range(4000):
        key, n = int(rng.paretovariate(0.7)) % 500, rng.randrange(1, 4)
        events.append((t, key, n))
        for s in kinds:
            s.add(t, key, n)
    first = kinds[0].first()
    for key in range(0, 500, 7):
        true = sum(n for t, k, n in events if k == key and t >= 3000)
        covered = sum(n for t, k, n in events if k == key and t * 10 // 1000 >= first)
        low, high = (s.estimate(key) for s in kinds)
        assert true <= covered <= low <= high
    assert kinds[0].total() == sum(n for t, _, n in events if t * 10 // 1000 >= first)
    assert math.isnan(kinds[0].estimate(1, 2000))
    assert not kinds[0].saturated
    kinds[0].add(5000, 1, 2**32 - 1)
    kinds[0].add(5000, 1, 1)
    assert kinds[0].saturated and kinds[0].estimate(1) == 2**32 - 1
    kinds[0].advance(10_000)
    assert kinds[0].total() == 0 and kinds[0].estimate(1) == 0


@pytest.mark.parametrize(("window", "panes"), [(1024, 32), (1000, 32), (2000, 40), (512, 16)])
def test_five_aggregates_are_exact_over_the_covered_span(window, panes):
    rng, held, five = random.Random(9), [], SlidingFive(window, panes)
    for t in range(3000):
        v = round(rng.gauss(0, 40) * 2**20) / 2**20
        held.append((t, v))
        five.add(t, v)
        if t % 97 == 0:
            for w in (None, window // 3):
                low = (t - (w or window)) * panes // window
                span = [x for s, x in held if s * panes // window >= low]
                count, total, mean, least, most = five.read(w)
                assert (count, least, most) == (len(span), min(span), max(span))
                assert total == pytest.approx(math.fsum(span), rel=1e-12, abs=1e-9) and mean == total / count
    assert all(map(math.isnan, five.read(window + 1)))
    five.advance(10 * window + 3000)
    assert five.read()[:2] == (0, 0.0) and math.isnan(five.read()[2])


def test_a_ring_without_the_straddling_pane_would_miss_events():
    five = SlidingFive(100, 10)
    for t in range(205):
        five.add(t, 1.0)
    assert five.read()[0] == 105 >= 100  # never under-covers; without that pane it would be 95
