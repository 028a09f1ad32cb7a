"""Every operator as a query over the ``events`` table, with the parameters of a daily report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timegrid import DAY
from ..operators import decay, distinct, frequency, heavy, panes, quantiles, windows
from ..operators.batch import fold_events, fold_groups
from ..operators.folds import Adwin, DecayedSums, DriftDetector, ExponentialHistogram, HeavyKeeper, RingHyperLogLog
from ..params import CUSUM, PAGE_HINKLEY, AdwinParams, CountMinParams, DecayParams, DistinctParams, DriftParams, HeavyKeeperParams, HistogramParams, PaneWindow, QuantileParams, ReservoirParams, describe
from ..sources.events import event_stream, events
from ..streaming.stateful import fold_stream, latest, run_once, summary_stream, tumbling_five

WEEK = 7 * DAY
GRID = PaneWindow(DAY, 32)
LATER = 1_706_745_600_000_000  # 2024-02-01, after the last event
MIDDLE = LATER - 16 * DAY
QUANTILES = [0.0, 0.5, 0.9, 0.99, 1.0]
SKETCH = QuantileParams(DAY)
IDLE = 3 * DAY // 2  # before LATER: some users have events there, others have none
BUCKETS = HistogramParams(float(WEEK), 0.05)
HEAVY, WIDE = HeavyKeeperParams(4, 1024, 10), HeavyKeeperParams.with_accuracy(10, 0.001)
CAREFUL = CountMinParams(WEEK)
CELLS = CountMinParams(WEEK, conservative=False)
RINGS = DistinctParams(DAY, 10, 8)
DESCRIBED = (BUCKETS, AdwinParams(), DecayParams(float(DAY)), WIDE, DistinctParams(DAY, 12), DriftParams(CUSUM, 5.0, 500.0, 50.0), QuantileParams(DAY, 0.02), CountMinParams.with_accuracy(WEEK, 0.001, 0.001), ReservoirParams(50, float(WEEK)), PaneWindow(DAY, 32))
SETS = DistinctParams(DAY)
FADE = DecayParams(float(DAY))
FIVE = ["count", "sum", "min", "max", "mean"]


def _six(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles rounded to six digits: their last bits depend on the order of summation."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def sa_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(panes.snapshot(events(spark, sf_dir), GRID), "sum", "mean")


def sa_subwindow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(panes.snapshot(events(spark, sf_dir), GRID, sub=DAY // 4), "sum", "mean")


def sa_idle_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panes.snapshot(events(spark, sf_dir), PaneWindow(5 * DAY, 32), at=LATER)
    return _six(found, "sum", "mean").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("min", "max", "mean")})


def sa_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(panes.running(events(spark, sf_dir), GRID), "sum", "mean")


def sa_count_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(panes.snapshot(windows.by_count(events(spark, sf_dir)), PaneWindow(50, 8)), "sum", "mean")


def eh_exact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(events(spark, sf_dir).filter("value > 0"), DAY).select("grp", "seq", "count")


def eh_exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(windows.sliding(events(spark, sf_dir).filter("value > 0"), DAY).select("grp", "seq", "sum"), "sum")


def eh_last_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(windows.last_window(events(spark, sf_dir).filter("value > 0"), WEEK), "sum")


def eh_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(windows.last_items(events(spark, sf_dir).filter("value > 0"), 20).select("grp", "seq", "count", "sum"), "sum")


def eh_idle_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(windows.last_window(events(spark, sf_dir).filter("value > 0"), IDLE, at=LATER), "sum")


def _histogram(spark: SparkSession, sf_dir: str, at: int | None = None) -> DataFrame:
    def read(state):
        if at is not None:
            state.advance(at)
        return [(float(state.count()), round(state.sum(), 6), state.buckets(), state.size())]

    rows = events(spark, sf_dir, "event_type").filter("value > 0")
    return fold_groups(rows, lambda: ExponentialHistogram(BUCKETS), lambda s, e: s.add(e.t, e.value), read, "count double, sum double, buckets int, size long")


def eh_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate count and sum beside the buckets held and the events in them, by event type."""
    return _histogram(spark, sf_dir)


def eh_approx_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same once the clock has moved on without events."""
    return _histogram(spark, sf_dir, LATER + WEEK // 2)


def fd_at_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(decay.decayed(events(spark, sf_dir), FADE).select("grp", "count", "sum", "mean"), "count", "sum", "mean")


def fd_at_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(decay.decayed(events(spark, sf_dir), FADE, at=LATER).select("grp", "count", "sum", "mean"), "count", "sum", "mean")


def fd_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.decayed(events(spark, sf_dir), FADE).select("grp", F.round(F.col("rate") * DAY, 6).alias("per_day"))


def fd_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed count, sum, mean after each event, by event type."""
    found = windows.running_decayed(events(spark, sf_dir, "event_type"), FADE.rate, DAY)
    return _six(found.select("grp", "seq", "count", "sum", (F.col("sum") / F.col("count")).alias("mean")), "count", "sum", "mean")


def sdd_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(quantiles.quantiles(events(spark, sf_dir), SKETCH, QUANTILES), "quantile")


def sdd_subwindow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(quantiles.quantiles(events(spark, sf_dir), QuantileParams(WEEK), [0.5, 0.95], sub=DAY), "quantile")


def sdd_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With so few bins that panes fold their lower ones."""
    return _six(quantiles.quantiles(events(spark, sf_dir, "event_type"), QuantileParams(WEEK, 0.01, 32, False, 64), [0.1, 0.5, 0.9]), "quantile")


def sdd_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.count(events(spark, sf_dir), SKETCH).select("grp", "count", "zeros", "bins")


def sdd_idle_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of what is left of each window; null (NaN) and 0 for users whose window is empty."""
    found = _six(quantiles.quantiles(events(spark, sf_dir), QuantileParams(IDLE), [0.5], at=LATER), "quantile")
    return found.withColumn("quantile", F.when(~F.isnan("quantile"), F.col("quantile")))


def scm_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.totals(events(spark, sf_dir, "event_type"), CELLS)


def scm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.cells(events(spark, sf_dir, "event_type"), CELLS).select("grp", "pane", "row", "col", "n")


def scm_estimate_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_type")
    return frequency.estimates(rows, rows.select("key"), CELLS)


def scm_idle_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.totals(events(spark, sf_dir), CountMinParams(IDLE), at=LATER)


def scm_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.status(events(spark, sf_dir, "event_type"), CELLS)


def scm_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.exact(events(spark, sf_dir, "event_type"), CELLS)


def scm_conservative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of every key of a group by cells that are raised no further than needed, and the total, by event type."""
    rows = events(spark, sf_dir, "event_type")
    return frequency.estimates(rows, rows.select("grp", "key"), CAREFUL).join(frequency.totals(rows, CAREFUL), "grp")


def shll_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.registers(events(spark, sf_dir, "event_type"), SETS)


def shll_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.counts(events(spark, sf_dir, "event_type"), SETS)


def shll_subwindow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.counts(events(spark, sf_dir, "event_type"), DistinctParams(WEEK), sub=DAY // 2)


def shll_idle_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.counts(events(spark, sf_dir), DistinctParams(IDLE), at=LATER)


def shll_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded, order-dependent form, with its overflows."""
    rows = events(spark, sf_dir, "event_type")
    return fold_groups(rows, lambda: RingHyperLogLog(RINGS), lambda s, e: s.add(e.t, e.key), lambda s: [(int(s.count()), s.overflows, s.degraded())], "estimate long, overflows long, degraded boolean", ("t", "seq", "key"))


def distinct_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_distinct(events(spark, sf_dir, "event_type"), DAY)


def hk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_type")
    return fold_groups(rows, lambda: HeavyKeeper(HEAVY), lambda s, e: s.add(e.key, e.weight), lambda s: [(i + 1, k, n) for i, (k, n) in enumerate(s.top())], "rank int, key long, count long", ("t", "seq", "key", "weight"))


def hk_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of every key of a group, by event type."""
    rows = events(spark, sf_dir, "event_type")
    return heavy.estimates(rows, rows, WIDE)


def topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.top_keys(events(spark, sf_dir, "event_type"), 10)


def topk_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(decay.decayed_top(events(spark, sf_dir, "event_type"), DecayParams(float(WEEK)), 10, LATER), "score")


def dr_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.reservoir(events(spark, sf_dir, "event_type"), ReservoirParams(50, float(WEEK))).select("grp", "rank", "seq", "value")


def _drift(spark: SparkSession, sf_dir: str, params: DriftParams) -> DataFrame:
    """The fires by event type: at which event, its index and its direction."""

    def step(state, event):
        return [(event.seq, state.last_index, state.last_direction)] if state.add(event.value) else []

    return fold_events(events(spark, sf_dir, "event_type"), lambda: DriftDetector(params), step, "seq long, index long, direction int")


def dd_ph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir, DriftParams(PAGE_HINKLEY, 5.0, 500.0))


def dd_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir, DriftParams(CUSUM, 5.0, 500.0, 50.0))


def dd_ph_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir, DriftParams(PAGE_HINKLEY, 5.0, 500.0, None, True))


def dd_cusum_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir, DriftParams(CUSUM, 5.0, 500.0, 50.0, True))


def _drift_state(spark: SparkSession, sf_dir: str, params: DriftParams) -> DataFrame:
    """What the detector reads at the end of each event type; null before its first fire."""

    def read(state):
        statistic, mean, count, index, direction = state.read()
        fired = index == index
        return [(round(statistic, 6), round(mean, 6), count, int(index) if fired else None, int(direction) if fired else None)]

    return fold_groups(events(spark, sf_dir, "event_type"), lambda: DriftDetector(params), lambda s, e: s.add(e.value), read, "statistic double, mean double, count long, last_index long, last_direction int")


def dd_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift_state(spark, sf_dir, DriftParams(PAGE_HINKLEY, 5.0, 500.0))


def dd_state_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift_state(spark, sf_dir, DriftParams(CUSUM, 5.0, 500.0, 50.0))


def dd_state_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift_state(spark, sf_dir, DriftParams(PAGE_HINKLEY, 5.0, 500.0, None, True))


def dd_state_cusum_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift_state(spark, sf_dir, DriftParams(CUSUM, 5.0, 500.0, 50.0, True))


def adwin_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the window was cut, by event type, when values rise by 100 half way through the month."""

    def step(state, event):
        return [(event.seq, state.width(), round(state.mean(), 6))] if state.add(event.value) else []

    shifted = events(spark, sf_dir, "event_type").withColumn("value", F.col("value") + F.when(F.col("t") >= MIDDLE, 100.0).otherwise(0.0))
    return fold_events(shifted, lambda: Adwin(AdwinParams(0.05)), step, "seq long, width long, mean double")


def adwin_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "event_type")
    return fold_groups(rows, lambda: Adwin(AdwinParams()), lambda s, e: s.add(e.value), lambda s: [(s.width(), round(s.mean(), 6), round(s.variance(), 4), s.buckets())], "width long, mean double, variance double, buckets int")


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number that the operators' parameters name or imply; those below 1e-3 or above 1e15 as natural logarithms."""
    rows = [(type(p).__name__, name, float(x)) for p in DESCRIBED for name, x in describe(p).items() if isinstance(x, (int, float)) and not isinstance(x, bool)]
    size = F.abs("number")
    return spark.createDataFrame(rows, "operator string, name string, number double").withColumn("number", F.round(F.when((size == 0) | size.between(1e-3, 1e15), F.col("number")).otherwise(F.log(size)), 6))


def stream_sa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly aggregates by event type from the stream, as far as the watermark closes them."""
    found = run_once(tumbling_five(event_stream(spark, sf_dir, "event_type"), 3600))
    return _six(found, "sum")


def _stream_drift(spark: SparkSession, sf_dir: str, params: DriftParams) -> DataFrame:
    def step(state, event):
        return [(event.seq, state.last_index, state.last_direction)] if state.add(event.value) else []

    stream = fold_stream(event_stream(spark, sf_dir, "event_type"), lambda: DriftDetector(params), step, "seq long, index long, direction int")
    return run_once(stream).select("grp", "seq", "index", "direction")


def stream_dd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fires of dd_ph from a stream."""
    return _stream_drift(spark, sf_dir, DriftParams(PAGE_HINKLEY, 5.0, 500.0))


def stream_dd_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fires of dd_cusum from a stream."""
    return _stream_drift(spark, sf_dir, DriftParams(CUSUM, 5.0, 500.0, 50.0))


def stream_fd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fd_running from a stream."""

    def step(state, event):
        state.add(event.t, event.value)
        return [(event.seq, *state.read()[:3])]

    stream = fold_stream(event_stream(spark, sf_dir, "event_type"), lambda: DecayedSums(FADE), step, "seq long, count double, sum double, mean double")
    return _six(run_once(stream).drop("late"), "count", "sum", "mean")


def stream_adwin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adwin_state from a stream, as it stands after all events."""
    found = summary_stream(event_stream(spark, sf_dir, "event_type"), lambda: Adwin(AdwinParams()), lambda s, e: s.add(e.value), lambda s: [(s.width(), round(s.mean(), 6), round(s.variance(), 4), s.buckets())], "width long, mean double, variance double, buckets int")
    return latest(run_once(found))


def stream_eh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eh_approx from a stream, as it stands after all events."""
    rows = event_stream(spark, sf_dir, "event_type").filter("value > 0")
    found = summary_stream(rows, lambda: ExponentialHistogram(BUCKETS), lambda s, e: s.add(e.t, e.value), lambda s: [(float(s.count()), round(s.sum(), 6), s.buckets(), s.size())], "count double, sum double, buckets int, size long")
    return latest(run_once(found))


def stream_hk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hk_topk from a stream, as it stands after all events."""
    rows = event_stream(spark, sf_dir, "event_type")
    found = summary_stream(rows, lambda: HeavyKeeper(HEAVY), lambda s, e: s.add(e.key, e.weight), lambda s: [(i + 1, k, n) for i, (k, n) in enumerate(s.top())], "rank int, key long, count long", columns=("t", "seq", "key", "weight"))
    return latest(run_once(found))


def stream_shll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shll_ring from a stream, as it stands after all events."""
    rows = event_stream(spark, sf_dir, "event_type")
    found = summary_stream(rows, lambda: RingHyperLogLog(RINGS), lambda s, e: s.add(e.t, e.key), lambda s: [(int(s.count()), s.overflows, s.degraded())], "estimate long, overflows long, degraded boolean", columns=("t", "seq", "key"))
    return latest(run_once(found))
