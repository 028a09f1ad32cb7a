import pytest

from ebbtide import params as P


def test_a_misspelt_parameter_is_refused_with_a_hint():
    with pytest.raises(ValueError, match="did you mean 'panes'"):
        P.made(P.PaneWindow, window=10, pane=4)
    assert P.made(P.PaneWindow, window=10, panes=4).panes == 4


@pytest.mark.parametrize(
    "make",
    [
        lambda: P.PaneWindow(0),
        lambda: P.PaneWindow(10, 1),
        lambda: P.PaneWindow(10.5),
        lambda: P.HistogramParams(10, 1.0),
        lambda: P.HistogramParams(float("nan")),
        lambda: P.AdwinParams(0),
        lambda: P.DecayParams(0),
        lambda: P.DecayParams(5e-324),
        lambda: P.HeavyKeeperParams(b=1.0),
        lambda: P.HeavyKeeperParams(d=64, w=2**27),
        lambda: P.DistinctParams(10, 3),
        lambda: P.DistinctParams(10, 10, 3),
        lambda: P.DriftParams(P.CUSUM),
        lambda: P.DriftParams(P.PAGE_HINKLEY, target=1.0),
        lambda: P.DriftParams(threshold=0),
        lambda: P.QuantileParams(10, 1.0),
        lambda: P.QuantileParams(10, range=(2.0, 1.0)),
        lambda: P.QuantileParams(10, strict=True, range=(1e-300, 1e300)),
        lambda: P.CountMinParams(10, w=500),
        lambda: P.ReservoirParams(0, 1.0),
    ],
)
def test_bad_parameters_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_sizes_that_follow_from_accuracy():
    assert P.CountMinParams.with_accuracy(10).w == 512 and P.CountMinParams.with_accuracy(10).d == 5
    assert P.HeavyKeeperParams.with_accuracy(10, 0.001).w == 1000
    assert P.HistogramParams(1000, 0.01).per_level == 51


def test_describe_tells_what_follows():
    told = P.describe(P.DistinctParams(10))
    assert told["window"] == 10 and told["registers"] == 1024 and told["standard_error"] == pytest.approx(0.0325)
