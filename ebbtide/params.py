"""Parameters of the operators: frozen, checked when they are made, with a hint for a misspelt name."""

from __future__ import annotations

import difflib
import math
import sys
from dataclasses import dataclass, fields


def made(cls, **given):
    """``cls(**given)``; an unknown name is refused with the nearest known one."""
    names = [f.name for f in fields(cls)]
    for name in given:
        if name not in names:
            near = difflib.get_close_matches(name, names, 1, 0.6)
            raise ValueError(f"{cls.__name__} has no parameter {name!r}" + (f"; did you mean {near[0]!r}?" if near else f"; it has {', '.join(names)}"))
    return cls(**given)


def _need(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


def _finite(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


@dataclass(frozen=True)
class PaneWindow:
    """A hard window of ``window`` time units on a grid of ``panes`` panes.  An integer window keeps the grid exact."""

    window: int
    panes: int = 32

    def __post_init__(self):
        _need(isinstance(self.window, int) and self.window > 0, "window must be an integer above 0")
        _need(isinstance(self.panes, int) and 2 <= self.panes <= 1024, "panes must be from 2 to 1024")


@dataclass(frozen=True)
class HistogramParams:
    """Exponential histogram: relative error of counts ``epsilon`` over the last ``window``."""

    window: float
    epsilon: float = 0.01
    max_count: int = 2**32

    def __post_init__(self):
        _need(_finite(self.window) and self.window > 0, "window must be above 0")
        _need(_finite(self.epsilon) and 0 < self.epsilon < 1, "epsilon must be between 0 and 1")
        _need(isinstance(self.max_count, int) and self.max_count >= 1, "max_count must be at least 1")
        _need(self.capacity <= 2**22, "epsilon asks for too many buckets")

    @property
    def per_level(self) -> int:
        return math.ceil(1 / (2 * self.epsilon)) + 1

    @property
    def levels(self) -> int:
        return max(2, math.ceil(math.log2(max(self.max_count / (self.per_level + 1), 1))) + 2)

    @property
    def capacity(self) -> int:
        return (self.per_level + 1) * self.levels + 2


@dataclass(frozen=True)
class AdwinParams:
    """``delta``: the confidence of a cut; five buckets a level, of 64 levels."""

    delta: float = 0.002
    per_level = 5
    levels = 64

    def __post_init__(self):
        _need(_finite(self.delta) and 0 < self.delta < 1, "delta must be between 0 and 1")

    @property
    def capacity(self) -> int:
        """Buckets at most: a level is over by one while it cascades."""
        return (self.per_level + 1) * self.levels + 2


@dataclass(frozen=True)
class DecayParams:
    """Exponential decay; ``half_life`` in the unit of the times."""

    half_life: float

    def __post_init__(self):
        _need(_finite(self.half_life) and self.half_life > 0 and math.isfinite(math.log(2) / self.half_life), "half_life must be above 0 and its rate finite")

    @property
    def rate(self) -> float:
        return math.log(2) / self.half_life


@dataclass(frozen=True)
class HeavyKeeperParams:
    d: int = 4
    w: int = 1024
    k: int = 16
    seed: int = 0x9E3779B1
    b: float = 1.08

    def __post_init__(self):
        _need(isinstance(self.d, int) and 1 <= self.d <= 64, "d must be from 1 to 64")
        _need(isinstance(self.w, int) and 1 <= self.w <= 2**30 and self.d * self.w <= 2**27, "w must be from 1 to 2^30 and d * w at most 2^27")
        _need(isinstance(self.k, int) and 1 <= self.k <= 2**24, "k must be from 1 to 2^24")
        _need(_finite(self.b) and self.b > 1, "b must be above 1")

    @classmethod
    def with_accuracy(cls, k: int, error: float, **more) -> HeavyKeeperParams:
        _need(_finite(error) and 0 < error < 1, "error must be between 0 and 1")
        return made(cls, d=4, w=max(2 * k, math.ceil(1 / error)), k=k, **more)


@dataclass(frozen=True)
class DistinctParams:
    """Sliding HyperLogLog with 2^p registers; ``ring`` bounds the entries that a register keeps in the ordered form."""

    window: int
    p: int = 10
    ring: int = 8
    seed: int = 0x9E3779B1

    def __post_init__(self):
        _need(isinstance(self.window, int) and self.window > 0, "window must be an integer above 0")
        _need(isinstance(self.p, int) and 4 <= self.p <= 16, "p must be from 4 to 16")
        _need(self.ring in (2, 4, 8, 16, 32, 64), "ring must be a power of two from 2 to 64")

    @property
    def registers(self) -> int:
        return 1 << self.p

    @property
    def standard_error(self) -> float:
        return 1.04 / math.sqrt(self.registers)


PAGE_HINKLEY, CUSUM = 0, 1


@dataclass(frozen=True)
class DriftParams:
    mode: int = PAGE_HINKLEY
    delta: float = 0.005
    threshold: float = 50.0
    target: float | None = None
    latch: bool = False

    def __post_init__(self):
        _need(self.mode in (PAGE_HINKLEY, CUSUM), "mode must be PAGE_HINKLEY or CUSUM")
        _need(_finite(self.delta) and self.delta >= 0, "delta must be at least 0")
        _need(_finite(self.threshold) and self.threshold > 0, "threshold must be above 0")
        _need((self.target is not None and _finite(self.target)) if self.mode == CUSUM else self.target is None, "CUSUM needs a target and Page-Hinkley has none")
        _need(isinstance(self.latch, bool) and (not self.latch or self.threshold / 2 > 0), "latch needs half the threshold above 0")


@dataclass(frozen=True)
class QuantileParams:
    """Relative-error quantiles on a pane grid; ``bins`` a pane at most, unless ``strict`` refuses to collapse.

    A declared ``range`` of the positive values refuses those outside; if it fits the bins, nothing ever collapses.
    """

    window: int
    alpha: float = 0.01
    panes: int = 32
    strict: bool = False
    bins: int = 2048
    range: tuple[float, float] | None = None

    def __post_init__(self):
        PaneWindow(self.window, self.panes)
        _need(_finite(self.alpha) and 0 < self.alpha < 1, "alpha must be between 0 and 1")
        _need(isinstance(self.bins, int) and self.bins >= 2, "bins must be at least 2")
        if self.range is not None:
            _need(len(self.range) == 2 and all(map(_finite, self.range)) and 0 < self.range[0] < self.range[1], "a range is two numbers above 0, the smaller first")
            _need(not self.strict or self.fits, "the range spans more bins than there are")

    @property
    def fits(self) -> bool:
        """Whether the declared range never needs more bins than there are."""
        scale = math.log(self.gamma)
        return self.range is not None and math.ceil(math.log(self.range[1]) / scale) - math.ceil(math.log(self.range[0]) / scale) < self.bins

    @property
    def gamma(self) -> float:
        return (1 + self.alpha) / (1 - self.alpha)

    @property
    def keys(self) -> tuple[int, int]:
        """The least and the largest bin whose value is a normal double, within 32 bits."""
        value = lambda k: 2 * math.exp(k * math.log(self.gamma)) / (self.gamma + 1)
        half = math.log((self.gamma + 1) / 2)
        low, high = (int((math.log(x) + half) / math.log(self.gamma)) for x in (sys.float_info.min, sys.float_info.max))
        while value(low) < sys.float_info.min:
            low += 1
        while math.log(2 / (self.gamma + 1)) + high * math.log(self.gamma) >= math.log(sys.float_info.max):
            high -= 1
        return max(low, -(2**30)), min(high, 2**30)

    @property
    def least_indexable(self) -> float:
        """Values above it have a bin."""
        return self.gamma ** (self.keys[0] - 1)

    @property
    def most_indexable(self) -> float:
        return self.gamma ** self.keys[1]


@dataclass(frozen=True)
class CountMinParams:
    window: int
    w: int = 512
    d: int = 5
    panes: int = 32
    seed: int = 0x9E3779B1
    conservative: bool = True

    def __post_init__(self):
        PaneWindow(self.window, self.panes)
        _need(isinstance(self.w, int) and 1 <= self.w <= 2**16 and self.w & (self.w - 1) == 0, "w must be a power of two up to 2^16")
        _need(isinstance(self.d, int) and 1 <= self.d <= 32, "d must be from 1 to 32")

    @classmethod
    def with_accuracy(cls, window: int, epsilon: float = 0.01, delta: float = 0.01, **more) -> CountMinParams:
        _need(_finite(epsilon) and 0 < epsilon < 1 and _finite(delta) and 0 < delta < 1, "epsilon and delta must be between 0 and 1")
        return made(cls, window=window, w=1 << math.ceil(math.log2(math.ceil(math.e / epsilon))), d=min(32, max(1, math.ceil(math.log(1 / delta)))), **more)

    @property
    def epsilon(self) -> float:
        return math.e / self.w

    @property
    def delta(self) -> float:
        return math.exp(-self.d)


@dataclass(frozen=True)
class ReservoirParams:
    k: int
    half_life: float
    seed: int = 7

    def __post_init__(self):
        _need(isinstance(self.k, int) and 1 <= self.k <= 2**24, "k must be from 1 to 2^24")
        DecayParams(self.half_life)

    @property
    def rate(self) -> float:
        return math.log(2) / self.half_life


def describe(params) -> dict:
    """Every parameter by name, and what follows from them."""
    given = {f.name: getattr(params, f.name) for f in fields(params)}
    derived = {n: getattr(params, n) for n in dir(type(params)) if isinstance(getattr(type(params), n), property)}
    return given | derived
