"""Summaries whose state depends on the order of the events: one small state machine each.

Batch groups, streams and tests run the same objects.  ``add`` takes one event in order; readers don't change the state; a
state is pickled whole between the micro-batches of a stream, so it holds plain Python and numpy values only.  A refused
event leaves the state as it was.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from ..functions.hashing import GOLDEN, MASK, SECOND, finalize, hash_key, row_columns
from ..params import CUSUM, AdwinParams, CountMinParams, DecayParams, DistinctParams, DriftParams, HeavyKeeperParams, HistogramParams
from .distinct import ertl

BIG_KEY = 2**53 - 1


class Refused(ValueError):
    """The event is outside the operator's domain, or before the last one."""


def _number(x, limit: float = math.inf) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float, np.integer, np.floating)) or not math.isfinite(x) or abs(x) > limit:
        raise Refused(f"not a value that can be taken: {x!r}")
    return x


def _key(key) -> int:
    if isinstance(key, bool) or not isinstance(key, (int, np.integer)) or abs(int(key)) > BIG_KEY:
        raise Refused(f"not a key: {key!r}")
    return int(key)


class Summary:
    """A state machine, made of its parameters alone."""

    def clear(self) -> None:
        """Start anew, pseudo-random draws included."""
        self.__init__(self.params)


class Clock(Summary):
    """Time that doesn't run back."""

    def __init__(self):
        self.now: float | None = None

    def check(self, t) -> None:
        _number(t)
        if self.now is not None and t < self.now:
            raise Refused(f"time {t!r} is before {self.now!r}")


class ExponentialHistogram(Clock):
    """Count and sum of the last window from buckets whose sizes double: a count is off by epsilon of itself at most."""

    def __init__(self, params: HistogramParams):
        super().__init__()
        self.params = params
        self.levels: list[deque] = [deque()]  # of [last time, first time, sum], oldest first; level L holds 2^L events each

    def _expire(self, t) -> None:
        old = t - self.params.window
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()
        for level in reversed(self.levels):
            while level and level[0][0] <= old:
                level.popleft()
            if level:
                break

    def add(self, t, value=1) -> None:
        if _number(value) <= 0:
            raise Refused("a value must be above 0")
        self.check(t)
        if self.size() >= self.params.per_level * (2**self.params.levels - 1):
            raise Refused("more events in the window than max_count allows")
        self.now = t
        self._expire(t)
        self.levels[0].append([t, t, value])
        for i in range(len(self.levels)):
            if len(self.levels[i]) <= self.params.per_level:
                break
            a, b = self.levels[i].popleft(), self.levels[i].popleft()
            if i + 1 == len(self.levels):
                self.levels.append(deque())
            self.levels[i + 1].append([b[0], a[1], a[2] + b[2]])

    def advance(self, t) -> None:
        self.check(t)
        self.now = t
        self._expire(t)

    def size(self) -> int:
        """Events in the buckets, the straddling one whole."""
        return sum(len(level) << i for i, level in enumerate(self.levels))

    def _oldest(self) -> tuple[int, list] | None:
        return next(((i, self.levels[i][0]) for i in range(len(self.levels) - 1, -1, -1) if self.levels[i]), None)

    def _straddles(self) -> bool:
        oldest = self._oldest()
        return oldest is not None and oldest[1][1] <= self.now - self.params.window

    def count(self) -> float:
        return self.size() - ((1 << self._oldest()[0]) / 2 if self._straddles() else 0)

    def sum(self) -> float:
        total = sum(b[2] for level in self.levels for b in level)
        return total - (self._oldest()[1][2] / 2 if self._straddles() else 0)

    def buckets(self) -> int:
        return sum(map(len, self.levels))


class Adwin(Summary):
    """Mean and variance of the longest recent window whose parts don't differ in mean; tells when it has been cut."""

    LIMIT = math.sqrt(1.7976931348623157e308) / 2

    def __init__(self, params: AdwinParams):
        self.params = params
        self.centre = 0.0
        # count, sum, sum of squares, min, max of each bucket, oldest first, so levels stand from the highest to level 0;
        # sums are about the centre
        self.rows = np.zeros((5, params.capacity))
        self.used = 0
        self.levels = [0]  # buckets of each level

    def add(self, x) -> bool:
        x = float(_number(x, self.LIMIT))
        if not self.used:
            self.centre = x
        y = x - self.centre
        rows = self.rows
        rows[:, self.used] = 1, y, y * y, x, x
        self.used += 1
        self.levels[0] += 1
        if self.levels[0] > self.params.per_level:
            self._cascade()
        cut = False
        while self._differs():
            cut = True
            rows[:, : self.used - 1] = rows[:, 1 : self.used]
            self.used -= 1
            self.levels[-1] -= 1
            while len(self.levels) > 1 and not self.levels[-1]:
                self.levels.pop()
        if cut:
            c, s, q = rows[:3, : self.used]
            d = s.sum() / c.sum()
            self.centre += d
            q += c * d * d - 2 * d * s
            s -= c * d
        return cut

    def _cascade(self) -> None:
        """The two oldest buckets of a level that is over become one, which is the newest of the next where it stands."""
        rows, end = self.rows, self.used
        for i in range(len(self.levels)):
            at = end - self.levels[i]  # the level's oldest bucket
            if self.levels[i] <= self.params.per_level:
                break
            a, b = rows[:, at], rows[:, at + 1]
            a[:3] += b[:3]
            a[3], a[4] = min(a[3], b[3]), max(a[4], b[4])
            rows[:, at + 1 : self.used - 1] = rows[:, at + 2 : self.used]
            self.used -= 1
            self.levels[i] -= 2
            if i + 1 == len(self.levels):
                self.levels.append(0)
            self.levels[i + 1] += 1
            end = at + 1

    def _totals(self) -> tuple[float, float, float]:
        return tuple(self.rows[:3, : self.used].sum(axis=1).tolist())

    def _differs(self) -> bool:
        """Whether any split between buckets parts two means by more than chance.

        Both sides of the test are multiplied by n0 n1 / n.  What a cut would keep is looked at only if the variance alone
        doesn't rule a cut out.
        """
        used = self.used
        if used < 2:
            return False
        n0, s0, squares = self.rows[:3, :used].cumsum(axis=1)
        n, total = float(n0[-1]), float(s0[-1])
        mean = total / n
        term = math.log(2 * math.log(n) / self.params.delta)
        variance = max(float(squares[-1]) / n - mean * mean, 0.0)
        n0, s0 = n0[:-1], s0[:-1]
        over = np.abs(s0 - mean * n0) - np.sqrt((n0 - n0 * n0 / n) * (2 * variance * term))
        most = float(over.max())
        if most <= 0:
            return False
        spread = float(self.rows[4, 1:used].max()) - float(self.rows[3, 1:used].min())
        return most > 2 / 3 * spread * term

    def width(self) -> int:
        return int(self._totals()[0])

    def buckets(self) -> int:
        return self.used

    def mean(self) -> float:
        n, s, _ = self._totals()
        return self.centre + s / n if n else 0.0

    def variance(self) -> float:
        n, s, q = self._totals()
        return max(q / n - (s / n) ** 2, 0.0) if n else 0.0


class DriftDetector(Summary):
    """Two one-sided cumulative sums over a reference: the running mean (Page-Hinkley) or a target (CUSUM).

    A sum gains the deviation less ``delta`` and stays at least 0; above ``threshold`` it fires.  Without a latch a fire
    starts all over.  With one, a shift fires once: the firing sum is held at the threshold until it falls below half of
    it, which arms the detector again, or until the other sum fires.  The mean is that of the values since Page-Hinkley's
    last fire, or since CUSUM last started all over.
    """

    LIMIT = 1e150

    def __init__(self, params: DriftParams):
        self.params = params
        self.seen = 0
        self.n, self.running = 0, 0.0
        self.gaps = [0.0, 0.0]  # up, down
        self.latched: int | None = None  # the side that fired
        self.last_index: int | None = None
        self.last_direction: int | None = None

    def add(self, x) -> bool:
        x = float(_number(x, self.LIMIT))
        self.seen += 1
        self.n += 1
        self.running += (x - self.running) / self.n
        cusum = self.params.mode == CUSUM
        away = x - (self.params.target if cusum else self.running)
        self.gaps = [max(0.0, g + sign * away - self.params.delta) for g, sign in zip(self.gaps, (1, -1), strict=True)]
        limit = self.params.threshold
        if self.latched is None:
            if max(self.gaps) <= limit:
                return False
            return self._fire(0 if self.gaps[0] >= self.gaps[1] else 1)
        if self.gaps[1 - self.latched] > limit:
            return self._fire(1 - self.latched)
        if self.gaps[self.latched] < limit / 2:
            self.latched, self.gaps = None, [0.0, 0.0]
            if cusum:
                self.n, self.running = 0, 0.0
        else:
            self.gaps[self.latched] = min(self.gaps[self.latched], limit)
        return False

    def _fire(self, side: int) -> bool:
        self.last_index, self.last_direction = self.seen - 1, (1, -1)[side]
        if not self.params.latch or self.params.mode != CUSUM:
            self.n, self.running = 0, 0.0
        if self.params.latch:
            self.latched = side
            self.gaps[side] = self.params.threshold
        else:
            self.gaps = [0.0, 0.0]
        return True

    def read(self) -> tuple[float, float, int, float, float]:
        """(statistic, mean, count, last index, last direction); 0 for a count of 0, and NaN before the first fire."""
        last = [math.nan if x is None else float(x) for x in (self.last_index, self.last_direction)]
        return max(self.gaps) if self.n else 0.0, self.running if self.n else 0.0, self.n, *last


class HeavyKeeper(Summary):
    """The k keys of the most weight: d rows of fingerprints with counts, which other keys' events wear down by chance."""

    def __init__(self, params: HeavyKeeperParams):
        self.params = params
        self.marks = np.zeros((params.d, params.w), np.uint32)
        self.counts = np.zeros((params.d, params.w), np.int64)
        self.leaders: dict[int, int] = {}
        self.state = finalize((params.seed ^ 0x165667B1) & MASK) | 1

    def _draw(self) -> float:
        x = self.state
        x ^= (x << 13) & MASK
        x ^= x >> 17
        x ^= (x << 5) & MASK
        self.state = x
        return x / 2**32

    def _cells(self, key: int) -> tuple[int, list[int]]:
        seed = self.params.seed
        base = hash_key(key, seed ^ SECOND)
        return hash_key(key, seed), [finalize(base ^ ((r * GOLDEN) & MASK)) % self.params.w for r in range(self.params.d)]

    def add(self, key, weight=1) -> None:
        key = _key(key)
        if isinstance(weight, bool) or int(weight) != weight or not 1 <= weight <= MASK:
            raise Refused(f"not a weight: {weight!r}")
        weight = int(weight)
        mark, cells = self._cells(key)
        best = 0
        for row, cell in enumerate(cells):
            held = int(self.counts[row, cell])
            if held and int(self.marks[row, cell]) != mark:
                if self._draw() >= self.params.b**-held:
                    continue
                if held > weight:
                    self.counts[row, cell] = held - weight
                    continue
                held = 0
            self.marks[row, cell] = mark
            self.counts[row, cell] = now = min(held + weight, MASK)
            best = max(best, now)
        self._lead(key, best)

    def _lead(self, key: int, estimate: int) -> None:
        if key in self.leaders or (estimate and len(self.leaders) < self.params.k):
            self.leaders[key] = estimate
        elif estimate:
            least = min(self.leaders, key=self.leaders.__getitem__)
            if estimate > self.leaders[least]:
                del self.leaders[least]
                self.leaders[key] = estimate

    def estimate(self, key) -> int:
        mark, cells = self._cells(_key(key))
        return max((int(self.counts[r, c]) for r, c in enumerate(cells) if self.counts[r, c] and int(self.marks[r, c]) == mark), default=0)

    def size(self) -> int:
        """Leaders held, at most k."""
        return len(self.leaders)

    def top(self) -> list[tuple[int, int]]:
        return sorted(self.leaders.items(), key=lambda x: (-x[1], x[0]))


class PaneClock(Clock):
    """A clock over the grid of window / panes; ``live`` tells which panes the last ``w`` touches."""

    def __init__(self, window: int, panes: int):
        super().__init__()
        self.window, self.panes, self.oldest = window, panes, None

    def pane(self, t) -> int:
        return math.floor(t * self.panes / self.window) if not isinstance(t, int) else t * self.panes // self.window

    def first(self, w=None) -> int:
        return self.pane(self.now - (self.window if w is None else w))

    def move(self, t, *panes: dict) -> None:
        """Set the clock and forget the panes that have left the window."""
        self.check(t)
        self.now = t
        first = self.first()
        if first != self.oldest:
            self.oldest = first
            for held in panes:
                for p in [p for p in held if p < first]:
                    del held[p]


class ConservativeCountMin(PaneClock):
    """Count-Min cells that an event raises no further than its own estimate needs, in each pane."""

    def __init__(self, params: CountMinParams):
        super().__init__(params.window, params.panes)
        self.params = params
        self.cells: dict[int, list[dict[int, int]]] = {}
        self.totals: dict[int, int] = {}
        self.saturated = False  # whether a cell has ever met its limit

    def add(self, t, key, count=1) -> None:
        key = _key(key)
        if isinstance(count, bool) or int(count) != count or not 1 <= count <= MASK:
            raise Refused(f"not a count: {count!r}")
        self.move(t, self.cells, self.totals)
        pane = self.pane(t)
        if pane not in self.cells:
            self.cells[pane] = [{} for _ in range(self.params.d)]
        rows = self.cells[pane]
        self.totals[pane] = self.totals.get(pane, 0) + int(count)
        columns = row_columns(key, self.params.seed, self.params.d, self.params.w)
        self.saturated |= max(r.get(c, 0) for r, c in zip(rows, columns, strict=True)) + int(count) > MASK
        if self.params.conservative:
            goal = min(min(r.get(c, 0) for r, c in zip(rows, columns, strict=True)) + int(count), MASK)
            for r, c in zip(rows, columns, strict=True):
                r[c] = max(r.get(c, 0), goal)
        else:
            for r, c in zip(rows, columns, strict=True):
                r[c] = min(r.get(c, 0) + int(count), MASK)

    def advance(self, t) -> None:
        self.move(t, self.cells, self.totals)

    def estimate(self, key, w=None) -> float:
        if w is not None and not (math.isfinite(w) and 0 < w <= self.window):
            return math.nan
        columns = row_columns(_key(key), self.params.seed, self.params.d, self.params.w)
        live = [rows for p, rows in self.cells.items() if p >= self.first(w)] if self.now is not None else []
        return min(sum(rows[i].get(c, 0) for rows in live) for i, c in enumerate(columns))

    def total(self, w=None) -> float:
        if w is not None and not (math.isfinite(w) and 0 < w <= self.window):
            return math.nan
        return sum(n for p, n in self.totals.items() if p >= self.first(w)) if self.now is not None else 0


class RingHyperLogLog(Clock):
    """Registers that keep, for a bounded number of times, the ranks that a shorter window might still need."""

    def __init__(self, params: DistinctParams):
        super().__init__()
        self.params = params
        self.rings: dict[int, deque] = {}  # (time, rank): times ascend, ranks descend
        self.overflows = 0

    def add(self, t, key) -> None:
        key = _key(key)
        self.check(t)
        self.now = t
        h, g, p = hash_key(key, self.params.seed), hash_key(key, self.params.seed ^ SECOND), self.params.p
        rest = (h << p) & MASK
        rank = 33 - rest.bit_length() if rest else 32 - p + 33 - g.bit_length()
        ring = self.rings.setdefault(h >> (32 - p), deque())
        while ring and ring[-1][1] <= rank:
            ring.pop()
        while ring and ring[0][0] <= t - self.params.window:
            ring.popleft()
        if len(ring) == self.params.ring:
            ring.popleft()
            self.overflows += 1
        ring.append((t, rank))

    def advance(self, t) -> None:
        self.check(t)
        self.now = t

    def count(self, w=None) -> float:
        w = self.params.window if w is None else w
        if not (math.isfinite(w) and 0 < w <= self.params.window):
            return math.nan
        if self.now is None:
            return 0
        histogram = np.zeros(66 - self.params.p)
        for ring in self.rings.values():
            rank = next((r for t, r in ring if t > self.now - w), 0)
            histogram[rank] += 1
        histogram[0] += self.params.registers - histogram.sum()
        return round(ertl(histogram, self.params.registers))

    def degraded(self) -> bool:
        return self.overflows > 0


class DecayedSums(Clock):
    """Decayed count and sum as they stand after each event."""

    def __init__(self, params: DecayParams):
        super().__init__()
        self.params, self.c, self.s = params, 0.0, 0.0

    def add(self, t, value=1) -> None:
        value = float(_number(value))
        self.check(t)
        fade = math.exp(-self.params.rate * (t - self.now)) if self.now is not None else 0.0
        self.c, self.s, self.now = self.c * fade + 1, self.s * fade + value, t

    def read(self, at=None) -> tuple[float, float, float, float]:
        """(count, sum, mean, rate) at a time not before the last event."""
        if self.now is None:
            return 0.0, 0.0, 0.0, 0.0
        if at is not None and at < self.now:
            raise Refused("a query before the last event")
        fade = math.exp(-self.params.rate * ((self.now if at is None else at) - self.now))
        return self.c * fade, self.s * fade, self.s / self.c, self.c * fade * self.params.rate


class SlidingFive(PaneClock):
    """Exact count, sum, mean, min and max over the panes that the window touches; sums are compensated."""

    LIMIT = 1e150

    def __init__(self, window: int, panes: int = 32):
        super().__init__(window, panes)
        self.held: dict[int, tuple] = {}

    def clear(self) -> None:
        self.__init__(self.window, self.panes)

    def add(self, t, value) -> None:
        value = float(_number(value, self.LIMIT))
        self.move(t, self.held)
        n, s, c, lo, hi = self.held.get(self.pane(t), (0, 0.0, 0.0, math.inf, -math.inf))
        total = s + value
        c += (s - total) + value if abs(s) >= abs(value) else (value - total) + s
        self.held[self.pane(t)] = (n + 1, total, c, min(lo, value), max(hi, value))

    def advance(self, t) -> None:
        self.move(t, self.held)

    def read(self, w=None) -> tuple[float, float, float, float, float]:
        """(count, sum, mean, min, max) of the last ``w``; a bad w gives NaN."""
        nan = math.nan
        if w is not None and not (math.isfinite(w) and 0 < w <= self.window):
            return nan, nan, nan, nan, nan
        live = [x for p, x in self.held.items() if p >= self.first(w)] if self.now is not None else []
        if not live:
            return 0, 0.0, nan, nan, nan
        n, total = sum(x[0] for x in live), math.fsum(y for x in live for y in x[1:3])
        return n, total, total / n, min(x[3] for x in live), max(x[4] for x in live)
