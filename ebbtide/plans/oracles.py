"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

import math

from ..functions.hashing import GOLDEN, MASK, SECOND, finalize
from ..functions.timegrid import DAY
from ..params import CountMinParams, DistinctParams, HeavyKeeperParams, HistogramParams, QuantileParams
from .queries import BUCKETS, CAREFUL, CELLS, HEAVY, IDLE, LATER, MIDDLE, QUANTILES, RINGS, SETS, WEEK, WIDE

EVENTS = """e AS (
  SELECT {grp} AS grp, epoch_us(ts) AS t, event_id AS seq, value, user_id AS key, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS weight FROM events
)"""
BY_USER, BY_TYPE = EVENTS.format(grp="user_id"), EVENTS.format(grp="event_type")
COUNTED = BY_USER.replace("e AS", "r AS", 1) + ", e AS (SELECT * REPLACE (row_number() OVER (PARTITION BY grp ORDER BY t, seq) AS t) FROM r)"
FIVE = "CAST(count(*) AS BIGINT) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, round(sum(value) / count(*), 6) AS mean"


def pane(t: str, window: int, panes: int) -> str:
    return f"(({t}) * {panes} - ((({t}) * {panes}) % {window} + {window}) % {window}) // {window}"


def covered(events: str, window: int, panes: int, span: int | None = None, now: str = "max(t) OVER (PARTITION BY grp)") -> str:
    """CTEs up to ``live``: the events in the panes that a window touches."""
    return f"""WITH {events}, timed AS (SELECT *, {now} AS now FROM e),
live AS (SELECT * FROM timed WHERE {pane("t", window, panes)} >= {pane(f"now - {span or window}", window, panes)})"""


def snapshot(span: int | None = None) -> str:
    return f"{covered(BY_USER, DAY, 32, span)} SELECT grp, now, {FIVE} FROM live GROUP BY grp, now"


def bins(p: QuantileParams, events: str, span: int | None, qs: list[float] | None, now: str = "max(t) OVER (PARTITION BY grp)") -> str:
    scale = repr(1 / math.log(p.gamma))
    sql = f"""{covered(events, p.window, p.panes, span, now)},
binned AS (SELECT grp, {pane("t", p.window, p.panes)} AS pane, CASE WHEN value > 0 THEN CAST(ceil(ln(CASE WHEN value > 0 THEN value ELSE 1 END) * {scale}) AS BIGINT) END AS bin FROM live),
folded AS (SELECT grp, greatest(bin, max(bin) OVER (PARTITION BY grp, pane) - {p.bins - 1}) AS bin, bin IS NULL AS zero FROM binned),
again AS (SELECT grp, CASE WHEN zero THEN NULL ELSE greatest(bin, max(CASE WHEN zero THEN NULL ELSE bin END) OVER (PARTITION BY grp) - {p.bins - 1}) END AS bin FROM folded),
summed AS (SELECT grp, bin, count(*) AS n FROM again GROUP BY grp, bin)"""
    if qs is None:
        return sql + " SELECT grp, CAST(sum(n) AS BIGINT) AS count, CAST(coalesce(sum(n) FILTER (WHERE bin IS NULL), 0) AS BIGINT) AS zeros, count(bin) AS bins FROM summed GROUP BY grp"
    return sql + f""",
ranked AS (SELECT grp, bin, n, sum(n) OVER (PARTITION BY grp ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY grp) AS total FROM summed)
SELECT grp, q, round(coalesce(2 * pow({p.gamma!r}, bin) / {p.gamma + 1!r}, 0), 6) AS quantile, CAST(total AS BIGINT) AS count
FROM ranked, (SELECT unnest(CAST({[float(q) for q in qs]} AS DOUBLE[])) AS q)
WHERE upto > floor(q * (total - 1)) AND upto - n <= floor(q * (total - 1))"""


def murmur(source: str, seed: int, name: str) -> str:
    """``source`` with a column ``name``: the 32-bit hash of its column ``key`` under a seed."""
    steps = [("low", f"abs(key) & {MASK}"), ("high", f"xor(abs(key) >> 32, CASE WHEN key < 0 THEN 1 ELSE 0 END) & {MASK}"), ("h", f"CAST({seed & MASK} AS HUGEINT)")]
    for word in ("low", "high"):
        steps += [
            ("k", f"(CAST({word} AS HUGEINT) * {0xCC9E2D51}) % 4294967296"),
            ("k", "((k * 32768) % 4294967296) + (k // 131072)"),
            ("k", f"(k * {0x1B873593}) % 4294967296"),
            ("h", "xor(h, k)"),
            ("h", "((h * 8192) % 4294967296) + (h // 524288)"),
            ("h", f"(h * 5 + {0xE6546B64}) % 4294967296"),
        ]
    steps.append(("h", "xor(h, CAST(8 AS HUGEINT))"))
    return finalizer(_steps(source, steps), "h", name, drop="low, high, k")


def _steps(source: str, steps: list[tuple[str, str]]) -> str:
    have: set[str] = set()
    for name, sql in steps:
        source = f"SELECT * {'REPLACE' if name in have else ','} {'(' if name in have else ''}{sql} AS {name}{')' if name in have else ''} FROM ({source})"
        have.add(name)
    return source


def finalizer(source: str, of: str, name: str, drop: str = "") -> str:
    for shift, times in ((65536, 0x85EBCA6B), (8192, 0xC2B2AE35), (65536, 1)):
        source = f"SELECT * REPLACE ((xor({of}, {of} // {shift}) * {times}) % 4294967296 AS {of}) FROM ({source})"
    return f"SELECT * EXCLUDE ({of}{', ' + drop if drop else ''}), {of} AS {name} FROM ({source})"


def hashed_keys(events: str, seed: int) -> str:
    return f"WITH {events}, hashed AS ({murmur(murmur('SELECT DISTINCT key FROM e', seed, 'h1'), seed ^ SECOND, 'h2')})"


def ranked(p: DistinctParams, events: str) -> str:
    """CTEs up to ``ranks``: each event with its register, its rank and its group's last time."""
    rest = f"((h1 * {1 << p.p}) % 4294967296)"
    zeros = lambda x: f"(CASE WHEN {x} = 0 THEN 32 ELSE 31 - CAST(floor(log2(CAST({x} AS DOUBLE))) AS INTEGER) END)"
    return f"""{hashed_keys(events, p.seed)}, timed AS (SELECT *, max(t) OVER (PARTITION BY grp) AS now FROM e),
ranks AS (SELECT grp, t, seq, now, CAST(h1 // {1 << (32 - p.p)} AS INTEGER) AS register,
  CAST(CASE WHEN {rest} > 0 THEN {zeros(rest)} + 1 ELSE {32 - p.p} + {zeros("h2")} + 1 END AS INTEGER) AS rank FROM timed JOIN hashed USING (key))"""


def registers(p: DistinctParams, events: str = BY_TYPE, span: int | None = None, now: str = "now") -> str:
    return f"{ranked(p, events)}, regs AS (SELECT grp, register, max(rank) AS rank FROM ranks WHERE t > {now} - {span or p.window} GROUP BY 1, 2)"


def estimated(p: DistinctParams) -> str:
    """CTE ``estimates`` of the groups in ``regs`` (a rank of 0 is an empty register): Ertl's estimator, its series cut at 60 terms."""
    q, m = 64 - p.p, p.registers
    tau = "CASE WHEN x IN (0, 1) THEN 0 ELSE (1 - x - list_sum(list_transform(range(1, 61), lambda k: pow(1 - pow(x, pow(2, -k)), 2) * pow(2, -k)))) / 3 END"
    sigma = "x + list_sum(list_transform(range(1, 61), lambda k: pow(x, pow(2, k)) * pow(2, k - 1)))"
    return f"""spread AS (SELECT grp, list(rank) AS ranks FROM regs WHERE rank > 0 GROUP BY grp),
binned AS (SELECT grp, list_transform(range(0, {q + 2}), lambda k: CASE WHEN k = 0 THEN {m} - len(ranks) ELSE len(list_filter(ranks, lambda r: r = k)) END) AS c FROM spread),
high AS (SELECT *, {m} * (SELECT {tau} FROM (SELECT 1 - c[{q + 2}] / {m} AS x)) AS z0, (SELECT {sigma} FROM (SELECT c[1] / {m} AS x)) AS low FROM binned),
summed AS (SELECT grp, list_reduce(range(0, {q}), lambda z, i: (z + c[{q} - i + 1]) / 2, CAST(z0 AS DOUBLE)) + {m} * low AS z FROM high),
estimates AS (SELECT grp, CAST(round({m * m / (2 * math.log(2))!r} / z) AS BIGINT) AS estimate FROM summed)"""


def ring(p: DistinctParams) -> str:
    """Each register's ring as a fold over its events, oldest first."""
    step = f"""list_transform([list_filter(a.ring, lambda y: y.r > x.r AND y.t > x.t - {p.window})], lambda kept: {{
  'ring': list_append(CASE WHEN len(kept) = {p.ring} THEN kept[2:] ELSE kept END, {{'t': x.t, 'r': x.r}}), 'over': a.over + CASE WHEN len(kept) = {p.ring} THEN 1 ELSE 0 END}})[1]"""
    start = "{'ring': CAST([] AS STRUCT(t BIGINT, r INTEGER)[]), 'over': CAST(0 AS BIGINT)}"
    return f"""{ranked(p, BY_TYPE)}, rings AS (SELECT grp, max(now) AS now, register, list_reduce(list({{'t': t, 'r': rank}} ORDER BY t, seq), lambda a, x: {step}, {start}) AS s FROM ranks GROUP BY grp, register),
regs AS (SELECT grp, s.over AS over, coalesce(list_filter(s.ring, lambda y: y.t > now - {p.window})[1].r, 0) AS rank FROM rings), {estimated(p)}
SELECT grp, any_value(coalesce(estimate, 0)) AS estimate, CAST(sum(over) AS BIGINT) AS overflows, sum(over) > 0 AS degraded FROM regs LEFT JOIN estimates USING (grp) GROUP BY grp"""


def cells(p: CountMinParams) -> str:
    spread = f"SELECT key, row, xor(xor(h1, h2), CAST((row * {GOLDEN}) % 4294967296 AS HUGEINT)) AS x FROM hashed, (SELECT unnest(range({p.d})) AS row)"
    return f"""{hashed_keys(BY_TYPE, p.seed)}, placed AS (SELECT key, CAST(row AS INTEGER) AS row, CAST(y % {p.w} AS INTEGER) AS col FROM ({finalizer(spread, 'x', 'y')})),
timed AS (SELECT *, max(t) OVER (PARTITION BY grp) AS now, {pane("t", p.window, p.panes)} AS pane FROM e),
cells AS (SELECT grp, pane, row, col, any_value(now) AS now, CAST(least(sum(weight), {MASK}) AS BIGINT) AS n FROM timed JOIN placed USING (key) GROUP BY 1, 2, 3, 4)"""


def careful_cells(p: CountMinParams) -> str:
    """The same CTEs, a pane's cells as a fold over its events; each (group, pane) has a list of the cells that it touches."""
    step = """list_transform([list_min(list_transform(x.path, lambda i: a[i])) + x.w], lambda goal: list_transform(a, lambda v, i: CASE WHEN list_contains(x.path, i) THEN greatest(v, goal) ELSE v END))[1]"""
    return f"""{cells(p).replace(", cells AS (", ", plain AS (").replace(chr(10) + "cells AS (", chr(10) + "plain AS (")},
named AS (SELECT *, row_number() OVER (PARTITION BY grp, pane ORDER BY row, col) AS i FROM (SELECT DISTINCT grp, pane, row, col FROM plain)),
touched AS (SELECT grp, pane, t, seq, any_value(now) AS now, any_value(weight) AS w, list(i) AS path FROM timed JOIN placed USING (key) JOIN named USING (grp, pane, row, col) GROUP BY grp, pane, t, seq),
widths AS (SELECT grp, pane, count(*) AS width FROM named GROUP BY 1, 2),
folded AS (SELECT grp, pane, any_value(now) AS now, list_reduce(list({{'path': path, 'w': w}} ORDER BY t, seq), lambda a, x: {step}, list_transform(range(0, any_value(width)), lambda i: CAST(0 AS BIGINT))) AS held FROM touched JOIN widths USING (grp, pane) GROUP BY grp, pane),
cells AS (SELECT grp, pane, row, col, now, CAST(least(held[i], {MASK}) AS BIGINT) AS n FROM folded JOIN named USING (grp, pane))"""


def asked(p: CountMinParams, keys: str) -> str:
    """(grp, key, estimate) of the pairs in ``keys``, with ``cells`` and ``placed`` at hand."""
    return f"""sums AS (SELECT grp, row, col, sum(n) AS n FROM cells WHERE pane >= {pane(f"now - {p.window}", p.window, p.panes)} GROUP BY 1, 2, 3),
asked AS (SELECT grp, key, CAST(min(coalesce(n, 0)) AS BIGINT) AS estimate FROM ({keys}) JOIN placed USING (key) LEFT JOIN sums USING (grp, row, col) GROUP BY grp, key)"""


def buckets(p: HistogramParams, at: int | None = None) -> str:
    """The histogram's buckets, oldest first, as a fold; a level that is over gives its two oldest to the next."""
    kind = "STRUCT(lvl BIGINT, last BIGINT, first BIGINT, s DOUBLE)[]"
    window = int(p.window)
    merge = f"""CASE WHEN len(list_filter(b, lambda y: y.lvl = l)) <= {p.per_level} THEN b ELSE list_transform([list_position(list_transform(b, lambda y: y.lvl), l)], lambda i:
  list_concat(list_append(b[:i - 1], {{'lvl': l + 1, 'last': b[i + 1].last, 'first': b[i].first, 's': b[i].s + b[i + 1].s}}), b[i + 2:]))[1] END"""
    step = f"list_reduce(range(0, 24), lambda b, l: {merge}, list_append(list_filter(a, lambda y: y.last > x.t - {window}), {{'lvl': CAST(0 AS BIGINT), 'last': x.t, 'first': x.t, 's': x.v}}))"
    half = "CASE WHEN b[1].first <= now - {w} THEN {x} / 2 ELSE 0 END".replace("{w}", str(window))
    return f"""WITH {BY_TYPE}, folded AS (SELECT grp, {at or "max(t)"} AS now, list_reduce(list({{'t': t, 'v': value}} ORDER BY t, seq), lambda a, x: {step}, CAST([] AS {kind})) AS held FROM e WHERE value > 0 GROUP BY grp),
live AS (SELECT grp, now, list_filter(held, lambda y: y.last > now - {window}) AS b FROM folded), sized AS (SELECT *, CAST(coalesce(list_sum(list_transform(b, lambda y: 1 << y.lvl)), 0) AS BIGINT) AS size FROM live)
SELECT grp, size - {half.replace("{x}", "CAST(1 << coalesce(b[1].lvl, 0) AS DOUBLE)")} AS count, round(coalesce(list_sum(list_transform(b, lambda y: y.s)), 0) - {half.replace("{x}", "b[1].s")}, 6) AS sum, CAST(len(b) AS INTEGER) AS buckets, size FROM sized"""


def heavy(p: HeavyKeeperParams) -> str:
    """CTE ``kept``: the cells that a group's keys touch as two lists, the leaders and the draws, as a fold; ``path`` is an event's cells by row."""
    start = finalize((p.seed ^ 0x165667B1) & MASK) | 1
    spread = f"SELECT key, row, xor(h2, CAST((row * {GOLDEN}) % 4294967296 AS HUGEINT)) AS x FROM hashed, (SELECT unnest(range({p.d})) AS row)"
    draw = "list_transform([xor(c.rng, (c.rng * 8192) % 4294967296)], lambda r: list_transform([xor(r, r // 131072)], lambda r2: xor(r2, (r2 * 32) % 4294967296))[1])[1]"
    put = lambda names, i, x: f"list_concat(list_append({names}[:{i} - 1], {x}), {names}[{i} + 1:])"
    take = lambda held: f"{{'cnt': {put('c.cnt', 'i', f'least({held} + x.w, {MASK})')}, 'mk': {put('c.mk', 'i', 'x.mark')}, 'rng': rng, 'best': greatest(c.best, least({held} + x.w, {MASK}))}}"
    cell = f"""list_transform([CASE WHEN c.cnt[i] > 0 AND c.mk[i] <> x.mark THEN {draw} ELSE c.rng END], lambda rng:
  CASE WHEN c.cnt[i] = 0 OR c.mk[i] = x.mark THEN {take("c.cnt[i]")}
  WHEN rng / 4294967296.0 >= pow({p.b!r}, -c.cnt[i]) THEN {{'cnt': c.cnt, 'mk': c.mk, 'rng': rng, 'best': c.best}}
  WHEN c.cnt[i] > x.w THEN {{'cnt': {put("c.cnt", "i", "c.cnt[i] - x.w")}, 'mk': c.mk, 'rng': rng, 'best': c.best}}
  ELSE {take("0")} END)[1]"""
    lead = f"""CASE WHEN list_contains(list_transform(a.top, lambda y: y.k), x.key) THEN list_transform(a.top, lambda y: CASE WHEN y.k = x.key THEN {{'k': y.k, 'n': n.best}} ELSE y END)
  WHEN n.best > 0 AND len(a.top) < {p.k} THEN list_append(a.top, {{'k': x.key, 'n': n.best}})
  WHEN n.best > list_min(list_transform(a.top, lambda y: y.n)) THEN list_transform([list_position(list_transform(a.top, lambda y: y.n), list_min(list_transform(a.top, lambda y: y.n)))], lambda j: list_append(list_concat(a.top[:j - 1], a.top[j + 1:]), {{'k': x.key, 'n': n.best}}))[1]
  ELSE a.top END"""
    step = f"list_transform([list_reduce(x.path, lambda c, i: {cell}, {{'cnt': a.cnt, 'mk': a.mk, 'rng': a.rng, 'best': CAST(0 AS BIGINT)}})], lambda n: {{'cnt': n.cnt, 'mk': n.mk, 'rng': n.rng, 'top': {lead}}})[1]"
    none = "list_transform(range(0, any_value(width)), lambda i: CAST(0 AS BIGINT))"
    return f"""{hashed_keys(BY_TYPE, p.seed)}, placed AS (SELECT key, row, CAST(y % {p.w} AS BIGINT) AS col FROM ({finalizer(spread, "x", "y")})),
named AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY row, col) AS i FROM (SELECT DISTINCT grp, row, col FROM e JOIN placed USING (key))),
paths AS (SELECT grp, key, list(i ORDER BY row) AS path FROM (SELECT DISTINCT grp, key FROM e) JOIN placed USING (key) JOIN named USING (grp, row, col) GROUP BY grp, key),
widths AS (SELECT grp, count(*) AS width FROM named GROUP BY grp),
marked AS (SELECT e.grp, t, seq, e.key, weight AS w, CAST(h1 AS BIGINT) AS mark, path, width FROM e JOIN paths ON paths.grp = e.grp AND paths.key = e.key JOIN hashed ON hashed.key = e.key JOIN widths ON widths.grp = e.grp),
kept AS (SELECT grp, list_reduce(list({{'key': key, 'w': w, 'mark': mark, 'path': path}} ORDER BY t, seq), lambda a, x: {step}, {{'cnt': {none}, 'mk': {none}, 'rng': CAST({start} AS BIGINT), 'top': CAST([] AS STRUCT(k BIGINT, n BIGINT)[])}}) AS s FROM marked GROUP BY grp)"""


def drift_state(cusum: bool, latch: bool, delta: float = 5.0, threshold: float = 500.0, target: float = 50.0) -> str:
    """What the detector reads at the end, as a fold over each group's events."""
    away = f"x.v - {target}" if cusum else "x.v - m"
    moved = f"list_transform([a.m + (x.v - a.m) / (a.n + 1)], lambda m: {{'i': a.i + 1, 'n': a.n + 1, 'm': m, 'up': greatest(0.0, a.up + ({away}) - {delta}), 'dn': greatest(0.0, a.dn - ({away}) - {delta}), 'side': a.side, 'li': a.li, 'ld': a.ld}})[1]"
    first = f"CASE WHEN greatest(v.up, v.dn) <= {threshold} THEN 0 WHEN v.up >= v.dn THEN 1 ELSE -1 END"
    fired = f"CASE WHEN v.side = 0 THEN {first} WHEN CASE WHEN v.side = 1 THEN v.dn ELSE v.up END > {threshold} THEN -v.side ELSE 0 END" if latch else first
    arms = f"f = 0 AND v.side <> 0 AND CASE WHEN v.side = 1 THEN v.up ELSE v.dn END < {threshold / 2}"
    gap = lambda g, s: f"CASE WHEN f = {s} THEN {threshold if latch else 0.0} WHEN f <> 0 THEN {f'v.{g}' if latch else 0.0} WHEN {arms} THEN 0.0 WHEN v.side = {s} THEN least(v.{g}, {threshold}) ELSE v.{g} END"
    anew = arms if cusum and latch else "f <> 0"
    step = f"""list_transform([{moved}], lambda v: list_transform([{fired}], lambda f: {{'i': v.i, 'n': CASE WHEN {anew} THEN 0 ELSE v.n END, 'm': CASE WHEN {anew} THEN 0.0 ELSE v.m END,
  'up': {gap("up", 1)}, 'dn': {gap("dn", -1)}, 'side': CASE WHEN {'FALSE' if latch else 'TRUE'} THEN 0 WHEN f <> 0 THEN f WHEN {arms} THEN 0 ELSE v.side END,
  'li': CASE WHEN f <> 0 THEN v.i - 1 ELSE v.li END, 'ld': CASE WHEN f <> 0 THEN f ELSE v.ld END}})[1])[1]"""
    start = "{'i': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'm': CAST(0 AS DOUBLE), 'up': CAST(0 AS DOUBLE), 'dn': CAST(0 AS DOUBLE), 'side': CAST(0 AS INTEGER), 'li': CAST(NULL AS BIGINT), 'ld': CAST(NULL AS INTEGER)}"
    return f"""WITH {BY_TYPE}, folded AS (SELECT grp, list_reduce(list({{'v': value}} ORDER BY t, seq), lambda a, x: {step}, {start}) AS s FROM e GROUP BY grp)
SELECT grp, CASE WHEN s.n = 0 THEN 0.0 ELSE round(greatest(s.up, s.dn), 6) END AS statistic, round(s.m, 6) AS mean, s.n AS count, s.li AS last_index, s.ld AS last_direction FROM folded"""


def adaptive(delta: float, value: str) -> str:
    """CTE ``folded``: the adaptive window's buckets, oldest first, its centre, and where it has been cut."""
    kind = "STRUCT(lvl BIGINT, n DOUBLE, s DOUBLE, q DOUBLE, lo DOUBLE, hi DOUBLE)[]"
    merge = """CASE WHEN len(list_filter(b, lambda y: y.lvl = l)) <= 5 THEN b ELSE list_transform([list_position(list_transform(b, lambda y: y.lvl), l)], lambda i: list_concat(list_append(b[:i - 1],
  {'lvl': l + 1, 'n': b[i].n + b[i + 1].n, 's': b[i].s + b[i + 1].s, 'q': b[i].q + b[i + 1].q, 'lo': least(b[i].lo, b[i + 1].lo), 'hi': greatest(b[i].hi, b[i + 1].hi)}), b[i + 2:]))[1] END"""
    grown = f"list_reduce(range(0, 24), lambda b, l: {merge}, list_append(a.b, {{'lvl': CAST(0 AS BIGINT), 'n': 1.0::DOUBLE, 's': x.v - c, 'q': (x.v - c) * (x.v - c), 'lo': x.v, 'hi': x.v}}))"
    total = lambda b, f: f"list_sum(list_transform({b}, lambda y: y.{f}))"
    limits = f"""{{'n': {total("d.b", "n")}, 's': {total("d.b", "s")}, 'q': {total("d.b", "q")}, 'r': list_max(list_transform(d.b[2:], lambda y: y.hi)) - list_min(list_transform(d.b[2:], lambda y: y.lo))}}"""
    test = f"""list_transform([{limits}], lambda w: list_transform([{{'e': ln(2 * ln(w.n) / {delta}), 'var': greatest(w.q / w.n - (w.s / w.n) * (w.s / w.n), 0)}}], lambda u:
  list_reduce(d.b[:-2], lambda p, y: {{'n': p.n + y.n, 's': p.s + y.s, 'hit': p.hit OR abs((p.s + y.s) / (p.n + y.n) - (w.s - p.s - y.s) / (w.n - p.n - y.n)) >
    sqrt(2 * u.var * u.e * (1 / (p.n + y.n) + 1 / (w.n - p.n - y.n))) + 2 / 3.0::DOUBLE * w.r * u.e * (1 / (p.n + y.n) + 1 / (w.n - p.n - y.n))}}, {{'n': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'hit': FALSE}}).hit)[1])[1]"""
    drops = f"list_reduce(range(0, 100), lambda d, k: CASE WHEN d.done OR len(d.b) < 2 THEN d WHEN {test} THEN {{'b': d.b[2:], 'cut': TRUE, 'done': FALSE}} ELSE {{'b': d.b, 'cut': d.cut, 'done': TRUE}} END, {{'b': {grown}, 'cut': FALSE, 'done': FALSE}})"
    centred = """list_transform([CASE WHEN g.cut THEN list_sum(list_transform(g.b, lambda y: y.s)) / list_sum(list_transform(g.b, lambda y: y.n)) ELSE 0.0 END], lambda m: {'c': c + m,
  'b': CASE WHEN g.cut THEN list_transform(g.b, lambda y: {'lvl': y.lvl, 'n': y.n, 's': y.s - y.n * m, 'q': y.q + y.n * m * m - 2 * m * y.s, 'lo': y.lo, 'hi': y.hi}) ELSE g.b END})[1]"""
    step = f"""list_transform([CASE WHEN len(a.b) = 0 THEN x.v ELSE a.c END], lambda c: list_transform([{drops}], lambda g: list_transform([{centred}], lambda h: {{'b': h.b, 'c': h.c,
  'out': CASE WHEN g.cut THEN list_append(a.out, {{'seq': x.seq, 'width': CAST({total("h.b", "n")} AS BIGINT), 'mean': h.c + {total("h.b", "s")} / {total("h.b", "n")}}}) ELSE a.out END}})[1])[1])[1]"""
    start = f"{{'b': CAST([] AS {kind}), 'c': CAST(0 AS DOUBLE), 'out': CAST([] AS STRUCT(seq BIGINT, width BIGINT, mean DOUBLE)[])}}"
    return f"WITH {BY_TYPE}, folded AS (SELECT grp, list_reduce(list({{'v': {value}, 'seq': seq}} ORDER BY t, seq), lambda a, x: {step}, {start}) AS s FROM e GROUP BY grp)"


def known_groups(found: str, columns: str, events: str = BY_USER) -> str:
    """``found`` (a row a group) for every group; ``columns`` says what a group without a row has."""
    with_, _, select = found.rpartition("\nSELECT ")
    return f"{with_}, found AS (SELECT {select})\nSELECT grp, {columns} FROM (SELECT DISTINCT grp FROM e) LEFT JOIN found USING (grp)"


def implied() -> str:
    """What follows from the parameters, written out."""
    ln2 = "ln(2)"
    gamma = "(1.02 / 0.98)"
    half, tiny, huge = f"ln(({gamma} + 1) / 2)", "2.2250738585072014e-308", "1.7976931348623157e308"
    low, high = f"ceil((ln({tiny}) + {half}) / ln({gamma}))", f"floor((ln({huge}) + {half}) / ln({gamma}))"
    per = "(ceil(1 / (2 * 0.05)) + 1)"
    lvl = f"greatest(2, ceil(log2(4294967296 / ({per} + 1))) + 2)"
    w = "pow(2, ceil(log2(ceil(exp(1) / 0.001))))"
    d = "ceil(ln(1 / 0.001))"
    named = {
        "HistogramParams": {"window": str(WEEK), "epsilon": "0.05", "max_count": "4294967296", "per_level": per, "levels": lvl, "capacity": f"({per} + 1) * {lvl} + 2"},
        "AdwinParams": {"delta": "0.002", "capacity": "64 * 6 + 2"},
        "DecayParams": {"half_life": str(DAY), "rate": f"{ln2} / {DAY}"},
        "HeavyKeeperParams": {"d": "4", "w": "greatest(2 * 10, ceil(1 / 0.001))", "k": "10", "seed": str(GOLDEN), "b": "1.08"},
        "DistinctParams": {"window": str(DAY), "p": "12", "ring": "8", "seed": str(GOLDEN), "registers": "pow(2, 12)", "standard_error": "1.04 / sqrt(pow(2, 12))"},
        "DriftParams": {"mode": "1", "delta": "5", "threshold": "500", "target": "50"},
        "QuantileParams": {"window": str(DAY), "alpha": "0.02", "panes": "32", "bins": "2048", "gamma": gamma, "least_indexable": f"exp(({low} - 1) * ln({gamma}))", "most_indexable": f"exp({high} * ln({gamma}))"},
        "CountMinParams": {"window": str(WEEK), "w": w, "d": d, "panes": "32", "seed": str(GOLDEN), "epsilon": f"exp(1) / {w}", "delta": f"exp(-{d})"},
        "ReservoirParams": {"k": "50", "half_life": str(WEEK), "seed": "7", "rate": f"{ln2} / {WEEK}"},
        "PaneWindow": {"window": str(DAY), "panes": "32"},
    }
    rows = ", ".join(f"('{o}', '{n}', CAST({x} AS DOUBLE))" for o, own in named.items() for n, x in own.items())
    return f"SELECT operator, name, round(CASE WHEN number = 0 OR abs(number) BETWEEN 1e-3 AND 1e15 THEN number ELSE ln(abs(number)) END, 6) AS number FROM (VALUES {rows}) AS v(operator, name, number)"


def drift(cusum: bool, latch: bool, delta: float = 5.0, threshold: float = 500.0, target: float = 50.0) -> str:
    """The detector as a recursion over each group's events."""
    ref = f"CAST({target} AS DOUBLE)" if cusum else "ref + (x - ref) / (n + 1)"
    if latch:
        other = "CASE WHEN side = 1 THEN dn ELSE up END"
        own = "CASE WHEN side = 1 THEN up ELSE dn END"
        verdict = f"CASE WHEN side = 0 THEN CASE WHEN greatest(up, dn) > {threshold} THEN CASE WHEN up >= dn THEN 1 ELSE -1 END ELSE 0 END WHEN {other} > {threshold} THEN -side ELSE 0 END"
        arm = f"(side <> 0 AND fired = 0 AND {own} < {threshold / 2})"
        new_side = f"CASE WHEN fired <> 0 THEN fired WHEN {arm} THEN 0 ELSE side END"
        gap = lambda g, s: f"CASE WHEN fired = {s} THEN {threshold} WHEN fired <> 0 THEN {g} WHEN {arm} THEN 0.0 WHEN side = {s} THEN least({g}, {threshold}) ELSE {g} END"
    else:
        verdict = f"CASE WHEN greatest(up, dn) > {threshold} THEN CASE WHEN up >= dn THEN 1 ELSE -1 END ELSE 0 END"
        new_side = "0"
        gap = lambda g, s: f"CASE WHEN fired <> 0 THEN 0.0 ELSE {g} END"
    return f"""WITH RECURSIVE {BY_TYPE}, o AS (SELECT grp, seq, value, row_number() OVER (PARTITION BY grp ORDER BY t, seq) AS i FROM e),
s(grp, i, seq, n, ref, up, dn, side, fired) AS (
  SELECT DISTINCT grp, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0, 0 FROM o
  UNION ALL
  SELECT grp, i, seq, CASE WHEN fired <> 0 THEN 0 ELSE n END, CASE WHEN fired <> 0 THEN 0.0 ELSE ref END, {gap("up", 1)}, {gap("dn", -1)}, {new_side}, fired FROM (
    SELECT *, {verdict} AS fired FROM (
      SELECT grp, i, seq, n, ref, side, greatest(0.0, up + (x - ref) - {delta}) AS up, greatest(0.0, dn - (x - ref) - {delta}) AS dn FROM (
        SELECT o.grp, o.i, o.seq, n + 1 AS n, {ref.replace("x -", "o.value -")} AS ref, o.value AS x, up, dn, side FROM s JOIN o ON o.grp = s.grp AND o.i = s.i + 1)))
)
SELECT grp, seq, i - 1 AS index, CAST(fired AS INTEGER) AS direction FROM s WHERE fired <> 0"""


LN2 = math.log(2)
RATE_DAY, RATE_WEEK = LN2 / DAY, LN2 / WEEK
DRAW = f"(CAST(concat('0x', substr(md5(concat('7:', grp, ':', seq)), 1, 12)) AS BIGINT) + 0.5) / {float(16**12)!r}"


def decayed(now: str) -> str:
    return f"""WITH {BY_USER}, timed AS (SELECT *, {now} AS now FROM e)
SELECT grp, round(sum(w), 6) AS count, round(sum(w * value), 6) AS sum, round(sum(m * value) / sum(m), 6) AS mean
FROM (SELECT grp, value, exp((t - now) * {RATE_DAY!r}) AS w, exp((t - max(t) OVER (PARTITION BY grp)) * {RATE_DAY!r}) AS m FROM timed) GROUP BY grp"""


ORACLES: dict[str, str] = {
    "sa_snapshot": snapshot(),
    "sa_subwindow": snapshot(DAY // 4),
    "sa_idle_advance": f"""{covered(BY_USER, 5 * DAY, 32, None, str(LATER))}, found AS (SELECT grp, {FIVE} FROM live GROUP BY grp)
SELECT grp, CAST({LATER} AS BIGINT) AS now, coalesce(count, 0) AS count, coalesce(sum, 0) AS sum, min, max, mean FROM (SELECT DISTINCT grp FROM e) LEFT JOIN found USING (grp)""",
    "sa_running": f"""WITH {BY_USER}, p AS (SELECT grp, {pane("t", DAY, 32)} AS pane, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1, 2)
SELECT grp, pane, CAST(sum(n) OVER f AS BIGINT) AS count, round(sum(s) OVER f, 6) AS sum, min(lo) OVER f AS min, max(hi) OVER f AS max, round(sum(s) OVER f / sum(n) OVER f, 6) AS mean
FROM p WINDOW f AS (PARTITION BY grp ORDER BY pane RANGE BETWEEN 32 PRECEDING AND CURRENT ROW)""",
    "sa_count_mode": f"{covered(COUNTED, 50, 8)} SELECT grp, now, {FIVE} FROM live GROUP BY grp, now",
    "eh_exact_count": f"WITH {BY_USER} SELECT grp, seq, count(*) OVER (PARTITION BY grp ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS count FROM e WHERE value > 0",
    "eh_exact_sum": f"WITH {BY_USER} SELECT grp, seq, round(sum(value) OVER (PARTITION BY grp ORDER BY t RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW), 6) AS sum FROM e WHERE value > 0",
    "eh_last_window": f"WITH {BY_USER}, timed AS (SELECT *, max(t) OVER (PARTITION BY grp) AS now FROM e WHERE value > 0) SELECT grp, count(*) AS count, round(sum(value), 6) AS sum FROM timed WHERE t > now - {WEEK} GROUP BY grp",
    "eh_last_n": f"WITH {BY_USER} SELECT grp, seq, count(*) OVER f AS count, round(sum(value) OVER f, 6) AS sum FROM e WHERE value > 0 WINDOW f AS (PARTITION BY grp ORDER BY t, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "fd_at_last": decayed("max(t) OVER (PARTITION BY grp)"),
    "fd_at_now": decayed(str(LATER)),
    "fd_rate": f"WITH {BY_USER}, timed AS (SELECT *, max(t) OVER (PARTITION BY grp) AS now FROM e) SELECT grp, round(sum(exp((t - now) * {RATE_DAY!r})) * {LN2!r}, 6) AS per_day FROM timed GROUP BY grp",
    "sdd_quantiles": bins(QuantileParams(DAY), BY_USER, None, QUANTILES),
    "sdd_subwindow": bins(QuantileParams(WEEK), BY_USER, DAY, [0.5, 0.95]),
    "sdd_collapsed": bins(QuantileParams(WEEK, 0.01, 32, False, 64), BY_TYPE, None, [0.1, 0.5, 0.9]),
    "sdd_count": bins(QuantileParams(DAY), BY_USER, None, None),
    "scm_total": f"{covered(BY_TYPE, WEEK, 32)} SELECT grp, CAST(sum(weight) AS BIGINT) AS total FROM live GROUP BY grp",
    "scm_exact": f"{covered(BY_TYPE, WEEK, 32)} SELECT grp, key, CAST(sum(weight) AS BIGINT) AS count FROM live GROUP BY grp, key",
    "scm_cells": f"{cells(CELLS)} SELECT grp, pane, row, col, n FROM cells",
    "scm_estimate_plain": f"{cells(CELLS)}, {asked(CELLS, 'SELECT * FROM (SELECT DISTINCT grp FROM e), (SELECT DISTINCT key FROM e)')} SELECT * FROM asked",
    "scm_conservative": f"{careful_cells(CAREFUL)}, {asked(CAREFUL, 'SELECT DISTINCT grp, key FROM e')}, totals AS (SELECT grp, CAST(sum(weight) AS BIGINT) AS total FROM timed WHERE pane >= {pane(f'now - {WEEK}', WEEK, 32)} GROUP BY grp) SELECT * FROM asked JOIN totals USING (grp)",
    "scm_status": f"{cells(CELLS)} SELECT grp, count(*) AS cells, max(n) >= {MASK} AS saturated FROM cells GROUP BY grp",
    "scm_idle_advance": known_groups(covered(BY_USER, IDLE, 32, None, str(LATER)) + "\nSELECT grp, sum(weight) AS total FROM live GROUP BY grp", "CAST(coalesce(total, 0) AS BIGINT) AS total"),
    "sdd_idle_advance": known_groups(bins(QuantileParams(IDLE), BY_USER, None, [0.5], str(LATER)), "CAST(0.5 AS DOUBLE) AS q, quantile, coalesce(count, 0) AS count"),
    "eh_idle_advance": known_groups(f"WITH {BY_USER}\nSELECT grp, count(*) AS n, round(sum(value), 6) AS s FROM e WHERE value > 0 AND t > {LATER - IDLE} GROUP BY grp", "coalesce(n, 0) AS count, coalesce(s, 0) AS sum"),
    "shll_idle_advance": known_groups(f"{registers(DistinctParams(IDLE), BY_USER, None, str(LATER))}, {estimated(DistinctParams(IDLE))}\nSELECT * FROM estimates", "coalesce(estimate, 0) AS estimate"),
    "eh_approx": buckets(BUCKETS),
    "eh_approx_advance": buckets(BUCKETS, LATER + WEEK // 2),
    "fd_running": f"""WITH {BY_TYPE}, w AS (SELECT a.grp, a.seq, exp((b.t - a.t) * {RATE_DAY!r}) AS w, b.value FROM e a JOIN e b ON a.grp = b.grp AND (b.t, b.seq) <= (a.t, a.seq))
SELECT grp, seq, round(sum(w), 6) AS count, round(sum(w * value), 6) AS sum, round(sum(w * value) / sum(w), 6) AS mean FROM w GROUP BY grp, seq""",
    "hk_topk": f"{heavy(HEAVY)}, tops AS (SELECT grp, unnest(s.top) AS y FROM kept) SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY y.n DESC, y.k) AS INTEGER) AS rank, y.k AS key, y.n AS count FROM tops",
    "hk_estimate": f"{heavy(WIDE)} SELECT grp, key, coalesce(list_max(list_transform(list_filter(path, lambda i: s.cnt[i] > 0 AND s.mk[i] = h1), lambda i: s.cnt[i])), 0) AS estimate FROM paths JOIN kept USING (grp) JOIN hashed USING (key)",
    "dd_state": drift_state(False, False),
    "dd_state_cusum": drift_state(True, False),
    "dd_state_latch": drift_state(False, True),
    "dd_state_cusum_latch": drift_state(True, True),
    "adwin_state": f"{adaptive(0.002, 'value')}, sums AS (SELECT grp, s.c AS c, len(s.b) AS k, list_sum(list_transform(s.b, lambda y: y.n)) AS n, list_sum(list_transform(s.b, lambda y: y.s)) AS m, list_sum(list_transform(s.b, lambda y: y.q)) AS q FROM folded) SELECT grp, CAST(n AS BIGINT) AS width, round(c + m / n, 6) AS mean, round(greatest(q / n - (m / n) * (m / n), 0), 4) AS variance, CAST(k AS INTEGER) AS buckets FROM sums",
    "adwin_drift": f"{adaptive(0.05, f'value + CASE WHEN t >= {MIDDLE} THEN 100.0 ELSE 0.0 END')}, cuts AS (SELECT grp, unnest(s.out) AS y FROM folded) SELECT grp, y.seq AS seq, y.width AS width, round(y.mean, 6) AS mean FROM cuts",
    "parameters": implied(),
    "shll_registers": registers(SETS) + " SELECT grp, register, rank FROM regs",
    "shll_count": f"{registers(SETS)}, {estimated(SETS)} SELECT * FROM estimates",
    "shll_subwindow": f"{registers(DistinctParams(WEEK), BY_TYPE, DAY // 2)}, {estimated(DistinctParams(WEEK))} SELECT * FROM estimates",
    "shll_ring": ring(RINGS),
    "distinct_exact": f"WITH {BY_TYPE}, timed AS (SELECT *, max(t) OVER (PARTITION BY grp) AS now FROM e) SELECT grp, count(DISTINCT key) AS distinct FROM timed WHERE t > now - {DAY} GROUP BY grp".replace("AS distinct", 'AS "distinct"'),
    "topk_exact": f"""WITH {BY_TYPE}, k AS (SELECT grp, key, CAST(sum(weight) AS BIGINT) AS count FROM e GROUP BY grp, key),
r AS (SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY count DESC, key) AS INTEGER) AS rank, key, count FROM k) SELECT * FROM r WHERE rank <= 10""",
    "topk_decayed": f"""WITH {BY_TYPE}, k AS (SELECT grp, key, sum(weight * exp((t - {LATER}) * {RATE_WEEK!r})) AS score FROM e GROUP BY grp, key),
r AS (SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, key) AS INTEGER) AS rank, key, round(score, 6) AS score FROM k) SELECT * FROM r WHERE rank <= 10""",
    "dr_sample": f"""WITH {BY_TYPE}, r AS (SELECT grp, seq, value, CAST(row_number() OVER (PARTITION BY grp ORDER BY ln(-ln({DRAW})) - t * {RATE_WEEK!r}, seq) AS INTEGER) AS rank FROM e)
SELECT grp, rank, seq, value FROM r WHERE rank <= 50""",
    "dd_ph": drift(False, False),
    "dd_cusum": drift(True, False),
    "dd_ph_latch": drift(False, True),
    "dd_cusum_latch": drift(True, True),
    "stream_dd": drift(False, False),
    "stream_sa": f"""WITH {BY_TYPE}, w AS (SELECT grp, t // 3600000000 * 3600000000 AS start, value FROM e), last AS (SELECT max(t) // 1000 * 1000 - {DAY} AS mark FROM e)
SELECT grp, start, count(*) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max FROM w, last GROUP BY grp, start, mark HAVING start + 3600000000 <= mark""",
}
#: A stream that has seen all events has the rows of the batch.
ORACLES |= {"stream_dd_cusum": ORACLES["dd_cusum"], "stream_fd": ORACLES["fd_running"], "stream_adwin": ORACLES["adwin_state"], "stream_eh": ORACLES["eh_approx"], "stream_hk": ORACLES["hk_topk"], "stream_shll": ORACLES["shll_ring"]}
