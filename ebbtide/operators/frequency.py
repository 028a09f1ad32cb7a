"""Frequencies of keys over the last window: Count-Min cells on a pane grid, as rows.

Without conservative update a cell is a sum, so cells are aggregated before the shuffle and only cells that hold something
exist.  An estimate sums a row's cell over the live panes, then takes the least row: never under the true count.

With conservative update a cell depends on the order of a pane's events, and on nothing outside the pane: panes are folded
apart, in streams, and everything after the cells is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import GOLDEN, MASK, SECOND, finalized, lane
from ..functions.timegrid import pane
from ..params import CountMinParams, PaneWindow
from .batch import fold_groups
from .clock import clocks, every_group
from .folds import ConservativeCountMin
from .panes import live, pane_partials


def with_cells(df: DataFrame, params: CountMinParams) -> DataFrame:
    """Each row once for each of the d rows of cells: adds row and col."""
    base = lane(F.col("key"), params.seed).bitwiseXOR(lane(F.col("key"), params.seed ^ SECOND))
    spread = df.withColumn("base", base).withColumn("row", F.explode(F.array(*[F.lit(i) for i in range(params.d)])))
    step = (F.col("row").cast("long") * GOLDEN).bitwiseAND(F.lit(MASK))
    return spread.withColumn("col", finalized(F.col("base").bitwiseXOR(step)).bitwiseAND(F.lit(params.w - 1)).cast("int")).drop("base")


def cells(df: DataFrame, params: CountMinParams) -> DataFrame:
    """grp, pane, row, col, n, last_t, saturated.  Weights of one key in a pane are summed before they are spread over the rows."""
    grid = PaneWindow(params.window, params.panes)
    by_key = pane_partials(df, grid, F.sum("weight").alias("n"), keys=("key",))
    return with_cells(by_key, params).groupBy("grp", "pane", "row", "col").agg(F.least(F.sum("n"), F.lit(MASK)).alias("n"), F.max("last_t").alias("last_t"), (F.sum("n") > MASK).alias("saturated"))


def conservative_cells(df: DataFrame, params: CountMinParams) -> DataFrame:
    """The same columns, an event raising its cells no further than its own estimate needs."""
    paned = df.withColumn("pane", pane(F.col("t"), params.window, params.panes))

    def read(state):
        (own,) = state.cells.values()
        return [(row, col, n, int(state.now), state.saturated) for row, held in enumerate(own) for col, n in held.items()]

    return fold_groups(paned, lambda: ConservativeCountMin(params), lambda s, e: s.add(e.t, e.key, e.weight), read, "row int, col int, n long, last_t long, saturated boolean", ("t", "seq", "key", "weight"), by=("grp", "pane"))


def estimates(df: DataFrame, keys: DataFrame, params: CountMinParams, at: int | None = None, sub: int | None = None) -> DataFrame:
    """grp, key, estimate of what ``keys`` asks: of its pairs (grp, key), or of its keys in every group.

    A key never seen may still share cells with others; an estimate of 0 is a row like others.  ``params`` tells whether cells
    are plain or conservative.
    """
    grid = PaneWindow(params.window, params.panes)
    held = conservative_cells(df, params) if params.conservative else cells(df, params)
    alive = live(held, grid, at, sub).groupBy("grp", "row", "col").agg(F.sum("n").alias("n"))
    asked = keys.select("grp", "key") if "grp" in keys.columns else df.select("grp").distinct().crossJoin(keys.select("key"))  # as many rows as are returned
    spread = with_cells(asked.distinct(), params)
    to = alive.select(F.col("grp").alias("of"), F.col("row").alias("in_row"), F.col("col").alias("in_col"), "n")
    joined = spread.join(to, F.col("grp").eqNullSafe(F.col("of")) & (F.col("row") == F.col("in_row")) & (F.col("col") == F.col("in_col")), "left")
    return joined.groupBy("grp", "key").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def totals(df: DataFrame, params: CountMinParams, at: int | None = None, sub: int | None = None) -> DataFrame:
    """grp, total: the exact weight over the covered span; 0 for a group that has left it."""
    grid = PaneWindow(params.window, params.panes)
    partials = pane_partials(df, grid, F.sum("weight").alias("n"))
    found = live(partials, grid, at, sub).groupBy("grp").agg(F.sum("n").alias("total"))
    return found if at is None else every_group(clocks(partials, at, "last_t"), found, {"total": F.lit(0)})


def status(df: DataFrame, params: CountMinParams) -> DataFrame:
    """grp, cells (that hold something, in all panes), saturated (whether one has met its limit)."""
    held = conservative_cells(df, params) if params.conservative else cells(df, params)
    return held.groupBy("grp").agg(F.count(F.lit(1)).alias("cells"), F.max("saturated").alias("saturated"))


def exact(df: DataFrame, params: CountMinParams) -> DataFrame:
    """grp, key, count over the covered span, without a sketch."""
    grid = PaneWindow(params.window, params.panes)
    per_pane = pane_partials(df, grid, F.sum("weight").alias("n"), keys=("key",))
    return live(per_pane, grid).groupBy("grp", "key").agg(F.sum("n").alias("count"))
