"""Running a state machine over each group of a DataFrame, in an explicit order.

The order is (t, seq): arrival order means nothing to Spark.  Rows are dealt by group and sorted by Spark, which spills, and
then stream through the machines batch by batch: a task holds one state and one batch, however large a group is.  A group is
folded by one task, as its order demands; groups run in parallel.  Where a summary has a form without order (panes, windows,
decay, quantiles, frequency, distinct), use it.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 10_000  # rows handed on together
_NEW = object()


def _folded(df: DataFrame, make: Callable[[], object], step: Callable | None, add: Callable | None, read: Callable | None, schema: str, columns: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given isn't merged: a fold costs more than its bytes tell
    arranged = df.select(*by, *columns).repartition(width, *by).sortWithinPartitions(*by, "t", "seq")
    kinds = {f.name: f.dataType.simpleString() for f in arranged.schema}
    whole = ", ".join([*(f"{c} {kinds[c]}" for c in by), schema])
    event_of = namedtuple("event_of", columns)._make
    n = len(by)
    target = df.sparkSession.createDataFrame([], whole)
    arrow = target.toArrow().schema

    def run(batches):
        key, state, out = _NEW, None, []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * len(arrow), arrow, strict=True)], schema=arrow)

        for batch in batches:
            values = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for own, event in zip(zip(*values[:n]), map(event_of, zip(*values[n:])), strict=True):
                if own != key:
                    if key is not _NEW and read:
                        out += [(*key, *row) for row in read(state)]
                    key, state = own, make()
                if add:
                    add(state, event)
                else:
                    out += [(*own, *row) for row in step(state, event)]
                if len(out) >= BATCH:
                    yield table()
                    out = []
        if key is not _NEW and read:
            out += [(*key, *row) for row in read(state)]
        if out:
            yield table()

    return arranged.mapInArrow(run, whole)


def fold_events(df: DataFrame, make: Callable[[], object], step: Callable[[object, object], Iterable[tuple]], schema: str, columns: tuple[str, ...] = ("t", "seq", "value"), by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """``by`` and the rows that ``step(state, event)`` gives for each event; ``schema`` names what comes after ``by``."""
    return _folded(df, make, step, None, None, schema, columns, by)


def fold_groups(df: DataFrame, make: Callable[[], object], add: Callable[[object, object], None], read: Callable[[object], Iterable[tuple]], schema: str, columns: tuple[str, ...] = ("t", "seq", "value"), by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """``by`` and the rows that ``read(state)`` gives once all of a group's events are in."""
    return _folded(df, make, None, add, read, schema, columns, by)
