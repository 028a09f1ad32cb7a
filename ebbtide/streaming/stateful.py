"""The state machines over streams: one state a group, kept by Structured Streaming between micro-batches.

A micro-batch's events are put in the order (t, seq).  An event before its group's last one is late: ``late="drop"`` leaves
it out and counts it, ``late="raise"`` fails the query.  With ``idle`` a group without events gets its clock moved to the
watermark when that passes its last event by as much, and its summary is emitted again.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Refused
from ..sources.shared import deleted_at_end, shared_dir


def fold_stream(stream: DataFrame, make: Callable[[], object], step: Callable[[object, object], Iterable[tuple]], schema: str, *, late: str = "drop", idle: int | None = None, read: Callable[[object], Iterable[tuple]] | None = None, columns: tuple[str, ...] = ("t", "seq", "value")) -> DataFrame:
    """grp, the rows of ``step(state, event)``, and late (events left out so far).

    ``idle`` is in microseconds and needs a watermark and ``read``; a state with ``advance`` has it called.
    """
    return _stateful(stream, make, step, None, read, schema, late, idle, columns)


def _stateful(stream, make, step, add, read, schema, late, idle, columns) -> DataFrame:
    if late not in ("drop", "raise"):
        raise ValueError("late must be drop or raise")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kind = stream.schema["grp"].dataType.simpleString()

    def table(key, out: list, left: int) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=names)
        found.insert(0, "grp", key[0])
        found["late"] = left
        return found

    def run(key, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        machine, left, last, seen = pickle.loads(group.get[0]) if group.exists else (make(), 0, None, 0)
        if group.hasTimedOut:
            moved = group.getCurrentWatermarkMs() * 1000
            if last is None or moved > last:
                if hasattr(machine, "advance"):
                    machine.advance(moved)
                last = moved
            group.update((pickle.dumps((machine, left, last, seen)),))
            yield table(key, list(read(machine)), left)
            return
        out: list[tuple] = []
        for event in pd.concat(list(batches)).sort_values(["t", "seq"]).itertuples(index=False):
            if last is not None and event.t < last:
                if late == "raise":
                    raise Refused(f"event {event.seq} of group {key[0]} is late")
                left += 1
                continue
            last = event.t
            if add:
                add(machine, event)
            else:
                out += step(machine, event)
        if add:
            out = [(seen + 1, *row) for row in read(machine)]
        group.update((pickle.dumps((machine, left, last, seen + 1)),))
        if idle is not None:
            group.setTimeoutTimestamp(max(last + idle, group.getCurrentWatermarkMs() * 1000 + 1) // 1000 + 1)
        yield table(key, out, left)

    timeout = GroupStateTimeout.EventTimeTimeout if idle is not None else GroupStateTimeout.NoTimeout
    kept = stream.select("grp", *columns, *(["ts"] if idle is not None else []))
    return kept.groupBy("grp").applyInPandasWithState(run, f"grp {kind}, {schema}, late long", "state binary", "append", timeout)


def summary_stream(stream: DataFrame, make: Callable[[], object], add: Callable[[object, object], None], read: Callable[[object], Iterable[tuple]], schema: str, *, late: str = "drop", columns: tuple[str, ...] = ("t", "seq", "value")) -> DataFrame:
    """grp, step, the rows of ``read(state)`` after each micro-batch with events of the group, and late.

    ``step`` counts the group's micro-batches from 1: a group's last step is its present state, see ``latest``.  A micro-batch
    of late events only has a step too.
    """
    return _stateful(stream, make, None, add, read, f"step long, {schema}", late, None, columns)


def latest(found: DataFrame) -> DataFrame:
    """Of what ``summary_stream`` has written, the rows of each group's last step, without step and late."""
    last = found.groupBy(F.col("grp").alias("of")).agg(F.max("step").alias("last"))
    return found.join(last, F.col("grp").eqNullSafe(F.col("of")) & (F.col("step") == F.col("last"))).drop("of", "last", "step", "late")


def tumbling_five(stream: DataFrame, pane_seconds: int) -> DataFrame:
    """Pane rows of the exact aggregates as a stream: by, pane start, count, sum, min, max, once the watermark has passed."""
    window = F.window("ts", f"{pane_seconds} seconds")
    return stream.groupBy("grp", window).agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max")).select("grp", F.unix_micros("window.start").alias("start"), "count", "sum", "min", "max")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/ebbtide-stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    deleted_at_end(spark, path)
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
