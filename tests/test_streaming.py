import shutil
from pathlib import Path

import pytest

from ebbtide.operators.batch import fold_events
from ebbtide.operators.folds import DecayedSums, SlidingFive
from ebbtide.params import DecayParams
from ebbtide.streaming.stateful import fold_stream, latest, run_once, summary_stream

SCHEMA = "grp string, t long, seq long, value double, ts timestamp"


def step(state, event):
    state.add(event.t, event.value)
    return [(event.seq, state.read()[0])]


def stream_of(spark, folder, batches):
    """A stream that takes the batches one by one."""
    for i, rows in enumerate(batches):
        table = spark.createDataFrame([(g, t, s, v) for g, t, s, v in rows], "grp string, t long, seq long, value double")
        table.selectExpr("*", "timestamp_micros(t) AS ts").coalesce(1).write.parquet(f"{folder}/w{i}")
        part = next(Path(f"{folder}/w{i}").glob("part-*"))
        Path(f"{folder}/in").mkdir(exist_ok=True)
        shutil.move(part, f"{folder}/in/b{i}.parquet")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("ts", "0 seconds")


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [("ab"[i % 2], i * 10, i, float(i)) for i in range(60)]
    stream = stream_of(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]])
    got = run_once(fold_stream(stream, lambda: DecayedSums(DecayParams(50.0)), step, "seq long, count double"))
    table = spark.createDataFrame(rows, "grp string, t long, seq long, value double")
    want = fold_events(table, lambda: DecayedSums(DecayParams(50.0)), step, "seq long, count double")
    key = lambda found: sorted((r.grp, r.seq, r["count"]) for r in found.collect())
    assert key(got) == key(want)


def test_a_summary_after_several_micro_batches_is_that_of_all_events(spark, tmp_path):
    rows = [("ab"[i % 2], i * 10, i, float(i)) for i in range(60)] + [(None, 5, 100, 1.0)]
    stream = stream_of(spark, tmp_path, [[*rows[:20], rows[60]], rows[20:45], [r for r in rows[45:60] if r[0] == "a"]])
    found = summary_stream(stream, lambda: DecayedSums(DecayParams(50.0)), lambda s, e: s.add(e.t, e.value), lambda s: [s.read()[:2]], "count double, sum double")
    written = run_once(found)
    assert sorted((r.grp or "", r.step) for r in written.collect()) == [("", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    want = {}
    for g, t, _, v in rows[:45] + [r for r in rows[45:60] if r[0] == "a"] + rows[60:]:
        want.setdefault(g, DecayedSums(DecayParams(50.0))).add(t, v)
    got = latest(written)
    assert got.columns == ["grp", "count", "sum"]
    assert {r.grp: (r["count"], r["sum"]) for r in got.collect()} == {g: s.read()[:2] for g, s in want.items()}


def test_late_events_are_counted_or_fail(spark, tmp_path):
    batches = [[("a", 1000, 1, 1.0)], [("a", 500, 2, 1.0), ("a", 2000, 3, 1.0)]]
    (tmp_path / "x").mkdir()
    stream = stream_of(spark, tmp_path / "x", batches)
    got = run_once(fold_stream(stream, lambda: DecayedSums(DecayParams(50.0)), step, "seq long, count double"))
    assert sorted((r.seq, r.late) for r in got.collect()) == [(1, 0), (3, 1)]
    (tmp_path / "y").mkdir()
    stream = stream_of(spark, tmp_path / "y", batches)
    with pytest.raises(Exception, match="late"):
        run_once(fold_stream(stream, lambda: DecayedSums(DecayParams(50.0)), step, "seq long, count double", late="raise"))


def test_an_idle_group_slides_with_the_watermark(spark, tmp_path):
    second = 1_000_000
    batches = [[("a", 1 * second, 1, 5.0), ("b", 1 * second, 2, 7.0)], [("b", 500 * second, 3, 1.0)], [("b", 600 * second, 4, 1.0)], [("b", 700 * second, 5, 1.0)]]

    def read(state):
        return [(-1, float(state.read()[0]))]

    def add(state, event):
        state.add(event.t, event.value)
        return [(event.seq, float(state.read()[0]))]

    stream = stream_of(spark, tmp_path, batches)
    got = run_once(fold_stream(stream, lambda: SlidingFive(100 * second, 10), add, "seq long, count double", idle=50 * second, read=read))
    assert (-1, 0.0) in [(r.seq, r["count"]) for r in got.collect() if r.grp == "a"]
