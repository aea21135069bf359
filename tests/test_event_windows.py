from __future__ import annotations

import random

import pytest

from stridewell.streaming.event_windows import windows_so_far

SCHEMA = "rec string, ts timestamp, pos long, value double"


def plain(rows, win, step, until):
    """The windows of a batch over the same samples."""
    out = []
    for rec in {r[0] for r in rows if r[0] is not None}:
        places = {}
        for r, ts, pos, value in rows:
            if r == rec and ts is not None and ts <= until:
                old = places.get((ts, pos or 0), False)
                places[ts, pos or 0] = value if old in (None, False) else old if value is None else min(old, value)
        values = [places[p] for p in sorted(places)]
        out += [(rec, k, values[k * step : k * step + win]) for k in range(max(0, (len(values) - win) // step + 1))]
    return sorted(out, key=str)


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "rec string, ts long, pos long, value double").withColumn("ts", F.timestamp_seconds("ts"))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("win,step", [(6, 3), (3, 5), (1, 1)])
def test_shuffled_repeated_and_restarted_gives_the_batch(spark, tmp_path, win, step):
    rng = random.Random(win)
    rows = [(r, 1000 + t, t % 7, float(t)) for r in "abc" for t in range(40 if r != "c" else 4)]
    rows += [("a", 1000 + t, t % 7, float(t) - 0.5) for t in range(0, 40, 9)] + rows[:5]  # repeats, some of less value
    rows += [("a", 1010, None, 7.5), ("b", None, 1, 1.0), (None, 1010, 1, 1.0), ("b", 1011, 99, None)]
    # within 30 s of their order
    rows.sort(key=lambda r: (r[1] or 1000) + rng.random() * 25)
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [rows[i : i + 20] for i in range(0, len(rows), 20)] + [[("z", 2000, 0, 0.0)]]
    for k, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
        if k in (1, 3, len(parts) - 1):  # stopped and started again in between
            out = windows_so_far(stream(spark, src), folder, win, step, "30 seconds")
    got = sorted(((r.rec, r.widx, r.x) for r in out.collect()), key=str)
    assert got == plain(rows, win, step, 1970) and any(len(r[2]) == win for r in got)


def test_what_is_late_is_dropped_and_what_waits_is_kept(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 100 + t, t, float(t)) for t in range(5)], [("a", 300, 0, 300.0)], [("a", 101, 9, -1.0), ("a", 299, 0, 299.0)], [("a", 500, 0, 500.0)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
        out = windows_so_far(stream(spark, src), folder, 2, 2, "10 seconds")
    # 101 came when the watermark stood at 290; 500 still waits
    assert sorted((r.widx, r.x) for r in out.collect()) == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 299.0])]


def test_numbers_go_on_after_a_long_pause(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 1 + t, 0, float(t)) for t in range(4)], [("a", 10**7 + t, 0, float(t)) for t in range(4)], [("z", 2 * 10**7, 0, 0.0)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
        out = windows_so_far(stream(spark, src), folder, 4, 2, "10 seconds")
    assert sorted((r.widx, r.x) for r in out.collect()) == [(0, [0, 1, 2, 3]), (1, [2, 3, 0, 1]), (2, [0, 1, 2, 3])]


def test_samples_that_come_together_are_one_row_of_state():
    """A recording's calls and rows of state must not grow with its samples."""
    from types import SimpleNamespace

    import pandas as pd

    from stridewell.streaming.event_windows import _Windows

    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def appendValue(self, row):
            calls.append(row)
            self.rows.append(row)

        def appendList(self, rows):
            calls.extend(rows)
            self.rows += rows

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            calls.extend(rows)
            self.rows = rows

        def clear(self):
            self.rows = []

    class Value:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    handle = SimpleNamespace(getListState=lambda *a: State(), getValueState=lambda *a: Value(), registerTimer=lambda ms: None)
    windows, out = _Windows(4, 2), []
    windows.init(handle)
    for k in range(2):  # the second time, later samples of the first become ready
        values = [float(v) if v % 5 else None for v in range(100 * k, 100 * k + 100)]
        rows = pd.DataFrame({"us": [v * 1000 for v in range(100 * k, 100 * k + 100)], "pos": 0, "value": values})
        windows.handleInputRows(("a",), iter([rows.sample(frac=1, random_state=k)]), None)
        passed = SimpleNamespace(getCurrentWatermarkInMs=lambda k=k: 100 * k + 49)
        for frame in windows.handleExpiredTimer(("a",), passed, None):
            out += frame.values.tolist()
    plain_values = [float(v) if v % 5 else None for v in range(150)]
    assert [(w, list(x)) for _, w, x in out] == [(i, plain_values[2 * i : 2 * i + 4]) for i in range(74)]
    assert len(calls) == 4
