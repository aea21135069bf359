"""Count windows over a stream: the last samples of each recording are state, complete windows go out.

Time windows are no substitute: they follow the clock and keep partial windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "rec string, widx long, x array<double>"


def count_windows(stream: DataFrame, win: int = 50, step: int = 25) -> DataFrame:
    """(rec, widx, x) from a stream of (rec string, pos long, value double).

    Samples of a recording in one micro-batch are put in the order of ``pos``; later batches must
    hold later positions.  State is fewer than ``win + step`` values for each recording, and goes
    after an hour without samples.
    """

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, widx, skip = state.get if state.exists else ([], 0, 0)
        new = pd.concat(list(batches)).sort_values("pos")["value"].tolist()
        values, out = [*held, *new[skip:]], []
        skip = max(0, skip - len(new))
        while len(values) >= win:
            out.append((key[0], widx, values[:win]))
            widx += 1
            skip += max(0, step - len(values))
            values = values[step:]
        state.update((values, widx, skip))
        state.setTimeoutDuration(3_600_000)
        if out:
            yield pd.DataFrame(out, columns=["rec", "widx", "x"])

    return stream.select("rec", "pos", "value").groupBy("rec").applyInPandasWithState(update, OUT, "held array<double>, widx long, skip long", "append", GroupStateTimeout.ProcessingTimeTimeout)
