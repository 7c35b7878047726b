"""Gap segmentation of a stream of cues, with the batch operator's rule: a step of the gap or more opens a new segment.

Native session windows put events exactly one gap apart into one session, so the state is kept by hand: the last time
and the segment's number by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "doc_id string, pos long, t double, seg long"


def stream_segments(cues: DataFrame, gap: float, idle_ms: int | None = None) -> DataFrame:
    """cues(doc_id string, pos long, t double), arriving in the order of pos: each with its segment, as it arrives.

    With idle_ms a document without cues for so much processing time is forgotten, so that the state is bounded by the documents at
    work. Such a query goes on looking for what has run out, so a trigger that ends (availableNow) needs None.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seg = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("pos")
        out = []
        for pos, t in rows[["pos", "t"]].itertuples(index=False):
            if last is not None and t - last >= gap:
                seg += 1
            last = t
            out.append((key[0], int(pos), float(t), seg))
        state.update((float(last), seg))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["doc_id", "pos", "t", "seg"])

    return cues.groupBy("doc_id").applyInPandasWithState(step, OUT, "last double, seg long", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
