"""Motion-driven frame sampling of unbounded clips: the state of a clip is three numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sample_stream(frames: DataFrame, key: str = "vehicle_id", threshold: float = 12.0, most: int = 60, gap: int = 2) -> DataFrame:
    """frames(key, ts, observation_id, motion) to (key, observation_id, motion) of the frames kept.

    Same rule as the batch operator. Rows of a micro-batch are put in order of (ts, observation_id); a row that
    comes in a later batch counts as later, whatever its time. No watermark is needed: state per clip never grows.
    """

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        acc, since, n = state.get if state.exists else (0.0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "observation_id"])
        ids, motions = [], []
        for i, m in zip(rows["observation_id"], rows["motion"], strict=True):
            if not n:
                ids.append(i)
                motions.append(0.0)
                n = 1
                continue
            acc, since = acc + float(m), since + 1
            if acc >= threshold and since >= gap:
                if n < max(most, 2):
                    ids.append(i)
                    motions.append(acc)
                    n += 1
                acc, since = 0.0, 0
        state.update((acc, since, n))
        yield pd.DataFrame({key: [k[0]] * len(ids), "observation_id": ids, "motion": motions})

    kind = dict(frames.dtypes)
    return frames.groupBy(key).applyInPandasWithState(
        step,
        outputStructType=f"{key} {kind[key]}, observation_id {kind['observation_id']}, motion double",
        stateStructType="acc double, since int, n int",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )
