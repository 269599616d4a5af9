"""Pointer jumping on chains: where does each pointer end, and which pointers cycle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kmerloom.plans.runtime import cut, drop

_NAMES = ["id", "root", "hops", "low", "done"]


def _shortened(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Follow pointers as far as they stay among the rows of one partition.

    Where the partition holds all ``rows`` there are, what leads out of it has come to its end.
    """
    parts = list(batches)
    t = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=_NAMES)
    if t.empty:
        return
    t = t.sort_values("id", ignore_index=True)
    ids, root, hops, low, done = (t[c].to_numpy().copy() for c in _NAMES)
    at = np.minimum(np.searchsorted(ids, root), len(ids) - 1)
    live = (ids[at] == root) & ~done
    # a pointer to a row that leads out of the partition takes over its target and waits there
    for _ in range(int(len(ids)).bit_length()):
        if not live.any():
            break
        j = at[live]
        hops[live] += hops[j]
        low[live] = np.minimum(low[live], low[j])
        done[live] |= done[j]
        root[live], at[live], live[live] = root[j].copy(), at[j].copy(), live[j].copy()
    settled = len(ids) == rows
    yield pd.DataFrame({"id": ids, "root": root, "hops": hops, "low": low, "done": ~live if settled else done, "settled": settled})


def resolve(pointers: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Follow (id, nxt, low), all LONG and id unique, until nxt is no id any more; ``rows`` is their number.

    Returns rows (id, root, hops, low, cyclic): the final target, the number of steps, the
    least ``low`` on the way, and whether the pointer runs in a cycle (then ``low`` is
    the least of its cycle); and the number of cycling pointers. Every round first follows
    pointers inside each partition and then jumps once across partitions.
    """
    schema = "id long, root long, hops long, low long, done boolean, settled boolean"
    state = pointers.select("id", F.col("nxt").alias("root"), F.lit(1).cast("long").alias("hops"), "low", F.lit(False).alias("done"))
    state = state.repartition("id").mapInPandas(lambda it: _shortened(it, rows), schema)
    seen = Observation()
    counts = [F.count_if("settled").alias("settled"), F.count_if(~F.col("done")).alias("live")]
    held = cut(state.observe(seen, *counts))
    state = held.drop("settled")
    state._kmerloom_path = held._kmerloom_path
    if seen.get["settled"] == rows:
        return _told(state), seen.get["live"]
    while True:
        ahead = state.select(
            F.col("id").alias("root"), F.col("root").alias("r2"), F.col("hops").alias("h2"),
            F.col("low").alias("l2"), F.col("done").alias("d2"),
        )
        # finished pointers are dead ends and must not be looked up again
        j = state.where(~F.col("done")).join(ahead, "root", "left")
        hit = F.col("r2").isNotNull()
        moved = j.select(
            "id",
            F.coalesce("r2", "root").alias("root"),
            (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
            F.when(hit, F.least("low", "l2")).otherwise(F.col("low")).alias("low"),
            (~hit | F.coalesce("d2", F.lit(False))).alias("done"),
            F.coalesce(F.col("low") != F.col("l2"), F.lit(False)).alias("unstable"),
        )
        seen = Observation()
        moved = moved.observe(
            seen,
            F.count_if(F.col("done")).alias("finished"),
            F.count_if(~F.col("done")).alias("live"),
            F.count_if(~F.col("done") & F.col("unstable")).alias("unstable"),
        )
        old, state = state, cut(moved.drop("unstable").unionByName(state.where("done")))
        drop(old)
        got = seen.get
        # every round finishes some pointer unless only cycles are left
        if got["live"] == 0 or (got["finished"] == 0 and got["unstable"] == 0):
            return _told(state), got["live"]


def _told(state: DataFrame) -> DataFrame:
    out = state.select("id", "root", "hops", "low", (~F.col("done")).alias("cyclic"))
    out._kmerloom_path = state._kmerloom_path
    return out
