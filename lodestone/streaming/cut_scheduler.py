"""Stateful level-of-detail cuts: a view's cut is carried from frame to frame within a node budget.

Frames of a view are rows of a stream; the state of a view is its present cut.
The same update runs on a batch (``schedule``) and on a stream
(``schedule_stream``, with ``applyInPandasWithState``).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIONS = "view_id long, frame long, node_id long, action string"


def update_cut(cut: set[int], error: dict[int, float], fan: int, threshold: float, budget: int, hysteresis: float = 0.1) -> list[tuple[int, str]]:
    """One frame: collapses first, then the splits of largest error while the budget holds. The cut is changed in place.

    A parent is collapsed to when its children are all in the cut and its own error is below the threshold less the
    hysteresis; if the budget is exceeded, the least erroneous such parents collapse too.
    """
    done: list[tuple[int, str]] = []

    def siblings(parent: int) -> list[int]:
        return [parent * fan + 1 + k for k in range(fan)]

    def collapse(parent: int) -> None:
        cut.difference_update(siblings(parent))
        cut.add(parent)
        done.append((parent, "collapse"))

    def parents() -> list[int]:
        return sorted({(n - 1) // fan for n in cut if n > 0 and all(s in cut for s in siblings((n - 1) // fan))})

    for p in parents():
        if error.get(p, 0.0) < threshold - hysteresis:
            collapse(p)
    while len(cut) > budget and (ready := parents()):
        collapse(min(ready, key=lambda p: (error.get(p, 0.0), p)))
    for n in sorted(cut, key=lambda n: (-error.get(n, 0.0), n)):
        kids = siblings(n)
        if error.get(n, 0.0) <= threshold + hysteresis or len(cut) + fan - 1 > budget:
            continue
        if all(k in error for k in kids):
            cut.remove(n)
            cut.update(kids)
            done.append((n, "split"))
    return done


def _frames(pdf: pd.DataFrame, cut: set[int], fan: int, threshold: float, budget: int) -> list[tuple]:
    out = []
    for frame, rows in pdf.sort_values("frame", kind="stable").groupby("frame"):
        error = dict(zip(rows["node_id"].astype(int), rows["error"], strict=True))
        out += [(int(frame), n, a) for n, a in update_cut(cut, error, fan, threshold, budget)]
    return out


def looked_up(cut: set[int], fan: int) -> set[int]:
    """All nodes whose error one frame can ask for: the cut and what it can collapse to, with their children."""
    own = set(cut)
    for n in cut:
        while n > 0 and (n := (n - 1) // fan) not in own:
            own.add(n)
    return own | {n * fan + 1 + k for n in own for k in range(fan)}


def within_reach(errors: DataFrame, fan: int) -> DataFrame:
    """Rows that a view starting at the root can ask for: its k-th frame reaches depth k at most. Node -1 stands for each frame, so that none is lost."""
    frames = errors.select("view_id", "frame").where(F.col("frame").isNotNull()).distinct()
    k = F.row_number().over(Window.partitionBy("view_id").orderBy("frame"))
    end = (F.pow(F.lit(float(fan)), k + 1) - 1) / (fan - 1) if fan > 1 else k + 1.0  # the first node of depth k + 1
    ends = frames.select(F.col("view_id").alias("_view"), F.col("frame").alias("_frame"), end.alias("_end"))
    near = F.col("view_id").eqNullSafe(F.col("_view")) & (F.col("frame") == F.col("_frame"))
    rows = errors.join(ends, near & ((F.col("node_id") < F.col("_end")) | (F.col("_end") > 2.0**52))).select(*errors.columns)
    return rows.unionByName(frames.select("view_id", "frame", F.lit(-1).cast("long").alias("node_id"), F.lit(None).cast("double").alias("error")))


def schedule(errors: DataFrame, fan: int, threshold: float, budget: int) -> DataFrame:
    """Actions per view and frame of a batch of (view_id, frame, node_id, error), each view starting at the root.

    The frames of a view pass by in order; of a frame only the nodes around the cut are kept.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        view, frame, cut, wanted, error = None, None, {0}, None, {}
        out: list[tuple] = []

        def frame_done():
            out.extend((view[1], frame, n, a) for n, a in update_cut(cut, error, fan, threshold, budget))

        for batch in batches:
            if not batch.num_rows:
                continue
            views = batch.column("view_id")
            null, of, frames = views.is_null().to_numpy(zero_copy_only=False), views.fill_null(0).to_numpy(), batch.column("frame").to_numpy()
            nodes, values = batch.column("node_id").to_numpy(), batch.column("error").to_numpy(zero_copy_only=False)
            new = np.flatnonzero((null[1:] != null[:-1]) | (of[1:] != of[:-1]) | (frames[1:] != frames[:-1])) + 1
            for a, b in zip((0, *new), (*new, len(nodes)), strict=True):
                mine = (bool(null[a]), None if null[a] else int(of[a]))
                if (mine, int(frames[a])) != (view, frame):
                    if view is not None:
                        frame_done()
                    if mine != view:
                        cut = {0}
                    view, frame, error = mine, int(frames[a]), {}
                    wanted = np.array(sorted(looked_up(cut, fan)))
                at = a + np.flatnonzero(np.isin(nodes[a:b], wanted))
                error.update(zip(nodes[at].tolist(), values[at].tolist(), strict=True))
            while len(out) > 10_000:
                part, out[:10_000] = out[:10_000], []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names=names)
        if view is not None:
            frame_done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names, kinds = ["view_id", "frame", "node_id", "action"], ["int64", "int64", "int64", "string"]
    at = within_reach(errors.where(F.col("node_id").isNotNull()), fan).repartition("view_id").sortWithinPartitions("view_id", "frame")
    return at.select("view_id", "frame", "node_id", "error").mapInArrow(run, ACTIONS)


def schedule_stream(errors: DataFrame, fan: int, threshold: float, budget: int) -> DataFrame:
    """The same for a stream: the cut of a view is its state."""

    def one(key, batches, state):
        cut = set(json.loads(state.get[0])) if state.exists else {0}
        pdf = pd.concat(list(batches))
        out = _frames(pdf, cut, fan, threshold, budget)
        state.update((json.dumps(sorted(cut)),))
        yield pd.DataFrame([(key[0], *row) for row in out], columns=["view_id", "frame", "node_id", "action"])

    return errors.groupBy("view_id").applyInPandasWithState(one, ACTIONS, "cut string", "append", "NoTimeout")
