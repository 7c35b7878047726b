"""Connected components of an edge table, labelled by the smallest id, without collecting anything."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize

#: Edge tables of at most so many rows are labelled by one task, about 50 bytes an edge; larger ones in rounds of joins.
ONE_TASK = 1 << 20


def _label(batches):
    """All edges (u, v): each node, and the smallest id it can reach."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    comp = np.arange(len(ids))
    while True:
        low = np.minimum(comp[u], comp[v])
        new = comp.copy()
        np.minimum.at(new, comp[u], low)
        np.minimum.at(new, comp[v], low)
        while True:  # every label follows its own label to the end
            far = new[new]
            if np.array_equal(far, new):
                break
            new = far
        if np.array_equal(new, comp):
            break
        comp = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[comp])], ["id", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (id, comp): every node that has an edge, and the smallest id it can reach.

    Each round a node takes the smallest label among its neighbours and follows its label's own label (pointer
    jumping), so long chains halve. Minimum and join by node pre-aggregate and split; hubs need no single task.
    Labels only fall, so the rounds end when none moves. Self-loops and repeated edges are allowed; an empty table has no components.
    A table of at most ONE_TASK rows needs no rounds: one task labels it.
    """
    if not hasattr(edges, "_quill_path"):
        edges = materialize(edges.select("u", "v"), "edges")
    if edges.count() <= ONE_TASK:
        made = edges.filter("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1)
        return materialize(made.mapInArrow(_label, "id long, comp long"), "labels")
    both = edges.select(F.col("u").alias("id"), F.col("v").alias("to")).union(edges.select(F.col("v").alias("id"), F.col("u").alias("to"))).filter("id <> to").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("comp").alias("l")), "to").groupBy("id").agg(F.min("l").alias("l"))
        # hook: a node's label takes the smallest label seen by any node that carries it
        seen = labels.join(near, "id").select("id", "comp", F.least("comp", "l").alias("low"))
        hook = seen.groupBy("comp").agg(F.min("low").alias("hook"))
        step = seen.join(hook.withColumnRenamed("comp", "_c"), F.col("comp") == F.col("_c")).select("id", F.col("comp").alias("old"), F.least("low", "hook").alias("comp"))
        jump = hook.select(F.col("comp").alias("_j"), F.col("hook").alias("_h"))
        step = step.join(jump, F.col("comp") == F.col("_j"), "left").select("id", "old", F.least("comp", F.coalesce("_h", "comp")).alias("comp"))
        new = materialize(step, "labels")
        moved = new.filter("old <> comp").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            return labels.select("id", "comp")
