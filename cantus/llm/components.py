"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.llm.store import spent, written

#: Graphs of so many edges at most (16 MB) are solved in one task; larger ones in rounds of joins. Both give the same.
ONE_TASK = 1_000_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a to b, and the smallest node that each can reach."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    own = np.arange(len(node))
    while True:
        low = np.minimum(own[x], own[y])
        new = own.copy()
        # the roots of both ends take the smaller label, and so do the ends
        for to in (x, y, own[x], own[y]):
            np.minimum.at(new, to, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, own):
            return node, node[own]
        own = new


def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x in batches:
        a.append(x.column("a").to_numpy())
        b.append(x.column("b").to_numpy())
    if a:
        node, low = labels(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], names=["cls", "comp"])


def connected(edges: DataFrame) -> DataFrame:
    """cls, comp for every node in (a, b): the smallest node it can reach; a written table.

    Each round a node takes the smallest label around it, and then the label of
    that label, so that rounds grow with the logarithm of a component's width.
    Labels only fall; the rounds end when none does. Only counts come to the driver.
    """
    edges = written(edges.select("a", "b").filter("a != b"))
    if edges.count() <= ONE_TASK:
        out = written(edges.coalesce(1).mapInArrow(one_task, "cls bigint, comp bigint"))
        spent(edges)
        return out
    both = written(edges.union(edges.select("b", "a")).distinct())
    spent(edges)
    label = written(both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("m")).select("cls", F.col("cls").alias("old"), F.least("cls", "m").alias("comp")))
    while True:
        now = label.select("cls", "comp")
        around = both.join(now.toDF("b", "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("m"))
        step = now.join(around, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = step.select(F.col("cls").alias("comp"), F.col("comp").alias("via"))
        after = written(step.join(jump, "comp", "left").select("cls", "old", F.least("comp", F.coalesce("via", "comp")).alias("comp")))
        spent(label)
        label = after
        if label.filter("comp < old").isEmpty():
            spent(both)
            return label.select("cls", "comp")
