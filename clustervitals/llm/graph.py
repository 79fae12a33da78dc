"""Connected components of a graph given as edges, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import keep

# Edges that a task holds before it contracts them.
_HELD = 1 << 20
# Partitions of edges for each core, at most.
_TASKS = 4


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges, and for each the smallest one that it is connected with."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root != root[root]).any():
            root = root[root]
    return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: every node with the smallest one of its component here."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n > _HELD:
            held = [smallest_reachable(*(np.concatenate(x) for x in zip(*held)))]
            n = 0
    if held:
        nodes, roots = smallest_reachable(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node with the smallest of its roots, and that one with the others as further edges."""
    table = pa.Table.from_batches(list(batches), pa.schema([("node", pa.int64()), ("root", pa.int64())]))
    node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
    order = np.lexsort((root, node))
    node, root = node[order], root[order]
    new = np.ones(len(node), bool)
    new[1:] = node[1:] != node[:-1]
    least = root[new][np.cumsum(new) - 1]
    kept = new | (root != least)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.where(new, node, root)[kept]), pa.array(least[kept]), pa.array(~new[kept])], ["node", "root", "further"]
    )


def components(edges: DataFrame, stars: bool = False) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b): the smallest node that can be reached.

    Every partition contracts its edges to stars; the stars of a node meet, and
    where they disagree their centres make the edges of the next, smaller round.
    A node has at most one row per partition, so one with very many edges does
    not make a large task.  Edges with a null end or equal ends are left out.
    ``stars`` says that the edges are each partition's stars already, centres included.
    """
    # Few partitions: a node has a row from each, and they agree the sooner.
    tasks = _TASKS * edges.sparkSession.sparkContext.defaultParallelism
    edges = edges.toDF("node", "root") if stars else edges.toDF("a", "b").filter("a <> b")
    levels = []
    while True:
        contracted = edges if stars and not levels else edges.coalesce(tasks).mapInArrow(_contract, "node long, root long")
        settled = keep(contracted.repartition("node").mapInArrow(_settle, "node long, root long, further boolean"))
        levels.append(settled.filter("not further").select("node", "root"))
        edges = settled.filter("further").select("node", "root")
        if edges.isEmpty():
            break
    found = levels[-1].toDF("node", "component")
    for level in reversed(levels[:-1]):
        above = found.toDF("centre", "component")
        found = level.join(above, level["root"] == above["centre"], "left").select(
            "node", F.coalesce("component", "root").alias("component")
        )
    return found
