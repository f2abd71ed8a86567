"""Connected components of edge tables of any size and shape."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_least, materialize


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node each is connected to by the given edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return nodes, nodes[root]
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not (root[root] == root).all():
            root = root[root]


def _forest(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: each batch is replaced by its stars."""
    def run(batches):
        for x in batches:
            nodes, roots = local_roots(x.column(0).to_numpy(), x.column(1).to_numpy())
            far = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(roots[far])], names=["v", "u"])

    return edges.select("v", "u").mapInArrow(run, "v long, u long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of edges (v long, u long) that is not a root.

    Large and small stars (Kiveris et al. 2014), each round written to the shared folder. The least neighbour of a node is
    found per salt first, so a node with very many edges is spread over tasks."""
    e = materialize(_forest(edges))
    while True:
        both = e.unionAll(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = group_least(both, ["v"], "u", "_m").where("u > v").select(F.col("u").alias("v"), F.least("v", "_m").alias("u")).where("v <> u").distinct()
        small = group_least(large, ["v"], "u", "_m")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("_m").alias("u")), F.struct(F.col("u").alias("v"), F.col("_m").alias("u")))).alias("e")).select("e.*")
        new = materialize(small.where("v <> u").distinct())
        mark = F.struct(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")))
        if new.agg(mark).first() == e.agg(mark).first():
            return new.select(F.col("v").alias("node"), F.col("u").alias("root"))
        e = new
