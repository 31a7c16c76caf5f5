"""Connected components of a table of edges, by repeated smallest-neighbour steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Edges that the driver solves at once (3 MB); more go through rounds of joins.
SMALL = 200_000


def solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, ascending, and their roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        for side in (a, b, root[a], root[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) for every node of the (a, b) edges; root is the smallest node of its component.

    A round gives each node the smallest label of its neighbours and then that label's
    own label (pointer jumping), so rounds grow with the logarithm of a chain's length.
    Labels live in tables; the driver sees one count a round. Up to ``small`` edges are
    solved on the driver: there the rounds' many small joins would take far more of its
    memory, for plans, generated code and threads, than the edges do.
    """
    if edges.count() <= small:
        found = edges.select("a", "b").where("a <> b").toArrow()
        nodes, roots = solved(*(found[c].to_numpy() for c in "ab"))
        return staged(edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots}), "node long, root long"), "labels")
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select("node", "root"), F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("near"))
        step = labels.select("node", "root").join(near, F.col("node") == F.col("n")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("n"), F.col("root").alias("far"))
        step = step.join(jump, F.col("mid") == F.col("n")).select("node", "old", F.least("mid", "far").alias("root"))
        step = staged(step, "labels")
        discard(labels)
        if not step.where("root < old").limit(1).count():
            discard(both)
            return step.select("node", "root")
        labels = step
