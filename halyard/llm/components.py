"""Connected components: union-find inside a task, then rounds of smallest labels over the whole graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import frozen, released


class Forest:
    """Union-find over 0..n-1 with whole arrays of edges at a time. A root is the smallest of its tree."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                break
            root = up
        self.parent[x] = root
        return root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def spanning(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins these edges and returns the places of as many of them as that took; early ones are preferred."""
        left, used = np.arange(a.size), [np.zeros(0, np.int64)]
        while left.size:
            x, y = self.find(a[left]), self.find(b[left])
            apart = x != y
            left, high, low = left[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
            roots, first = np.unique(high, return_index=True)  # each root hangs itself below a smaller one, by one edge
            self.parent[roots] = low[first]
            used.append(left[first])
        return np.concatenate(used)

    def edges(self, fan: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """As few edges as join what is joined. Each tree becomes one of degree fan + 1 at most, so no node is hot."""
        every = np.arange(self.parent.size)
        root = self.find(every)
        _, group, counts = np.unique(root, return_inverse=True, return_counts=True)
        order = np.argsort(group, kind="stable")
        starts = np.cumsum(counts) - counts
        place = np.empty_like(every)
        place[order] = every - np.repeat(starts, counts)
        child = np.flatnonzero(place > 0)
        return child, order[starts[group[child]] + (place[child] - 1) // fan]


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null). A row per node: node, label, the smallest node that it reaches.

    Each round a node takes the smallest label among its own and its neighbours' labels, then the label of that label, so chains
    halve. Joins read frozen tables, whose both sides are exchanged, so Spark can split a label that many nodes have.
    Smallest labels are pre-aggregated in every task. One count a round comes to the driver.
    """
    both = frozen(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = frozen(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    old = labels
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        one = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        one = frozen(one, "labels")
        up = one.select(F.col("node").alias("of"), F.col("label").alias("up"))
        new = frozen(one.join(up, one["label"] == up["of"]).select("node", F.least("label", "up").alias("label"), (F.col("was") != F.least("label", "up")).alias("moved")), "labels")
        released(old, one)
        if new.filter("moved").isEmpty():
            released(both)
            return new.select("node", "label")
        old, labels = new, new.select("node", "label")
