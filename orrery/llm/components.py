"""Connected components of a large edge table by alternating large and small stars.

Nothing is gathered per node and nothing of the graph reaches the driver: each round is two least-neighbour aggregations
(combined before the shuffle) and two joins whose hot keys adaptive execution can split, written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the least node that each reaches by them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not (new == (hop := new[new])).all():
            new = hop
        if (new[label] == label).all() and (new[x] == new[y]).all():
            return nodes, nodes[new]
        label = new[label]


def contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars around the least node of each piece: at most one for each node in it."""

    def stars(frames):
        for f in frames:
            nodes, least = roots(f["a"].to_numpy(), f["b"].to_numpy())
            yield pd.DataFrame({"a": nodes, "b": least})[nodes != least]

    return edges.mapInPandas(stars, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long; any order, repeats allowed) but the roots themselves.

    The root is the least node of the component. Nulls and loops must be absent."""
    now = cut(contracted(edges.select("a", "b")).distinct(), "edges")
    state = stamp(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = cut(both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(low, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = cut(small.distinct(), "edges")
        for done in (now, least, large, low):
            drop(done)
        now, before, state = new, state, stamp(new)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
