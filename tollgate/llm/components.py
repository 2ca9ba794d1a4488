"""Connected components of a link table, as rounds of joins over written tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.session import checkpointed


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that can be reached over the links, for linked nodes.

    Alternating star contraction: every node's larger neighbours, then its smaller ones, are
    re-linked to its smallest neighbour until nothing changes, which takes a number of rounds
    that grows with the logarithm of the longest path. A round moves at most as many rows as
    there are links, whatever the degree of a node; a hub's rows are counted by partial
    aggregates and joined under AQE's skew handling. Rows with a null or the same node on both
    sides are no links.
    """
    stars = checkpointed(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("n"), F.least(a, b).alias("m"))
        .distinct()
    )
    before = _state(stars)
    while True:
        both = stars.select("n", "m").union(stars.select(F.col("m"), F.col("n")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"))
        large = (
            both.join(least, "n")
            .where((F.col("m") > F.col("n")) & (F.col("m") != F.col("r")))
            .select(F.col("m").alias("n"), F.col("r").alias("m"))
            .distinct()
        )
        least = large.groupBy("n").agg(F.min("m").alias("r"))
        moved = large.join(least, "n").where("m != r").select(F.col("m").alias("n"), F.col("r").alias("m"))
        stars = checkpointed(moved.union(least).distinct())
        after = _state(stars)
        if after == before:
            return stars.select(F.col("n").alias("node"), F.col("m").alias("component"))
        before = after


def _state(stars: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("n", "m").cast("decimal(20,0)"))
    return tuple(stars.agg(F.count("*"), mixed).first())


class Forest:
    """Union-find over positions 0..n-1 with whole arrays of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
