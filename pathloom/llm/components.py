"""Connected components of a graph given as a DataFrame of links.

Each partition first replaces its links by a spanning forest (union-find over
one partition's links); then large-star and small-star steps alternate until
nothing changes: every node links to the least neighbour it knows. A round is
two group-minimum joins; rounds grow with the logarithm of the longest chain.
Links never meet on the driver or in one task; between rounds they are written
to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

FOREST_LINKS = 200_000


class Forest:
    """Union-find over hashable, ordered names; the least name of a set is its root."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        up.setdefault(x, x)
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(forest: Forest):
        names = [x for x in forest.up if forest.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([forest.root(x) for x in names], pa.binary())], ["u", "v"])

    forest, n = Forest(), 0
    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        n += batch.num_rows
        if n > FOREST_LINKS:
            yield out(forest)
            forest, n = Forest(), 0
    yield out(forest)


HUB_LINKS = 1000  # links of a node that counts as a hub, at least
HUBS = 100_000  # hubs, at most, whose least neighbours are broadcast


def _star(links: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Of ``n`` links (u, v): with ``m``, the least v of their u; and (u, m) alone. Links of a hub stay where they are:
    its least neighbour is broadcast. A hub has more links than a share of them all, so there are never more than
    HUBS."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    hub = F.col("c") > max(HUB_LINKS, n // HUBS)
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    rest = links.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u")
    return links.join(hubs, "u").unionByName(rest), least.select("u", "m")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the least node of its component. Nodes are binary.

    A link with a null end is none; a link of a node with itself makes it a component; repeated links count once;
    no links give an empty result."""
    now = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").mapInArrow(_forest, "u binary, v binary").distinct(), "links")
    alone = links.where(F.col(a) == F.col(b)).select(F.col(a).alias("u"))
    before, n = None, now.count()
    while True:
        # large-star: the larger neighbours of a node link to the least of its neighbourhood
        star, _ = _star(now.union(now.select("v", "u")), 2 * n)
        large = written(star.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "large")
        discard(now)
        # small-star: each node and its smaller neighbours link to the least of these
        star, least = _star(large, n)
        now = written(star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least).distinct(), "links")
        discard(large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            loners = alone.join(found.select(F.col("node").alias("u")), "u", "left_anti")
            return found.union(now.select(F.col("v").alias("u")).union(loners).distinct().select("u", F.col("u").alias("v")))
        before, n = state, state[0]
