"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.common import written


def _forests(edges: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Stars (u, v) that connect what the edges connect, and whether they are whole: each task joins its own up to `most` edges."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not ends:
            return
        nodes, place = np.unique(np.concatenate([x for pair in zip(*ends, strict=True) for x in pair]), return_inverse=True)
        u, v = place[: len(place) // 2], place[len(place) // 2 :]
        least = np.arange(len(nodes))
        while True:  # each node takes the least root among its neighbours' and then its root's root, until none changes
            low = np.minimum(least[u], least[v])
            new = least.copy()
            for at in (u, v, least[u], least[v]):
                np.minimum.at(new, at, low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, least):
                break
            least = new
        off = np.flatnonzero(least != np.arange(len(nodes)))
        for i in range(0, len(off), 50_000):
            at = off[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at], pa.int64()), pa.array(nodes[least[at]], pa.int64())], ["u", "v"])

    tasks = -(-edges.count() // most) or 1
    return written(edges.coalesce(tasks).mapInArrow(join, "u long, v long"), "links"), tasks == 1


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("as_u")).union(edges.select(F.col("v").alias("u"), F.lit(0).alias("as_u")))
    kinds = ends.groupBy("u").agg(F.sum("as_u").alias("n"), F.min("as_u").alias("least"))
    return kinds.where("n > 1 or (n = 1 and least = 0)").isEmpty()


def components(links: DataFrame, most: int = 500_000) -> DataFrame:
    """links: (u, v), either way round, u != v. Result: (u, component) for each u that has a link to a smaller one.

    Tasks of a bounded number of links join what they hold; what is left goes through rounds until all links are stars, some log2
    of the longest shortest path. Each is written to the shared folder; minima are taken by partial aggregation, so that a node with
    many links is no single task's work, and the links of such a node are joined as Spark splits them.
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "links")
    edges, whole = _forests(edges, most)
    while not (whole or _are_stars(edges)):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _mins(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, whole = _forests(written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links"), most)
    return edges.select("u", F.col("v").alias("component"))


def of_component(rows: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the component of a column's node, which is itself where it has no smaller one."""
    return rows.join(found.withColumnsRenamed({"u": column, "component": name}), column, "left").withColumn(name, F.coalesce(name, column))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """components(all links so far) from found, those of the links before: only the components that new links join are gone through."""
    between = of_component(of_component(links, found, "u", "uc"), found, "v", "vc").select(F.col("uc").alias("u"), F.col("vc").alias("v"))
    joined = written(components(between), "joined")
    return of_component(found.withColumnRenamed("component", "c"), joined, "c", "component").select("u", "component").union(joined)
