"""Connected components of an edge table: local contraction and stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordfold.llm import io

#: Edges that a task contracts at once.
TASK_EDGES = 500_000

EDGES = "u long, v long"


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The edges dealt to tasks, each of which replaces its own by one from
    every node to the smallest that it reaches there."""
    schema = io.arrow_schema(EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = root[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in list(root)]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

    return io.written(edges.repartition(tasks).mapInArrow(run, EDGES), "edges")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the
    edges ``u, v`` (longs) that has another; loops and repeated edges are
    allowed.

    Tasks contract bounded shares of the edges by union-find. If that took
    more than one task, the stars that they leave are joined: every node
    points its larger neighbours, then its smaller ones, at its smallest one;
    and so on until nothing changes. Edges never grow in number. Each step is
    written to the shared folder, so no lineage builds up."""
    edges = io.written(links.filter("u <> v").select("u", "v"), "edges")
    while True:
        state = _state(edges)
        tasks = -(-state[0] // TASK_EDGES)
        if not tasks:
            break
        edges = contracted(edges, tasks)
        if tasks == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = io.written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        edges = io.written(small.filter("u <> v").distinct(), "edges")
        if _state(edges) == state:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select("v", "v").distinct())
