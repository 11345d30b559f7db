"""Connected components of an edge table.

Every task first joins its own edges by union-find, in batches of bounded size, and
passes on the edges of a spanning forest only.  Rounds of hooking, pointer jumping to
the roots and contraction then run as equi-joins and aggregations with map-side
combine; a round at least halves the vertices that still have edges, and its tables
are checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean

#: Vertices that a task's union-find holds before it passes its forest on, about 50 MB.
HELD = 200_000


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from each vertex to the least of its component among the edges held."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def out() -> pa.RecordBatch:
        edges = [(x, root(x)) for x, p in parent.items() if p != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield out()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a long, b long) with a <> b: comp is the least node of its component."""
    live = edges.select("a", "b").where("a <> b").mapInArrow(lean(_forest), "a long, b long").checkpoint()
    label = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")).checkpoint()
        while True:  # to the roots; each turn doubles the steps
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = parent.join(up, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")).checkpoint()
            parent = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = parent.select(F.col("v").alias("node"), F.col("p").alias("comp"))
        else:
            label = label.join(parent, label.comp == parent.v, "left").select("node", F.coalesce("p", "comp").alias("comp")).checkpoint()
        heads = live.join(parent, live.a == parent.v).select(F.col("p").alias("x"), "b")
        live = heads.join(parent, heads.b == parent.v).select(F.col("x").alias("a"), F.col("p").alias("b")).where("a <> b")
        live = live.mapInArrow(lean(_forest), "a long, b long").checkpoint()
    return label if label is not None else live.select(F.col("a").alias("node"), F.col("b").alias("comp"))
