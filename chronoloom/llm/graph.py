"""Connected components of an edge table by randomised contraction.

In each round vertices have ranks, every vertex takes the lowest-ranked vertex among
itself and its neighbours, and the edges are drawn anew between what their ends
took. In the first round a vertex ranks by itself, which settles stars around
their smallest vertex at once; then ranks are pseudo-random (a hash of vertex and
round, so a retried task gives the same). A quarter of the vertices goes in each
such round on average, whatever the shape of the graph, so rounds grow with the
logarithm of its size; they end when no edge is left. The renamings are then followed backwards and each component is
named by its smallest vertex.

All of it is grouping and joining: edges are made distinct before each join, hot
vertices are pre-aggregated by Spark's partial minimum, and joins can be split by
adaptive execution. Each round is written to the shared folder, which also cuts the
lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(vertex, component)`` of every vertex that has an edge to another one.

    ``component`` is the smallest vertex of its component. Edges count in both
    directions; loops, repeated edges and edges with a null end have no effect; no
    edges give no rows.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = materialize(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    renamed: list[DataFrame] = []
    while not now.isEmpty():
        rank = lambda c, n=len(renamed): F.struct((F.xxhash64(F.col(c), F.lit(n)) if n else F.lit(0).cast("long")).alias("rank"), F.col(c).alias("x"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        took = materialize(lowest.select("u", F.least(rank("u"), F.col("m"))["x"].alias("m")), "took")
        renamed.append(took)
        left = now.join(took, "u").select(F.col("m").alias("a"), "v")
        drawn = left.join(took.withColumnRenamed("u", "v"), "v").select(F.least("a", "m").alias("u"), F.greatest("a", "m").alias("v"))
        now = materialize(drawn.where("u <> v").distinct(), "edges")
    if not renamed:
        return now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    found = renamed[-1].select(F.col("u").alias("vertex"), F.col("m").alias("root"))
    for took in reversed(renamed[:-1]):
        later = found.withColumnRenamed("vertex", "m")
        found = took.join(later, "m", "left").select(F.col("u").alias("vertex"), F.coalesce("root", "m").alias("root"))
    found = materialize(found, "roots") if len(renamed) > 1 else found
    least = found.groupBy("root").agg(F.min("vertex").alias("component"))
    return found.join(least, "root").select("vertex", "component")
