"""Connected components of key graphs, by smallest labels over neighbours and pointer jumping.

For graphs of distinct keys, which are far smaller than the records that name
them; the result is written each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.operators.skew import hot_size, join_hot
from sigtrace.sources.shared import RunFolder

ROUNDS = 200


def smallest_labels(edges: DataFrame, folder: RunFolder) -> DataFrame:
    """``v, label`` of the vertices of edges ``a, b`` (STRING): the smallest vertex of each component.

    Edges may repeat in any direction; null ends are left out; a loop makes a
    vertex of its own. Each round takes the least label among neighbours, then
    that label's label, so chains halve. Vertices with many neighbours and
    labels of many vertices are joined by broadcast. After ROUNDS rounds, far
    beyond what halving needs, it raises.
    """
    e = edges.select("a", "b").filter("a is not null and b is not null")
    both = folder.write(e.unionAll(e.select(F.col("b"), F.col("a"))).distinct(), "both")
    hot = hot_size(both.count())
    labels = folder.write(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels0")
    for k in range(1, ROUNDS + 1):
        near = join_hot(both, labels.select(F.col("v").alias("b"), "label"), "b", "label", "a", hot).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        new = folder.write(labels.join(near, "v").select("v", "label", F.least("label", "near").alias("to")), f"near{k}")
        jump = labels.select(F.col("v").alias("to"), F.col("label").alias("far"))
        new = join_hot(new, jump, "to", "far", "v", hot).select("v", F.least("to", "far").alias("to"), "label")
        new = folder.write(new.select("v", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("moved")), f"labels{k}")
        moved = new.filter("moved").limit(1).count()
        folder.drop(f"labels{k - 1}")
        folder.drop(f"near{k}")
        labels = new.select("v", "label")
        if not moved:
            return labels
    raise RuntimeError(f"not stable after {ROUNDS} rounds")
