"""Connected components of an edge list, with nothing collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (columns a, b of long).

    Alternating large-star and small-star rounds: each node hands its
    neighbours to its smallest neighbour, so hubs shrink to stars and the
    number of rounds follows the logarithm of the diameter.  Minima are
    pre-aggregated before each shuffle.  Null ends and loops are ignored; an
    empty edge list has no ids.
    """
    e = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a is not null and b is not null and a <> b")
    e = session.stash(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", small=True)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours, and the node itself, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("p"))
        small = small.select(F.col("p.x").alias("a"), F.col("p.y").alias("b")).where("a <> b").distinct()
        new = session.stash(small, "edges", small=True)
        # Done when every node hangs on one root that hangs on none.
        again = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).unionByName(new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi").select("a", F.lit(0).cast("bigint").alias("n")).limit(1))
        e = new
        if not again.take(1):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return session.stash(e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct(), "components", small=True)
