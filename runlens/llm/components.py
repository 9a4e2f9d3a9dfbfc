"""Connected components of a graph given as links, by alternating stars.

Every node has a least neighbour, so the left joins below are inner ones; but of a left
join only the right side can be broadcast, whose size is measured as it is shuffled, and not
the links, which are taken to be as small as their files. The filters hold no null out, as
that would make inner joins of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.shared import written


def _large(links: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least of its neighbours and itself."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u", "left").select(F.col("m").alias("u"), "v").where("NOT u <=> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u", "left")
    out = joined.select(F.col("m").alias("u"), "v").union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.where("NOT u <=> v").distinct()


def roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns u, v; distinct ends): the
    least node that it is connected with. Each round writes its stars, and the
    rounds end when a round changes nothing; their number grows with the logarithm
    of the number of nodes. An empty graph has no nodes."""
    now = written(links.select("u", "v").distinct())
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        now = written(_small(written(_large(now))))
    stars = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return stars.union(stars.select("root", "root")).distinct()
