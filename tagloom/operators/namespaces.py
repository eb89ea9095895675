"""Which declaration holds for a prefix at a place, without a range join.

Declarations of one prefix in one document open and close like brackets. With their running depth, the innermost open one at
a place is the last one that opened at the depth of that place: two windows, linear in the number of places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def innermost(declared: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc_id, prefix, at, sub, ...) with uri, and declared: whether a declaration holds.

    declared: doc_id, prefix, uri, at, sub (place inside of the tag), until (place of the tag that ends the scope).
    """
    key = ["doc_id", "prefix"]
    opens = declared.select(*key, "at", "sub", F.lit(0).alias("part"), F.lit(1).alias("step"), "uri")
    closes = declared.select(*key, F.col("until").alias("at"), F.lit(1 << 30).alias("sub"), F.lit(2).alias("part"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("uri"))
    asks = asked.withColumn("part", F.lit(1)).withColumn("step", F.lit(0))
    rows = asks.unionByName(opens.unionByName(closes), allowMissingColumns=True) if "uri" in asks.columns else asks.withColumn("uri", F.lit(None).cast("string")).unionByName(opens.unionByName(closes), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("at", "sub", "part").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.sum("step").over(order))
    peers = Window.partitionBy(*key, "open").orderBy("at", "sub", "part").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("part") == 0, F.struct("uri")), ignorenulls=True).over(peers)
    rows = rows.withColumn("found", F.when(F.col("open") > 0, last)).where(F.col("part") == 1)
    return rows.withColumn("uri", F.col("found.uri")).withColumn("declared", F.col("found").isNotNull()).drop("part", "step", "open", "found")
